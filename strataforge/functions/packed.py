"""Packed delta entries: a typed delta row as bytes, and back; a row at a time or a table in Arrow batches. Used at the
edge only; inside, deltas are typed columns.

Layout, little-endian: length u32 (of what follows) | value_map u32 | part_key u32 | row id | changed columns in
the order of their indices. A text is u32 length and bytes; a boolean is one byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.spec import TableSpec

FORMATS = {"int": "<i", "bigint": "<q", "float": "<f", "double": "<d", "boolean": "<?"}


def _put(kind: str, value) -> bytes:
    if kind in FORMATS:
        return struct.pack(FORMATS[kind], value)
    data = value.encode() if isinstance(value, str) else bytes(value)
    return struct.pack("<I", len(data)) + data


def _take(kind: str, data: bytes, at: int):
    if kind in FORMATS:
        return struct.unpack_from(FORMATS[kind], data, at)[0], at + struct.calcsize(FORMATS[kind])
    (n,) = struct.unpack_from("<I", data, at)
    raw = data[at + 4 : at + 4 + n]
    return raw.decode() if kind == "string" else raw, at + 4 + n


def pack_delta(value_map: int, part_key: int, row_id: int, values: dict[int, object], kinds: dict[int, str], row_id_kind: str = "bigint") -> bytes:
    """values, kinds: by column index; those in value_map are stored."""
    body = struct.pack("<II", value_map, part_key) + _put(row_id_kind, row_id)
    for index in sorted(kinds):
        if value_map >> index & 1:
            body += _put(kinds[index], values[index])
    return struct.pack("<I", len(body)) + body


def unpack_delta(data: bytes, kinds: dict[int, str], row_id_kind: str = "bigint") -> tuple[int, int, int, dict[int, object]]:
    """(value_map, part_key, row_id, changed values by column index)."""
    length, value_map, part_key = struct.unpack_from("<III", data, 0)
    if length + 4 != len(data):
        raise ValueError("the entry's length doesn't fit its data")
    row_id, at = _take(row_id_kind, data, 12)
    values = {}
    for index in sorted(kinds):
        if value_map >> index & 1:
            values[index], at = _take(kinds[index], data, at)
    return value_map, part_key, row_id, values


def _kinds(df: DataFrame, spec: TableSpec) -> dict[int, str]:
    return {spec.bit(c): df.schema[c].dataType.simpleString() for c in spec.payload}


def pack_deltas(deltas: DataFrame, spec: TableSpec) -> DataFrame:
    """(entry, seq): each delta as its packed entry. The keys must fit: part_key has 32 bits."""
    kinds, names = _kinds(deltas, spec), {spec.bit(c): c for c in spec.payload}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            entries = [pack_delta(r["value_map"], r["part_key"], r["row_id"], {k: r[c] for k, c in names.items()}, kinds) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), pa.array([r["seq"] for r in rows], pa.int64())], ["entry", "seq"])

    return deltas.mapInArrow(run, "entry binary, seq long")


def unpack_deltas(packed: DataFrame, like: DataFrame, spec: TableSpec) -> DataFrame:
    """The delta rows of pack_deltas(); like: any table with the payload columns' types. Columns that did not change are
    null."""
    kinds, names = _kinds(like, spec), {spec.bit(c): c for c in spec.payload}
    schema = "row_id long, part_key long, value_map int, " + ", ".join(f"{c} {kinds[k]}" for k, c in names.items()) + ", seq long"

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                value_map, part_key, row_id, values = unpack_delta(bytes(r["entry"]), kinds)
                rows.append({"row_id": row_id, "part_key": part_key, "value_map": value_map, "seq": r["seq"]} | {c: values.get(k) for k, c in names.items()})
            yield pa.RecordBatch.from_pylist(rows, schema=made)

    return packed.mapInArrow(run, schema)

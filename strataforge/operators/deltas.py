"""Deltas: partial-row updates and tombstones, keyed by row id.

A delta row is (row_id, part_key, value_map, payload columns, seq). Bit c of value_map says that column c changes;
0 is a tombstone. seq gives the order, which Spark's rows do not have. A null cannot be written by a delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import TableSpec


def latest(deltas: DataFrame, spec: TableSpec, also: tuple[str, ...] = ()) -> DataFrame:
    """One delta for each row id (and each value of the columns in also).

    "replace": the last, whole. It is found by a partial aggregate before the shuffle, not by a window, so a row id
    with very many deltas costs no more than any other.

    "merge": each column's last value since the last tombstone, so that changes after a tombstone bring the row back
    with them; value_map then has the bits of these columns (and bit 0 if later deltas change no payload column). If
    nothing follows the last tombstone, it is one. Partial aggregates too: each column's last change and its seq."""
    if spec.delta_policy == "replace":
        rest = [c for c in deltas.columns if c != "row_id" and c not in also]
        return deltas.groupBy("row_id", *also).agg(F.max_by(F.struct(*rest), "seq").alias("d")).select("row_id", *also, *(F.col(f"d.{c}") for c in rest))
    changes = {c: F.getbit("value_map", F.lit(spec.bit(c))) == 1 for c in spec.payload}
    merged = deltas.groupBy("row_id", *also).agg(
        F.max_by("part_key", "seq").alias("part_key"),
        F.max("seq").alias("seq"),
        F.max(F.when(F.col("value_map") == 0, F.col("seq"))).alias("__gone"),
        *(F.max(F.when(on, F.struct(F.col("seq").alias("seq"), F.col(c).alias("value")))).alias(f"__{c}") for c, on in changes.items()),
    )
    since = lambda c: F.col(f"__{c}").isNotNull() & (F.col("__gone").isNull() | (F.col(f"__{c}.seq") > F.col("__gone")))
    gone = F.coalesce(F.col("__gone") == F.col("seq"), F.lit(False))
    bits = reduce(lambda total, c: total.bitwiseOR(F.when(since(c), 1 << spec.bit(c)).otherwise(0)), spec.payload, F.lit(0))
    whole = F.when(gone, 0).when(bits == 0, 1).otherwise(bits)
    return merged.select("row_id", *also, "part_key", whole.cast("int").alias("value_map"), *(F.when(since(c), F.col(f"__{c}.value")).alias(c) for c in spec.payload), "seq")


def is_tombstone(value_map: Column) -> Column:
    return F.coalesce(value_map == 0, F.lit(False))


def matched(base: DataFrame, deltas: DataFrame, spec: TableSpec, order: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(__rid, also as __also_*, __map, payload as __*, __first): the latest deltas that have a base row; __first is the
    least `order` of its rows. Only the base's keys and order are read; one join and a partial aggregate, so neither
    a row id on very many rows nor one with very many deltas meets in one task."""
    d = latest(deltas, spec, also)
    keys = base.select(F.col(spec.row_id).alias("row_id"), *also, (F.lit(0) if order is None else order).alias("__at"))
    rest = F.struct(F.col("value_map").alias("__map"), *(F.col(c).alias(f"__{c}") for c in spec.payload))
    met = keys.join(d.select("row_id", *also, rest.alias("__d")), ["row_id", *also])
    found = met.groupBy("row_id", *also).agg(F.min("__at").alias("__first"), F.any_value("__d").alias("__d"))
    return found.select(F.col("row_id").alias("__rid"), *(F.col(c).alias(f"__also_{c}") for c in also), "__first", "__d.*")


def apply_matched(base: DataFrame, found: DataFrame, spec: TableSpec, deletes: bool = True, order: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """base with matched() deltas applied: one join by row id, which Spark broadcasts if the deltas are small enough by
    its own check. With an order, of several rows with one row id the first takes the delta; it must tell rows apart."""
    match = F.col(spec.row_id) == F.col("__rid")
    for c in also:
        match = match & (F.col(c) == F.col(f"__also_{c}"))
    rows = base
    if order is not None:
        rows, match = base.withColumn("__at", order), match & (F.col("__at") == F.col("__first"))
    joined = rows.join(found, match, "left")
    if deletes:
        joined = joined.where(~is_tombstone(F.col("__map")))
    changed = {c: F.when(F.getbit("__map", F.lit(spec.bit(c))) == 1, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in spec.payload}
    return joined.select(*(changed.get(c, F.col(c)) for c in base.columns))


def apply_deltas(base: DataFrame, deltas: DataFrame, spec: TableSpec, deletes: bool = True, first_match: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """base with its latest deltas applied. deletes=False keeps tombstoned rows. first_match: an order of base rows that
    tells them apart; of several rows with one row id only the first takes the delta (none: all of them do). also:
    columns of both that must be equal too."""
    if first_match is not None:
        return apply_matched(base, matched(base, deltas, spec, first_match, also), spec, deletes, first_match, also)
    d = latest(deltas, spec, also)
    found = d.select(F.col("row_id").alias("__rid"), *(F.col(c).alias(f"__also_{c}") for c in also), F.col("value_map").alias("__map"), *(F.col(c).alias(f"__{c}") for c in spec.payload))
    return apply_matched(base, found, spec, deletes, None, also)


def unmatched(base: DataFrame, deltas: DataFrame, spec: TableSpec, also: tuple[str, ...] = ()) -> DataFrame:
    """The latest deltas, tombstones too, whose row id no base row has; they go on to the child of their part_key."""
    return latest(deltas, spec, also).join(base.select(F.col(spec.row_id).alias("row_id"), *also), ["row_id", *also], "left_anti")

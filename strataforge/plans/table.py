"""A leveled, radix-partitioned, merge-on-read table with versioned partition maps.

A version is one small JSON file, written last and never changed. It names a file for each level with the level's
partitions: generation, rows, bytes, the folders of their rows and of their pending deltas; and it has the counters
of I/O and the stream batches taken in. A new version writes anew only the levels that changed. Readers resolve a
version once. Writers put their data in new folders and publish the next version by creating its file; if another
writer was first, they fail and leave only folders that vacuum() removes. Maps have an entry a partition, not a row.

Rows carry their scan order, (_batch, _pos): the version that appended them and their place in it. Every file holds
its rows in that order, and of rows with the same row id the first takes a delta. Folders lie under their level
(data/level=2/...), so that a storage policy can place levels.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routing import partition_of, partitions_between
from ..operators.deltas import apply_matched, latest, matched
from .spec import TableSpec
from .store import Store

ORDER = ["_batch", "_pos"]
#: What is counted by level, in rows and in bytes of files.
COUNTERS = ("host", "read", "written", "compacted")


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Version:
    """A partition map. Levels are read when they are first asked for; changed() ones are written on publishing."""

    def __init__(self, store: Store, told: dict):
        self.store, self.told = store, told
        self.levels: dict[int, dict[int, dict]] = {}
        self.dirty: set[int] = set()

    @property
    def number(self) -> int:
        return self.told["version"]

    def level(self, level: int) -> dict[int, dict]:
        if level not in self.levels:
            file = self.told["levels"].get(str(level))
            self.levels[level] = {e["partition_no"]: e for e in json.loads(self.store.read(file))} if file else {}
        return self.levels[level]

    def entry(self, level: int, part: int) -> dict:
        """The partition's entry, to be changed."""
        self.dirty.add(level)
        return self.level(level).setdefault(part, {"level": level, "partition_no": part, "generation": 0, "rows": 0, "size": 0, "consumed": 0, "data": [], "deltas": [], "delta_rows": 0, "delta_size": 0})

    def entries(self, *levels: int) -> list[dict]:
        return [e for k in (levels or sorted(map(int, self.told["levels"]))) for e in self.level(k).values()]

    def count(self, level: int, what: str, rows: int, size: int) -> None:
        io = self.told["io"].setdefault(str(level), {f"{c}_{u}": 0 for c in COUNTERS for u in ("rows", "bytes")} | {"map_bytes": 0})
        io[f"{what}_rows"] += rows
        io[f"{what}_bytes"] += size


class LeveledTable:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.store = Store(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec) -> LeveledTable:
        table = cls(spark, path, spec)
        if not table.store.create("spec.json", json.dumps(spec.as_dict())):
            raise ValueError(f"there is a table at {path}")
        table._publish(Version(table.store, {"version": -1, "levels": {}, "io": {}, "streams": {}}))
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, relation_id: int | None = None) -> LeveledTable:
        spec = TableSpec.of(json.loads(Store(spark, path).read("spec.json")))
        if relation_id is not None and spec.relation_id != relation_id:
            raise ValueError(f"the table is relation {spec.relation_id}, not {relation_id}")
        return cls(spark, path, spec)

    def drop(self) -> None:
        self.store.delete("")

    # versions

    def versions(self) -> list[int]:
        return [int(x[2:-5]) for x in self.store.names("map") if x.startswith("v=")]

    def roots(self) -> DataFrame:
        """(relation_id, version, pins): the versions there are, and how many readers hold each."""
        pins = [v for v, _, _ in self._pins()]
        return self.spark.createDataFrame([(self.spec.relation_id, v, pins.count(v)) for v in self.versions()], "relation_id int, version long, pins int")

    def _map(self, version: int | None = None) -> Version:
        version = self.versions()[-1] if version is None else version
        return Version(self.store, json.loads(self.store.read(f"map/v={version:012d}.json")))

    def _publish(self, new: Version) -> int:
        base = new.number
        for level in sorted(new.dirty):
            text = json.dumps([*new.level(level).values()])
            name = f"levels/{uuid.uuid4().hex}.json"
            self.store.create(name, text)
            new.told["levels"][str(level)] = name
            new.count(level, "host", 0, 0)
            new.told["io"][str(level)]["map_bytes"] += len(text)
        new.told["version"] = base + 1
        if not self.store.create(f"map/v={base + 1:012d}.json", json.dumps(new.told)):
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def partition_map(self, version: int | None = None) -> DataFrame:
        """(relation_id, version, level, partition_no, rows, size, generation, consumed, delta_rows, folders)."""
        of = self._map(version)
        rows = [(self.spec.relation_id, of.number, e["level"], e["partition_no"], e["rows"], e["size"], e["generation"], e["consumed"], e["delta_rows"], len(e["data"])) for e in of.entries()]
        return self.spark.createDataFrame(rows, "relation_id int, version long, level int, partition_no int, rows long, size long, generation int, consumed int, delta_rows long, folders int")

    def stats(self) -> DataFrame:
        """Rows and bytes by level: taken in from the host (rows and deltas), read and written by moves, rewritten by
        compaction (which is the table's garbage collection), bytes of partition maps; and write amplification over
        all levels, (host + written + compacted + map) / host bytes."""
        io = self._map().told["io"]
        host = sum(x["host_bytes"] for x in io.values())
        more = sum(x["written_bytes"] + x["compacted_bytes"] + x["map_bytes"] for x in io.values())
        names = [f"{c}_{u}" for c in COUNTERS for u in ("rows", "bytes")] + ["map_bytes"]
        rows = [(int(k), *(x[n] for n in names), (host + more) / host if host else None) for k, x in io.items()]
        return self.spark.createDataFrame(rows, "level int, " + ", ".join(f"{n} long" for n in names) + ", write_amplification double")

    @contextmanager
    def snapshot(self, version: int | None = None):
        """Pins a version for reading; vacuum() leaves its files. Leaving the block, or release(), drops the pin."""
        version = self.versions()[-1] if version is None else version
        pin = f"pins/{version}-{int(time.time())}-{uuid.uuid4().hex}"
        self.store.create(pin, "")
        found = Snapshot(self, version, pin)
        try:
            yield found
        finally:
            found.release()

    def _pins(self) -> list[tuple[int, int, str]]:
        """(version, when, name) of every pin."""
        return [(int(a), int(b), f"pins/{x}") for x in self.store.names("pins") for a, b, _ in [x.split("-")]]

    # writing

    def _write(self, df: DataFrame, kind: str, level: int) -> dict[int, tuple[str, int, int]]:
        """Rows with partition_no to a new folder of the level, a folder a partition; a partition with very many rows is
        written by several tasks, each file in scan order. partition -> (folder, rows, bytes), by one job that reads
        the files' footers."""
        name = f"{kind}/level={level}/{uuid.uuid4().hex}"
        order = ORDER if kind == "data" else ["seq"]
        df.hint("rebalance", "partition_no").sortWithinPartitions("partition_no", *order).write.partitionBy("partition_no").parquet(f"{self.path}/{name}")
        files = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").groupBy("partition_no", "_metadata.file_path").agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("size"))
        return {r["partition_no"]: (f"{name}/partition_no={r['partition_no']}", r["rows"], r["size"]) for r in files.groupBy("partition_no").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size")).collect()}

    def _checked(self, df: DataFrame, *keys: str) -> DataFrame:
        """Null or negative keys stop the write."""
        for k in keys:
            bad = F.col(k).isNull() | ((F.col(k) < 0) if k != self.spec.row_id and k != "row_id" else F.lit(False))
            df = df.withColumn(k, F.when(bad, F.raise_error(F.concat(F.lit(f"{k} must not be null or negative: "), F.coalesce(F.col(k).cast("string"), F.lit("null"))))).otherwise(F.col(k)))
        return df

    def append(self, rows: DataFrame) -> int:
        """Adds rows at level 0, in the order of their scan; the new version."""
        s, of = self.spec, self._map()
        checked = self._checked(rows.select(*s.columns), s.partition_key, s.row_id).withColumns({"_batch": F.lit(of.number + 1).cast("long"), "_pos": F.monotonically_increasing_id()})
        return self._add(of, checked.withColumn("partition_no", partition_of(s.partition_key, 0, s.spread, s.last_level)), "data")

    def append_deltas(self, deltas: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Adds pending deltas at level 0, routed by their part_key; the new version. A batch of a stream that the table has
        taken in already is no new version."""
        s, of = self.spec, self._map()
        if stream is not None:
            if of.told["streams"].get(stream, -1) >= batch:
                return of.number
            of.told["streams"][stream] = batch
        checked = self._checked(deltas.select("row_id", "part_key", "value_map", *s.payload, "seq"), "part_key", "row_id")
        return self._add(of, checked.withColumn("partition_no", partition_of("part_key", 0, s.spread, s.last_level)), "deltas")

    def _add(self, of: Version, df: DataFrame, kind: str) -> int:
        for part, told in self._write(df, kind, 0).items():
            self._take(of.entry(0, part), kind, told)
            of.count(0, "host", *told[1:])
        return self._publish(of)

    @staticmethod
    def _take(e: dict, kind: str, told: tuple[str, int, int]) -> None:
        rows, size = ("rows", "size") if kind == "data" else ("delta_rows", "delta_size")
        e[kind].append(told[0])
        e[rows] += told[1]
        e[size] += told[2]

    # reading

    def _rows(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.parquet(*(f"{self.path}/{x}" for x in folders)).select(*self.spec.columns, *ORDER)

    def _deltas(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.path}/{x}" for x in folders)).select("row_id", "part_key", "value_map", *self.spec.payload, "seq") if folders else None

    @staticmethod
    def _order() -> Column:
        return F.struct(*ORDER)

    def read(self, version: int | None = None, keys: tuple[int, int] | None = None, deletes: bool = True, order: bool = False) -> DataFrame:
        """The rows at a version with all pending deltas applied, of rows with one row id to the first; keys (low, high):
        only rows with such partition keys, by folders first. A delta may have another part_key than its row, so
        deltas are not pruned. order: with the scan order, _batch and _pos."""
        s, of = self.spec, self._map(version)
        entries = of.entries()
        wanted = entries
        if keys:
            inside = {level: partitions_between(*keys, level, s.spread, s.last_level) for level in range(s.last_level + 1)}
            wanted = [e for e in entries if inside[e["level"]] is None or e["partition_no"] in inside[e["level"]]]
        rows = self._rows([x for e in wanted for x in e["data"]])
        if rows is None:
            raise ValueError("the table has no rows")
        if keys:
            rows = rows.where(F.col(s.partition_key).between(*keys))
        deltas = self._deltas([x for e in entries for x in e["deltas"]])
        if deltas is not None:
            rows = apply_matched(rows, matched(rows, deltas, s, self._order()), s, deletes, self._order())
        return rows if order else rows.select(*s.columns)

    def scan(self, level: int, partition_no: int, version: int | None = None) -> DataFrame:
        """The stored rows of one partition in scan order."""
        rows = self._rows(self._map(version).level(level).get(partition_no, {"data": []})["data"])
        if rows is None:
            raise ValueError("the partition has no rows")
        return rows.orderBy(*ORDER).select(*self.spec.columns)

    def pending(self, version: int | None = None) -> DataFrame | None:
        return self._deltas([x for e in self._map(version).entries() for x in e["deltas"]])

    # maintenance

    def repartition(self, level: int, partition_no: int, roll_children: tuple[int, ...] = (), deletes: bool = True) -> int:
        """Moves a partition's rows to its children one level down, with its deltas applied; deltas without a row go to
        the child of their part_key. Children in roll_children (at the last level only) begin a new generation:
        what they had leaves the map. Nothing to move is no new version."""
        return self._move(level, [partition_no], roll_children, deletes)

    def repartition_level(self, level: int, deletes: bool = True) -> int:
        """Moves all partitions of a level in one version."""
        return self._move(level, [*self._map().level(level)], (), deletes)

    def cascade(self, deletes: bool = True) -> int:
        """Moves level after level, so that all rows are at the last one; the version then."""
        for level in range(self.spec.last_level):
            self.repartition_level(level, deletes)
        return self.versions()[-1]

    def _move(self, level: int, parts: list[int], roll_children: tuple[int, ...], deletes: bool) -> int:
        s = self.spec
        if not 0 <= level < s.last_level:
            raise ValueError("level must be below the last level")
        if roll_children and level + 1 != s.last_level:
            raise ValueError("only partitions of the last level are rolled")
        of = self._map()
        parents = [of.entry(level, p) for p in parts if (e := of.level(level).get(p)) and (e["data"] or e["deltas"])]
        if not parents:
            return of.number
        rows, deltas = self._rows([x for e in parents for x in e["data"]]), self._deltas([x for e in parents for x in e["deltas"]])
        # deltas meet the rows of their own partition only
        own = lambda df, key: df.withColumn("__part", partition_of(key, level, s.spread, s.last_level))
        down = lambda df, key: df.drop("__part").withColumn("partition_no", partition_of(key, level + 1, s.spread, s.last_level))
        new: dict[str, dict] = {"data": {}, "deltas": {}}
        work = f"work/{uuid.uuid4().hex}"
        if rows is not None and deltas is not None:
            rows, deltas, by = own(rows, s.partition_key), own(deltas, "part_key"), ("__part",)
            # the one join of deltas with rows; rows that stay and deltas that go on both follow from it
            matched(rows, deltas, s, self._order(), by).write.parquet(f"{self.path}/{work}")
            found = self.spark.read.parquet(f"{self.path}/{work}")
            rows = apply_matched(rows, found, s, deletes, self._order(), by)
            met = found.select(F.col("__rid").alias("row_id"), F.col("__also___part").alias("__part"))
            deltas = latest(deltas, s, by).join(met, ["row_id", "__part"], "left_anti")
        if rows is not None:
            new["data"] = self._write(down(rows, s.partition_key), "data", level + 1)
        if deltas is not None:
            new["deltas"] = self._write(down(deltas, "part_key"), "deltas", level + 1)
        self.store.delete(work)
        for parent in parents:
            of.count(level, "read", parent["rows"] + parent["delta_rows"], parent["size"] + parent["delta_size"])
            for child in range(s.spread):
                part = parent["partition_no"] * s.spread + child
                e = of.entry(level + 1, part)
                if child in roll_children:
                    e |= {"data": [], "rows": 0, "size": 0, "generation": e["generation"] + 1}
                for kind, written in new.items():
                    if part in written:
                        self._take(e, kind, written[part])
                        of.count(level + 1, "written", *written[part][1:])
            if level == 0:
                parent["consumed"] += len(parent["data"])
            else:
                parent["generation"] += 1
            parent |= {"data": [], "deltas": [], "rows": 0, "size": 0, "delta_rows": 0, "delta_size": 0}
        return self._publish(of)

    def compact(self, level: int | None = None, most: int = 4) -> int:
        """Rewrites the partitions of a level (none: the last) whose rows lie in more than `most` folders into one folder
        each, in scan order; the version then. Pending deltas stay as they are."""
        level = self.spec.last_level if level is None else level
        of = self._map()
        wide = [of.entry(level, p) for p, e in [*of.level(level).items()] if len(e["data"]) > most]
        if not wide:
            return of.number
        rows = self._rows([x for e in wide for x in e["data"]])
        written = self._write(rows.withColumn("partition_no", partition_of(self.spec.partition_key, level, self.spec.spread, self.spec.last_level)), "data", level)
        for e in wide:
            e |= {"data": [], "rows": 0, "size": 0}
            if told := written.get(e["partition_no"]):
                self._take(e, "data", told)
                of.count(level, "compacted", *told[1:])
        return self._publish(of)

    def vacuum(self, keep: int = 2, pin_hours: float = 24) -> int:
        """Drops versions before the last `keep` (1 or more) that no snapshot pins, and folders and level files that no kept
        version names; the number of folders. A pin older than pin_hours is a reader's that died, and counts no more.
        Not while a writer works: its folders aren't named yet."""
        if keep < 1:
            raise ValueError("at least the last version is kept")
        pinned = set()
        for version, when, name in self._pins():
            if time.time() - when > pin_hours * 3600:
                self.store.delete(name)
            else:
                pinned.add(version)
        versions = self.versions()
        kept = {*versions[-keep:], *pinned} & set(versions)
        maps = [self._map(v) for v in kept]
        live = {x for m in maps for e in m.entries() for kind in ("data", "deltas") for x in e[kind]}
        files = {x for m in maps for x in m.told["levels"].values()}
        gone = 0
        for kind in ("data", "deltas"):
            for run in (f"{kind}/{a}/{b}" for a in self.store.names(kind) for b in self.store.names(f"{kind}/{a}")):
                parts = [f"{run}/{x}" for x in self.store.names(run) if x.startswith("partition_no=")]
                dead = [x for x in parts if x not in live]
                for x in dead if len(dead) < len(parts) else [run]:
                    self.store.delete(x)
                gone += len(dead)
        for v in versions:
            if v not in kept:
                self.store.delete(f"map/v={v:012d}.json")
        for x in self.store.names("levels"):
            if f"levels/{x}" not in files:
                self.store.delete(f"levels/{x}")
        self.store.delete("work")
        return gone


class Snapshot:
    """A pinned version."""

    def __init__(self, table: LeveledTable, version: int, pin: str):
        self.table, self.version, self.pin = table, version, pin

    def read(self, **kinds) -> DataFrame:
        return self.table.read(self.version, **kinds)

    def partition_map(self) -> DataFrame:
        return self.table.partition_map(self.version)

    def release(self) -> None:
        self.table.store.delete(self.pin)


def fold_edits(edits: DataFrame) -> DataFrame:
    """Edits (level, partition_no, seq, op, value) of a map, folded: a WRITE sets, an ADD adds to what is there since
    the last WRITE."""
    last = edits.groupBy("level", "partition_no").agg(F.max(F.when(F.col("op") == "WRITE", F.col("seq"))).alias("at"))
    joined = edits.join(last, ["level", "partition_no"]).where(F.col("at").isNull() | (F.col("seq") >= F.col("at")))
    return joined.groupBy("level", "partition_no").agg(F.sum("value").cast("long").alias("value"))

"""Registered queries over the driver's tables, and the same in DuckDB SQL.

The leveled table of most queries is orders, keyed by o_custkey and identified by o_orderkey, S = 4 and L = 2, with a
log of deltas computed from orders: updates, later updates, tombstones, and deltas without a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.packed import pack_deltas, unpack_deltas
from ..functions.routing import child_of, partition_of
from ..operators import deltas as D
from ..operators import programs as P
from ..sources import files
from ..sources.files import table
from ..streaming.ingest import ingest_deltas
from .spec import TableSpec
from .store import shared_root
from .table import LeveledTable, fold_edits

S, L = 4, 2
SPEC = TableSpec("o_custkey", "o_orderkey", ("o_orderstatus", "o_totalprice", "o_orderpriority"), S, L)
MERGE = TableSpec("o_custkey", "o_orderkey", SPEC.payload, S, L, delta_policy="merge")
LINES = TableSpec("l_partkey", "l_orderkey", ("l_quantity", "l_returnflag"), S, L)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*SPEC.columns)


def deltas_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of orders: each row gives the deltas of the rules it meets."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = F.lit(None)

    def delta(group: int, row_id, value_map: int, status, price):
        return F.struct(row_id.alias("row_id"), F.col("o_custkey").alias("part_key"), F.lit(value_map).alias("value_map"), status.cast("string").alias("o_orderstatus"), price.cast("double").alias("o_totalprice"), none.cast("string").alias("o_orderpriority"), (F.lit(group * 1_000_000).cast("long") + key).alias("seq"))

    price = F.col("o_totalprice") + 100
    met = [(key % 5 == 0, delta(0, key, 4, F.lit("X"), none)), (key % 7 == 0, delta(1, key, 8, none, price)), (key % 11 == 0, delta(2, key, 0, none, none)), (key % 13 == 0, delta(3, key + 10_000_000, 8, none, price))]
    return o.select(F.explode(F.filter(F.array(*(F.when(c, d) for c, d in met)), lambda x: x.isNotNull())).alias("d")).select("d.*")


_BASE = "b AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)"
_DELTAS = """d AS (
  SELECT o_orderkey AS row_id, o_custkey AS part_key, 4 AS value_map, 'X' AS o_orderstatus, NULL::DOUBLE AS o_totalprice, NULL::VARCHAR AS o_orderpriority, o_orderkey AS seq FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 8, NULL, o_totalprice + 100, NULL, 1000000 + o_orderkey FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 0, NULL, NULL, NULL, 2000000 + o_orderkey FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, 8, NULL, o_totalprice + 100, NULL, 3000000 + o_orderkey FROM orders WHERE o_orderkey % 13 = 0)"""
_LAST = f"WITH {_BASE}, {_DELTAS}, l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY seq DESC) = 1)"
_APPLIED = """SELECT o_custkey, o_orderkey, CASE WHEN l.value_map & 4 = 4 THEN l.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
  CASE WHEN l.value_map & 8 = 8 THEN l.o_totalprice ELSE b.o_totalprice END AS o_totalprice, b.o_orderpriority
  FROM b LEFT JOIN l ON b.o_orderkey = l.row_id"""
_DELETED = f"{_APPLIED} WHERE l.value_map IS NULL OR l.value_map <> 0"


# routing


@query("SELECT o_orderkey, ((o_custkey // 4) % 4)::INT AS child FROM orders")
def route_child(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", child_of("o_custkey", 0, S, L).alias("child"))


@query("SELECT o_orderkey, ((o_custkey // 16) % 4)::INT AS p0, ((o_custkey // 4) % 16)::INT AS p1, (o_custkey % 64)::INT AS p2 FROM orders")
def route_partition_levels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *(partition_of("o_custkey", k, S, L).alias(f"p{k}") for k in range(L + 1)))


# deltas


@query(f"{_LAST} SELECT * FROM l")
def delta_last_writer_wins(spark, sf_dir):
    return D.latest(deltas_of(spark, sf_dir), SPEC)


def _revived(spark, sf_dir):
    """deltas_of, and an update after the tombstone of every other removed row."""
    log, price = deltas_of(spark, sf_dir), F.col("o_totalprice") + 7
    o = table(spark, sf_dir, "orders").where("o_orderkey % 22 = 0")
    none = F.lit(None).cast("string")
    return log.unionByName(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("part_key"), F.lit(8).alias("value_map"), none.alias("o_orderstatus"), price.alias("o_totalprice"), none.alias("o_orderpriority"), (F.lit(5_000_000).cast("long") + F.col("o_orderkey")).alias("seq")))


@query(f"""WITH {_DELTAS}, e AS (SELECT * FROM d UNION ALL SELECT o_orderkey, o_custkey, 8, NULL, o_totalprice + 7, NULL, 5000000 + o_orderkey FROM orders WHERE o_orderkey % 22 = 0),
  t AS (SELECT *, max(CASE WHEN value_map = 0 THEN seq END) OVER (PARTITION BY row_id) AS gone, max(seq) OVER (PARTITION BY row_id) AS last_ FROM e),
  k AS (SELECT * FROM t WHERE gone IS NULL OR seq > gone OR seq = last_)
  SELECT row_id, arg_max(part_key, seq) AS part_key, bit_or(value_map)::INT AS value_map, arg_max(o_orderstatus, seq) FILTER (WHERE value_map & 4 = 4) AS o_orderstatus,
  arg_max(o_totalprice, seq) FILTER (WHERE value_map & 8 = 8) AS o_totalprice, NULL::VARCHAR AS o_orderpriority, max(seq) AS seq FROM k GROUP BY row_id""")
def delta_column_merge(spark, sf_dir):
    return D.latest(_revived(spark, sf_dir), MERGE)


@query(f"WITH {_DELTAS} SELECT * FROM d")
def packed_delta_entries(spark, sf_dir):
    """The log as packed entries and back."""
    log = deltas_of(spark, sf_dir)
    return unpack_deltas(pack_deltas(log, SPEC), log, SPEC)


@query(f"{_LAST} SELECT x.* FROM ({_APPLIED} WHERE l.value_map <> 0) x")
def delta_apply_update(spark, sf_dir):
    base, log = base_of(spark, sf_dir), deltas_of(spark, sf_dir)
    changed = D.latest(log, SPEC).where("value_map <> 0").select(F.col("row_id").alias("o_orderkey"))
    return D.apply_deltas(base.join(changed, "o_orderkey", "left_semi").select(*SPEC.columns), log, SPEC)


@query(f"{_LAST} {_DELETED}")
def delta_apply_delete(spark, sf_dir):
    return D.apply_deltas(base_of(spark, sf_dir), deltas_of(spark, sf_dir), SPEC)


@query(f"{_LAST} {_APPLIED}")
def delta_plain_variant(spark, sf_dir):
    return D.apply_deltas(base_of(spark, sf_dir), deltas_of(spark, sf_dir), SPEC, deletes=False)


@query(f"{_LAST} SELECT l.*, ((part_key // 4) % 4)::INT AS child FROM l WHERE row_id NOT IN (SELECT o_orderkey FROM b)")
def delta_unmatched_forward(spark, sf_dir):
    return D.unmatched(base_of(spark, sf_dir), deltas_of(spark, sf_dir), SPEC).withColumn("child", child_of("part_key", 0, S, L))


@query("SELECT o_orderkey, (value_map >> 2) & 1 AS status_set, (value_map >> 3) & 1 AS price_set FROM (SELECT o_orderkey, (o_orderkey % 16)::INT AS value_map FROM orders)")
def value_map_bits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).cast("int").alias("value_map"))
    return o.select("o_orderkey", *(F.getbit("value_map", F.lit(k)).cast("int").alias(n) for k, n in ((2, "status_set"), (3, "price_set"))))


# the table


def _path(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark, sf_dir) -> LeveledTable:
    """Version 1: the orders; version 2: their deltas too."""
    made = LeveledTable.create(spark, _path(spark, "orders"), SPEC)
    made.append(base_of(spark, sf_dir))
    made.append_deltas(deltas_of(spark, sf_dir))
    return made


_P = {k: f"((o_custkey // {S ** (L - k)}) % {S ** (k + 1)})::INT" for k in range(L + 1)}
_D = {k: f"((part_key // {S ** (L - k)}) % {S ** (k + 1)})::INT" for k in range(L + 1)}
_REST = "SELECT * FROM l WHERE row_id NOT IN (SELECT o_orderkey FROM b)"


@query(f"""{_LAST}, r AS (SELECT 0 AS level, {_P[0]} AS partition_no, count(*) AS n_rows, 0 AS n_deltas FROM b GROUP BY ALL HAVING {_P[0]} <> 1
  UNION ALL SELECT 0, {_D[0]}, 0, count(*) FROM d GROUP BY ALL HAVING {_D[0]} <> 1
  UNION ALL SELECT 1, {_P[1]}, count(*), 0 FROM ({_DELETED}) WHERE {_P[0]} = 1 GROUP BY ALL
  UNION ALL SELECT 1, {_D[1]}, 0, count(*) FROM ({_REST}) WHERE {_D[0]} = 1 GROUP BY ALL)
  SELECT level, partition_no, sum(n_rows)::BIGINT AS n_rows, sum(n_deltas)::BIGINT AS n_deltas FROM r GROUP BY ALL""")
def repartition_one_level(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.partition_map(t.repartition(0, 1)).where("rows > 0 or delta_rows > 0").select("level", "partition_no", F.col("rows").alias("n_rows"), F.col("delta_rows").alias("n_deltas"))


@query(f"{_LAST} SELECT {_P[1]} AS partition_no, count(*) AS n_rows, true AS has_bytes FROM ({_DELETED}) GROUP BY 1")
def partition_sizes(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.partition_map(t.repartition_level(0)).where("level = 1").select("partition_no", F.col("rows").alias("n_rows"), (F.col("size") > 0).alias("has_bytes"))


@query(f"{_LAST} SELECT 2 AS level, (o_custkey % 64)::INT AS partition_no, count(*) AS n_rows FROM ({_DELETED}) GROUP BY 2")
def cascade_to_leaf(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.partition_map(t.cascade()).where("rows > 0").select("level", "partition_no", F.col("rows").alias("n_rows"))


@query(f"{_LAST} {_DELETED}")
def cascade_then_read(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.read(t.cascade())


@query(f"{_LAST} {_DELETED}")
def merge_on_read(spark, sf_dir):
    return _table(spark, sf_dir).read()


@query(f"{_LAST} SELECT * FROM ({_DELETED}) WHERE o_custkey BETWEEN 20 AND 45")
def read_key_range(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.read(t.cascade(), keys=(20, 45))


@query(f"{_LAST} SELECT {_P[2]} AS partition_no, row_number() OVER (PARTITION BY {_P[2]} ORDER BY o_orderkey) AS place, o_orderkey FROM ({_DELETED})")
def scan_order(spark, sf_dir):
    """The orders lie in the order of o_orderkey; after two moves each leaf still has its rows so."""
    t = _table(spark, sf_dir)
    t.cascade()
    rows = t.read(order=True).withColumn("partition_no", partition_of("o_custkey", L, S, L))
    # a leaf's rows are a bounded part of the table
    return rows.select("partition_no", F.row_number().over(Window.partitionBy("partition_no").orderBy("_batch", "_pos")).cast("long").alias("place"), "o_orderkey")


_LINES_FIRST = """WITH b AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
  SELECT l_partkey, l_orderkey, CASE WHEN rn = 1 AND l_orderkey % 3 = 0 THEN l_quantity + 1000 ELSE l_quantity END AS l_quantity, l_returnflag FROM b"""


def _lines(spark, sf_dir) -> tuple[DataFrame, DataFrame, Column]:
    """lineitem, where row ids (l_orderkey) repeat; deltas for each third row id, made for its first row; the order."""
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    first = lines.groupBy("l_orderkey").agg(F.min_by(F.struct("l_quantity", "l_partkey"), order).alias("x")).where("l_orderkey % 3 = 0")
    log = first.select(F.col("l_orderkey").alias("row_id"), F.col("x.l_partkey").alias("part_key"), F.lit(4).alias("value_map"), (F.col("x.l_quantity") + 1000).alias("l_quantity"), F.lit(None).cast("string").alias("l_returnflag"), F.lit(1).cast("long").alias("seq"))
    return lines, log, order


@query(_LINES_FIRST)
def delta_first_match_only(spark, sf_dir):
    lines, log, order = _lines(spark, sf_dir)
    # rows that the order can't tell apart are told apart by their place in the file
    rows = lines.select(*LINES.columns, "l_linenumber", "l_suppkey", "l_extendedprice", F.monotonically_increasing_id().alias("_pos"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "_pos")
    return D.apply_deltas(rows, log, LINES, first_match=at).select(*LINES.columns)


@query(_LINES_FIRST)
def table_first_match_only(spark, sf_dir):
    lines, log, _ = _lines(spark, sf_dir)
    t = LeveledTable.create(spark, _path(spark, "lines"), LINES)
    t.append(lines.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    t.append_deltas(log)
    return t.read()


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def snapshot_before_deltas(spark, sf_dir):
    """Version 1, read under its pin after the deltas came, were applied and what they left was vacuumed."""
    t = _table(spark, sf_dir)
    with t.snapshot(1) as s:
        t.cascade()
        t.vacuum(keep=1)
        return files.write(s.read(), _path(spark, "snapshot"))


@query("SELECT * FROM (VALUES ('held', 0, 0), ('held', 1, 1), ('held', 2, 0), ('released', 0, 0), ('released', 1, 0), ('released', 2, 0), ('vacuumed', 2, 0)) AS x(step, version, pins)")
def versions_and_pins(spark, sf_dir):
    t = _table(spark, sf_dir)
    with t.snapshot(1) as s:
        seen = [t.roots().withColumn("step", F.lit("held"))]
        s.release()
        seen.append(t.roots().withColumn("step", F.lit("released")))
    t.vacuum(keep=1)
    seen.append(t.roots().withColumn("step", F.lit("vacuumed")))
    return reduce(DataFrame.unionByName, seen).select("step", F.col("version").cast("int").alias("version"), "pins")


@query(f"{_LAST} SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, 1::BIGINT AS n_versions FROM ({_DELETED})")
def vacuum_then_read(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.cascade()
    t.vacuum(keep=1)
    return t.read().agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).join(F.broadcast(t.roots().agg(F.count("*").alias("n_versions"))))


@query(f"""{_LAST}, x AS (SELECT {_P[2]} AS partition_no, count(*) AS n FROM ({_DELETED}) GROUP BY 1), y AS (SELECT {_P[2]} AS partition_no, count(*) AS n FROM b GROUP BY 1)
  SELECT partition_no, (CASE WHEN partition_no = 0 THEN 0 ELSE coalesce(x.n, 0) END + coalesce(y.n, 0))::BIGINT AS n_rows, (partition_no = 0)::INT AS generation
  FROM x FULL JOIN y USING (partition_no) WHERE partition_no < 4""")
def roll_children(spark, sf_dir):
    """The orders come twice; with the second time, leaf 0 begins a new generation."""
    t = _table(spark, sf_dir)
    t.cascade()
    t.append(base_of(spark, sf_dir))
    t.repartition(0, 0)
    t.repartition(1, 0, roll_children=(0,))
    return t.partition_map().where("level = 2 and partition_no < 4 and rows > 0").select("partition_no", F.col("rows").alias("n_rows"), "generation")


@query(f"{_LAST} SELECT {_P[2]} AS partition_no, count(*) AS n_rows, 1 AS folders FROM (SELECT o_custkey FROM ({_DELETED}) UNION ALL SELECT o_custkey FROM b) GROUP BY 1")
def compact_leaves(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.cascade()
    t.append(base_of(spark, sf_dir))
    t.cascade()
    return t.partition_map(t.compact(most=1)).where("level = 2 and rows > 0").select("partition_no", F.col("rows").alias("n_rows"), "folders")


@query("SELECT 0 AS level, ((o_custkey // 16) % 4)::INT AS partition_no, count(*) AS n_rows, 0 AS generation, 0 AS consumed FROM orders GROUP BY 2")
def partition_map_of_version(spark, sf_dir):
    return _table(spark, sf_dir).partition_map(1).select("level", "partition_no", F.col("rows").alias("n_rows"), "generation", "consumed")


@query("SELECT * FROM (VALUES ('created', true), ('opened', true), ('second of a name refused', true), ('other relation refused', true), ('dropped', true)) AS x(step, done)")
def lifecycle(spark, sf_dir):
    """Setting up, opening, the guard of the relation's number, and terminating."""
    path = _path(spark, "lifecycle")

    def refused(f) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    made = LeveledTable.create(spark, path, SPEC)
    steps = [("created", made.versions() == [0]), ("opened", LeveledTable.open(spark, path, 1).spec == SPEC)]
    steps += [("second of a name refused", refused(lambda: LeveledTable.create(spark, path, SPEC))), ("other relation refused", refused(lambda: LeveledTable.open(spark, path, 2)))]
    made.drop()
    steps.append(("dropped", not made.store.exists("spec.json")))
    return spark.createDataFrame(steps, "step string, done boolean")


@query(f"{_LAST} {_DELETED}")
def stream_of_deltas(spark, sf_dir):
    t = LeveledTable.create(spark, _path(spark, "streamed"), SPEC)
    t.append(base_of(spark, sf_dir))
    log = files.write(deltas_of(spark, sf_dir), _path(spark, "delta-files"))
    stream = spark.readStream.schema(log.schema).parquet(log.inputFiles()[0].rpartition("/")[0])
    ingest_deltas(stream, t, _path(spark, "stream-checkpoint"), repartition_every=1).awaitTermination()
    return t.read()


@query("""WITH e AS (SELECT (event_id % 3)::INT AS level, (user_id % 16)::INT AS partition_no, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'WRITE' ELSE 'ADD' END AS op, event_id % 97 AS value FROM events),
  w AS (SELECT level, partition_no, max(seq) FILTER (WHERE op = 'WRITE') AS at_ FROM e GROUP BY 1, 2)
  SELECT level, partition_no, sum(value)::BIGINT AS value FROM e JOIN w USING (level, partition_no) WHERE at_ IS NULL OR seq >= at_ GROUP BY 1, 2""")
def partition_map_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).cast("int").alias("level"), (F.col("user_id") % 16).cast("int").alias("partition_no"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "WRITE").otherwise("ADD").alias("op"), (F.col("event_id") % 97).alias("value"))
    return fold_edits(e)


_COUNTS = f"""{_LAST}, n AS (SELECT (SELECT count(*) FROM b) AS rows_, (SELECT count(*) FROM d) AS deltas, (SELECT count(*) FROM ({_DELETED})) AS kept, (SELECT count(*) FROM ({_REST})) AS rest)"""


@query(f"""{_COUNTS} SELECT 0 AS level, rows_ + deltas AS host_rows, rows_ + deltas AS read_rows, 0::BIGINT AS written_rows, 0::BIGINT AS compacted_rows FROM n
  UNION ALL SELECT 1, 0, kept + rest, kept + rest, 0 FROM n UNION ALL SELECT 2, 0, 0, kept + rest, 0 FROM n""")
def table_stats(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.cascade()
    return t.stats().select("level", "host_rows", "read_rows", "written_rows", "compacted_rows")


@query("""SELECT * FROM (VALUES (0, true, true, false, false, true), (1, false, true, true, false, true), (2, false, false, true, true, true)) AS x(level, host, read, written, compacted, map)""")
def level_io_stats(spark, sf_dir):
    """Which levels have bytes of which kind, after two cascades and a compaction; amplification is host and all else."""
    t = _table(spark, sf_dir)
    t.cascade()
    t.append(base_of(spark, sf_dir))
    t.cascade()
    t.compact(most=1)
    return t.stats().where("write_amplification > 1").select("level", *((F.col(f"{c}_bytes") > 0).alias(c) for c in ("host", "read", "written", "compacted", "map")))


# programs


@query("SELECT * FROM lineitem WHERE l_orderkey = 100")
def key_finder(spark, sf_dir):
    return P.key_finder(table(spark, sf_dir, "lineitem"), "l_orderkey", 100)


@query("SELECT * FROM lineitem WHERE l_suppkey = 3 AND l_linenumber = 2")
def key_finder_two(spark, sf_dir):
    return P.key_finder_two(table(spark, sf_dir, "lineitem"), "l_suppkey", 3, "l_linenumber", 2)


@query("SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-03-01'")
def shipdate_filter(spark, sf_dir):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-03-01"))
    return P.range_filter(table(spark, sf_dir, "lineitem"), "l_shipdate", low, high).select("l_orderkey", "l_shipdate", "l_quantity")


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'the')")
def grep_documents(spark, sf_dir):
    return P.grep(table(spark, sf_dir, "documents"), "text", "the").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4}')")
def grep_regex(spark, sf_dir):
    return P.grep(table(spark, sf_dir, "documents"), "text", "[0-9]{4}", regex=True).select("doc_id")


@query("SELECT sum(l_partkey)::BIGINT AS sum, max(l_partkey) AS max, min(l_partkey) AS min FROM lineitem")
def stat32(spark, sf_dir):
    return P.stat32(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("SELECT sum(l_partkey)::BIGINT AS sum, max(l_partkey) AS max, min(l_partkey) AS min FROM lineitem WHERE l_returnflag = 'R'")
def filtered_stat32(spark, sf_dir):
    return P.filtered_stat32(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_returnflag") == "R")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def tpch_stat_q1(spark, sf_dir):
    return P.pricing_summary(table(spark, sf_dir, "lineitem"), "1998-09-02")


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01'
  AND l_discount BETWEEN 0.06 - 0.011 AND 0.06 + 0.011 AND l_quantity < 24""")
def tpch_stat_q6(spark, sf_dir):
    return P.revenue_change(table(spark, sf_dir, "lineitem"), "1994-01-01", "1995-01-01", 0.06, 24)


_POINT = [0.25 if k % 2 else -0.25 for k in range(64)]


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_POINT}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_POINT}::DOUBLE[]), vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    return P.knn(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", _POINT, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT * FROM part WHERE p_partkey IN (3, 17, 55, 1000000)")
def point_lookup(spark, sf_dir):
    return P.point_lookup(table(spark, sf_dir, "part"), "p_partkey", [3, 17, 55, 1_000_000])


@query("SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def point_lookup_join(spark, sf_dir):
    probes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part")
    return P.point_lookup(parts, "p_partkey", probes).select(*parts.columns)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY user_id, event_id) AS place FROM events")
def sort_all(spark, sf_dir):
    """Sorted, written, and read back with each row's place in the files: the order is in the result."""
    path = _path(spark, "sorted")
    files.write(P.sort_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"), path)
    rows = files.parquet_in_order(spark, path)
    # a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("scan_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("scan_part").agg(F.count("*").alias("n")).select("scan_part", before.alias("before"))
    return rows.join(starts, "scan_part").select("event_id", "user_id", "event_type", (F.col("before") + F.col("scan_row") + 1).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def queue_head(spark, sf_dir):
    return P.first_smallest(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


def _runs(spark, sf_dir) -> list[DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(0).alias("run_value"))
    return [e, e.where("event_id % 3 = 0").withColumn("run_value", F.lit(1)), e.where("event_id % 9 = 0").withColumn("run_value", F.lit(2))]


_COMPACTED = "SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS run_value FROM events"


@query(_COMPACTED)
def compaction_merge(spark, sf_dir):
    return P.compaction(_runs(spark, sf_dir), "event_id")


@query(f"SELECT (event_id // 250)::INT AS table_no, count(*) AS entries, min(event_id) AS smallest_key, max(event_id) AS largest_key, sum(length(event_id::VARCHAR))::BIGINT AS raw_key_size, sum(length(event_type))::BIGINT AS raw_value_size, count(DISTINCT block)::BIGINT AS num_data_blocks FROM (SELECT *, coalesce(sum(length(event_id::VARCHAR) + length(event_type)) OVER (PARTITION BY event_id // 250 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 512 AS block FROM ({_COMPACTED})) GROUP BY 1")
def sstable_boundaries(spark, sf_dir):
    merged = P.compaction(_runs(spark, sf_dir), "event_id").withColumn("table_no", F.expr("cast(event_id div 250 as int)"))
    return P.table_properties(merged, "table_no", "event_id", "event_type", block=512)


@query("""WITH r AS (SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 9 = 0)
  SELECT count(*) AS num_input_entries, sum(length(event_id::VARCHAR))::BIGINT AS raw_input_key_size, sum(length(event_type))::BIGINT AS raw_input_value_size, count(DISTINCT event_id) AS num_output_entries FROM r""")
def compaction_stats(spark, sf_dir):
    return P.compaction_stats(_runs(spark, sf_dir), "event_id", "event_type")


@query(f"SELECT count(*) AS entries, count(DISTINCT event_id) AS keys, true AS in_order FROM ({_COMPACTED})")
def compaction_split(spark, sf_dir):
    tables = P.split_compaction(_runs(spark, sf_dir), "event_id", 300)
    bounds = P.table_properties(tables, "table_no", "event_id", "event_type")
    other = bounds.select(F.col("table_no").alias("other"), F.col("smallest_key").alias("low"))
    crossed = bounds.join(other, F.col("other") == F.col("table_no") + 1, "left").agg(F.sum("entries").alias("entries"), F.bool_and(F.col("low").isNull() | (F.col("low") > F.col("largest_key"))).alias("in_order"))
    return crossed.crossJoin(F.broadcast(tables.agg(F.countDistinct("event_id").alias("keys")))).select("entries", "keys", "in_order")


def _crc_sql(table_: str, key: str, data: str, polynomial: int) -> str:
    """The checksum byte by byte, by a table of 256 entries that the query makes."""
    return f"""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {polynomial}) ELSE c >> 1 END)) AS t),
  b AS (SELECT {key}, list_transform(regexp_extract_all(hex(encode({data})), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM {table_})
  SELECT {key}, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS crc FROM b, t"""


@query(_crc_sql("documents", "doc_id", "text", 0xEDB88320))
def block_crc32(spark, sf_dir):
    return P.block_checksums(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_crc_sql("events", "event_id", "props", 0x82F63B78))
def block_crc32c(spark, sf_dir):
    return P.block_checksums(table(spark, sf_dir, "events"), "event_id", "props", castagnoli=True)


@query("SELECT 'lang' AS column_name, count(*) FILTER (WHERE lang IS NULL) AS nulls FROM d UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL) FROM d".replace("FROM d", "FROM (SELECT nullif(lang, 'de') AS lang, CASE WHEN n_chars > 100 THEN n_chars END AS n_chars FROM documents)"))
def null_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("de")).alias("lang"), F.when(F.col("n_chars") > 100, F.col("n_chars")).alias("n_chars"))
    return P.null_counts(d)


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS m FROM orders)
  SELECT k AS o_custkey, v AS value, (min(n) - 1)::INT AS first, count(*) AS length FROM s GROUP BY k, v, n - m""")
def run_length(spark, sf_dir):
    return P.run_length(_statuses(spark, sf_dir), "o_custkey", "values")


@query("SELECT event_type, sum(value * 2) AS doubled FROM (SELECT event_type, round(value) AS value FROM events) GROUP BY 1")
def program_udf(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.round("value").alias("value"))
    return P.execute("map_batches", e, lambda pdf: pdf.assign(value=pdf["value"] * 2), "event_type string, value double").groupBy("event_type").agg(F.sum("value").alias("doubled"))


# codecs


def _statuses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("values"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def run_length_decode(spark, sf_dir):
    return P.unpack_runs(P.pack_runs(_statuses(spark, sf_dir), "o_custkey", "values"), "o_custkey").select("o_custkey", F.array_join("values", "").alias("statuses"))


@query("SELECT o_custkey, string_agg((o_orderkey // 4 % 8)::VARCHAR, ',' ORDER BY o_orderkey) AS numbers FROM orders GROUP BY 1")
def hybrid_encode_decode(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.pmod(F.floor(x / 4), F.lit(8))).alias("v"))
    return own.select("o_custkey", F.array_join(C.hybrid_decode(C.hybrid_encode("v", 3), 3).cast("array<string>"), ",").alias("numbers"))


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderkey * 37 AS v, greatest(1, ceil(length(bin(o_orderkey * 37)) / 7.0))::INT AS n FROM orders)
  SELECT k AS o_orderkey, array_to_string(list_transform(range(n), lambda i: printf('%02X', ((v >> (7 * i)::INT) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), '') AS encoded, n AS size, v AS decoded FROM n""")
def varint_codec(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37).alias("v"))
    return o.select("o_orderkey", "v", C.varint_encode("v").alias("e")).select("o_orderkey", F.hex("e").alias("encoded"), C.varint_size("v").alias("size"), C.varint_decode("e").alias("decoded"))


@query("""WITH n AS (SELECT o_orderkey AS k, o_orderkey * 1000003 AS v FROM orders)
  SELECT k AS o_orderkey, array_to_string(list_reverse(regexp_extract_all(printf('%016X', v), '..')), '') AS encoded, v AS decoded, (k % 100 - 50)::BIGINT AS small FROM n""")
def little_endian_codec(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1000003).alias("v"), (F.col("o_orderkey") % 100 - 50).alias("s"))
    return o.select("o_orderkey", C.le_encode("v").alias("e"), C.le_encode("s", 2).alias("t")).select("o_orderkey", F.hex("e").alias("encoded"), C.le_decode("e").alias("decoded"), C.le_decode("t", 2).alias("small"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(hex(encode(p_name)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296)::BIGINT AS hash FROM part")
def byte_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.byte_hash("p_name").alias("hash"))


@query("SELECT doc_id, octet_length(encode(text))::INT AS n_bytes, true AS same, false AS longer FROM documents")
def lz4_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    packed = d.select("doc_id", "raw", C.lz4_compress("raw").alias("block"))
    back = packed.select("doc_id", "raw", F.octet_length("block").alias("n"), C.lz4_decompress("block").alias("back"))
    return back.select("doc_id", F.octet_length("back").alias("n_bytes"), (F.col("back") == F.col("raw")).alias("same"), ((F.octet_length("raw") > 4000) & (F.col("n") > F.octet_length("raw") + 64)).alias("longer"))


# sources and sinks


@query("SELECT 0 AS scan_file, count(*) AS n_rows, max(o_orderkey) AS last_key, true AS in_order FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 1, count(*), max(o_orderkey), true FROM orders WHERE o_orderkey % 2 = 0")
def union_scan(spark, sf_dir):
    """Two folders of files; the place of a row in the scan is that in which it was written."""
    root, o = _path(spark, "union"), base_of(spark, sf_dir)
    paths = [f"{root}/t1", f"{root}/t10"]
    for path, odd in zip(paths, (1, 0)):
        files.write(o.where(f"o_orderkey % 2 = {odd}").sortWithinPartitions("o_orderkey"), path)
    at = F.struct("scan_part", "scan_row")
    found = files.parquet_in_order(spark, *paths).groupBy("scan_file", "scan_part").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.max_by("o_orderkey", at).alias("end"), F.min("o_orderkey").alias("least"), F.min_by("o_orderkey", at).alias("begin"), (F.max("scan_row") + 1).alias("rows"))
    return found.groupBy("scan_file").agg(F.sum("n").alias("n_rows"), F.max("last").alias("last_key"), F.bool_and((F.col("last") == F.col("end")) & (F.col("least") == F.col("begin")) & (F.col("rows") == F.col("n"))).alias("in_order"))


@query("SELECT count(*) AS n_rows, true AS whole FROM lineitem")
def file_extents(spark, sf_dir):
    found = files.extents(table(spark, sf_dir, "lineitem"))
    return found.agg(F.sum("rows").alias("n_rows"), F.bool_and((F.col("block_length") > 0) & (F.col("block_start") >= 0)).alias("whole"))


@query("SELECT 'PAR1' AS head, 4 AS n_bytes")
def raw_read(spark, sf_dir):
    return files.raw(spark, f"{sf_dir}/region.parquet", 0, 4).select(F.decode("content", "UTF-8").alias("head"), F.octet_length("content").alias("n_bytes"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def loaded_scan(spark, sf_dir):
    o = P.load(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _full_lines(spark, sf_dir) -> DataFrame:
    """lineitem with all sixteen fields: the table's eleven, and five made from them."""
    day = F.col("l_shipdate").cast("date")
    made = {"l_shipdate": day, "l_commitdate": F.date_add(day, 3), "l_receiptdate": F.date_add(day, 7), "l_shipinstruct": F.lit("NONE"), "l_shipmode": F.lit("RAIL"), "l_comment": F.concat(F.lit("line "), F.col("l_linenumber"))}
    return table(spark, sf_dir, "lineitem").withColumns(made).select(*(x.split()[0] for x in files.LINE_FIELDS.split(", ")))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity)::BIGINT AS l_quantity, round(l_extendedprice * 100)::BIGINT AS l_extendedprice,
  printf('%.2f', l_discount) AS l_discount, l_returnflag, 'RAIL' AS l_shipmode, 'line ' || l_linenumber AS l_comment, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT + 7 AS l_receiptdate
  FROM lineitem WHERE l_shipdate::DATE >= DATE '1995-01-01' AND l_shipdate::DATE < DATE '1995-03-01'""")
def binary_lineitem_filter(spark, sf_dir):
    """Fixed-width rows: dates are days, prices cents, discount and tax text."""
    days = {c: F.unix_date(c) for c in ("l_shipdate", "l_commitdate", "l_receiptdate")}
    money = {"l_quantity": F.round("l_quantity").cast("long"), "l_extendedprice": F.round(F.col("l_extendedprice") * 100).cast("long")}
    text = {c: F.format_string("%.2f", c) for c in ("l_discount", "l_tax")}
    folder = _path(spark, "binary-lines")
    files.write_fixed_width(_full_lines(spark, sf_dir).withColumns(days | money | text), folder, files.LINE_ROW)
    first, last = (F.unix_date(F.lit(x).cast("date")) for x in ("1995-01-01", "1995-03-01"))
    found = P.range_filter(files.fixed_width(spark, folder, files.LINE_ROW), "l_shipdate", first, last)
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipmode", "l_comment", "l_receiptdate")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_linestatus, l_shipdate::DATE::VARCHAR AS l_shipdate, (l_shipdate::DATE + 3)::VARCHAR AS l_commitdate, 'NONE' AS l_shipinstruct, 'line ' || l_linenumber AS l_comment
  FROM lineitem WHERE l_shipdate::DATE >= DATE '1995-01-01' AND l_shipdate::DATE < DATE '1995-03-01'""")
def delimited_lineitem_filter(spark, sf_dir):
    path = _path(spark, "delimited-lines")
    _full_lines(spark, sf_dir).write.csv(path, sep="|")
    low, high = (F.lit(x).cast("date") for x in ("1995-01-01", "1995-03-01"))
    return P.range_filter(files.delimited(spark, path), "l_shipdate", low, high).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_linestatus", F.col("l_shipdate").cast("string").alias("l_shipdate"), F.col("l_commitdate").cast("string").alias("l_commitdate"), "l_shipinstruct", "l_comment")


@query("SELECT event_type, count(*) AS n, sum(round(value) * 2) AS doubled, (max(event_id) - min(event_id))::BIGINT AS span, length(event_type) AS letters FROM events GROUP BY 1")
def user_functions(spark, sf_dir):
    """A function of a value, one of a group and one that makes rows, registered and called from SQL."""
    def span(x: pd.Series) -> int:
        return int(x.max() - x.min())

    class Letters:
        def eval(self, word: str):
            for x in word:
                yield (x,)

    P.register_function(spark, "sf_twice", lambda x: None if x is None else 2 * x, "udf", "double")
    P.register_function(spark, "sf_span", span, "udaf", "long")
    P.register_function(spark, "sf_letters", Letters, "udtf", "letter string")
    table(spark, sf_dir, "events").createOrReplaceTempView("sf_events")
    return spark.sql("""SELECT e.event_type, e.n, e.doubled, e.span, l.letters FROM
      (SELECT a.event_type, a.n, a.doubled, b.span FROM (SELECT event_type, count(*) AS n, sum(sf_twice(round(value))) AS doubled FROM sf_events GROUP BY event_type) a
       JOIN (SELECT event_type, sf_span(event_id) AS span FROM sf_events GROUP BY event_type) b ON a.event_type = b.event_type) e
      JOIN (SELECT t.event_type, count(*) AS letters FROM (SELECT DISTINCT event_type FROM sf_events) t, LATERAL sf_letters(t.event_type) x GROUP BY t.event_type) l ON e.event_type = l.event_type""")


# set operations


@query("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def union_scan_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.unionByName(o.where("o_orderkey % 2 = 0")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def anti_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")

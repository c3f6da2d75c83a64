"""Single-table programs: filters, search, statistics, nearest neighbours, look-up, sorting, compaction, checksums.

Each takes a DataFrame and returns one; PROGRAMS is the registry by name. Where the source of the idea declares a
program without a body, its meaning here is this module's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checksums import crc32, crc32c


def key_finder(df: DataFrame, field: str, value) -> DataFrame:
    """Rows whose field equals value; pushed down to the scan."""
    return df.where(F.col(field) == value)


def key_finder_two(df: DataFrame, field1: str, value1, field2: str, value2) -> DataFrame:
    return df.where((F.col(field1) == value1) & (F.col(field2) == value2))


def range_filter(df: DataFrame, field: str, low, high) -> DataFrame:
    """Rows with low <= field < high."""
    return df.where((F.col(field) >= F.lit(low)) & (F.col(field) < F.lit(high)))


def grep(df: DataFrame, field: str, text: str, regex: bool = False) -> DataFrame:
    return df.where(F.col(field).rlike(text) if regex else F.col(field).contains(text))


def stat32(df: DataFrame, field: str) -> DataFrame:
    """One row: sum, max and min of a field."""
    return df.agg(F.sum(field).alias("sum"), F.max(field).alias("max"), F.min(field).alias("min"))


def filtered_stat32(df: DataFrame, field: str, condition: Column) -> DataFrame:
    return stat32(df.where(condition), field)


def pricing_summary(lineitem: DataFrame, until: str) -> DataFrame:
    """Sums and means of lineitem by return flag and status, for rows shipped by a day."""
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return lineitem.where(F.col("l_shipdate") <= F.lit(until).cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(price), 2).alias("sum_base_price"),
        F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc_price"),
        F.round(F.sum(price * (1 - discount) * (1 + tax)), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.count("*").alias("count_order"),
    )


def revenue_change(lineitem: DataFrame, begin: str, end: str, discount: float, quantity: float) -> DataFrame:
    """Revenue that dropping a discount would add, for small orders of a period."""
    chosen = range_filter(lineitem, "l_shipdate", F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    chosen = chosen.where(F.col("l_discount").between(discount - 0.011, discount + 0.011) & (F.col("l_quantity") < quantity))
    return chosen.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def knn(df: DataFrame, vector: str, key: str, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to query by Euclidean distance; ties by key. A top-k per task, then one merge."""
    point = F.array(*(F.lit(float(x)) for x in query))
    squares = F.zip_with(F.col(vector), point, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return df.select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def point_lookup(df: DataFrame, key: str, probes: DataFrame | list) -> DataFrame:
    """Rows of the probed keys: a list is pushed down as IN, a DataFrame is joined."""
    if isinstance(probes, list):
        return df.where(F.col(key).isin(probes))
    return df.join(probes.select(key).distinct(), key)


def sort_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """A total order, range-partitioned."""
    return df.orderBy(*order)


def _newest(runs: list[DataFrame], key: str, order: str) -> DataFrame:
    tagged = reduce(DataFrame.unionByName, (run.withColumn(order, F.lit(k)) for k, run in enumerate(runs)))
    values = [c for c in tagged.columns if c not in (key, order)]
    newest = tagged.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v"))
    return newest.select(key, *(F.col(f"v.{c}") for c in values))


def compaction(runs: list[DataFrame], key: str, order: str = "run") -> DataFrame:
    """Sorted runs merged: the newest run's row of each key wins; runs are given oldest first."""
    return _newest(runs, key, order).orderBy(key)


def split_compaction(runs: list[DataFrame], key: str, target_rows: int) -> DataFrame:
    """compaction() with the number of the output table that each row belongs to: about target_rows rows each, by ranges
    of the key, in order. A range is a partition, so each table is what one task has; the ranges come from Spark's own
    sample, and nothing but a count comes to the driver."""
    keys = reduce(DataFrame.unionByName, (run.select(key) for run in runs)).distinct().count()
    merged = _newest(runs, key, "run").repartitionByRange(max(1, -(-keys // target_rows)), key).sortWithinPartitions(key)
    return merged.withColumn("table_no", F.spark_partition_id())


def compaction_stats(runs: list[DataFrame], key: str, value: str) -> DataFrame:
    """One row: entries and raw key and value bytes that go into a compaction, and entries that come out."""
    every = reduce(DataFrame.unionByName, (run.select(key, value) for run in runs))
    per_key = every.groupBy(key).agg(F.count("*").alias("n"), F.sum(_size(key)).alias("k"), F.sum(_size(value)).alias("v"))
    return per_key.agg(F.sum("n").alias("num_input_entries"), F.sum("k").alias("raw_input_key_size"), F.sum("v").alias("raw_input_value_size"), F.count("*").alias("num_output_entries"))


def _size(column: str) -> Column:
    return F.octet_length(F.coalesce(F.col(column).cast("string"), F.lit("")))


def table_properties(df: DataFrame, table: str, key: str, value: str, block: int = 4096) -> DataFrame:
    """Entries, bytes, key bounds and data blocks of each output table. An entry begins in the block that the bytes before
    it in its table have reached, `block` bytes each; tables are bounded, so the running sum is one task's work."""
    before = Window.partitionBy(table).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("__block", F.floor(F.coalesce(F.sum(_size(key) + _size(value)).over(before), F.lit(0)) / block))
    return placed.groupBy(table).agg(
        F.count("*").alias("entries"),
        F.min(key).alias("smallest_key"),
        F.max(key).alias("largest_key"),
        F.sum(_size(key)).alias("raw_key_size"),
        F.sum(_size(value)).alias("raw_value_size"),
        F.count_distinct("__block").alias("num_data_blocks"),
    )


def block_checksums(df: DataFrame, key: str, data: str, castagnoli: bool = False) -> DataFrame:
    return df.select(key, (crc32c(F.col(data).cast("binary")) if castagnoli else crc32(data)).alias("crc"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) of every column, in one pass."""
    counted = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("x.*")


def first_smallest(df: DataFrame, key: str, measure: str) -> DataFrame:
    """The row with the least measure, ties by key: a queue's head."""
    return df.agg(F.min(F.struct(measure, key)).alias("x")).select(f"x.{key}", f"x.{measure}")


def runs_of(values: str | Column) -> Column:
    """array<struct<value, first, length>>: runs of equal neighbours (nulls are equal) of an array, within the row."""
    v = F.col(values) if isinstance(values, str) else values
    starts = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(v, i - 1)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda i, k: F.struct(F.get(v, i).alias("value"), i.alias("first"), (F.coalesce(F.get(starts, k + 1), F.size(v)) - i).cast("long").alias("length")))


def run_length(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, value, first, length): runs of equal neighbours in each row's array. Rows with one key stay apart."""
    return df.select(key, F.inline(runs_of(values)))


def pack_runs(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, runs): each row's array as its runs."""
    return df.select(key, runs_of(values).alias("runs"))


def unpack_runs(df: DataFrame, key: str, runs: str = "runs") -> DataFrame:
    """(key, values): the arrays that pack_runs() took apart, row by row."""
    return df.select(key, F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["length"].cast("int")))).alias("values"))


def load(df: DataFrame) -> DataFrame:
    """Holds df's rows in the executors' memory, beyond it on their disks, from their first use until unload()."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def unload(df: DataFrame) -> DataFrame:
    return df.unpersist()


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's program over batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, batches)

    return df.mapInPandas(run, schema)


PROGRAMS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (key_finder, key_finder_two, range_filter, grep, stat32, filtered_stat32, pricing_summary, revenue_change, knn, point_lookup, sort_rows, compaction, split_compaction, table_properties, block_checksums, null_counts, first_smallest, run_length, pack_runs, unpack_runs, compaction_stats, load, unload, map_batches)}


def execute(name: str, df: DataFrame, *args, **params) -> DataFrame:
    """Runs a registered program."""
    return PROGRAMS[name](df, *args, **params)


def register(name: str, program: Callable[..., DataFrame]) -> None:
    if name in PROGRAMS:
        raise ValueError(f"program {name} exists")
    PROGRAMS[name] = program


def register_function(spark: SparkSession, name: str, function, kind: str, returns: str) -> None:
    """Makes a user's function known to SQL by name. kind: "udf" (a value a row, in Arrow batches), "pandas" (a series a
    batch), "udaf" (series of a group to a value), "udtf" (a class whose eval() yields rows)."""
    if kind == "udtf":
        spark.udtf.register(name, F.udtf(function, returnType=returns))
    elif kind == "udf":
        spark.udf.register(name, F.udf(function, returns, useArrow=True))
    elif kind in ("pandas", "udaf"):
        spark.udf.register(name, F.pandas_udf(function, returns))
    else:
        raise ValueError("kind is udf, pandas, udaf or udtf")

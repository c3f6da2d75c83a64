import zlib

import pytest
from pyspark.sql import functions as F

from strataforge.functions import codecs as C
from strataforge.functions.checksums import crc32c_all, crc32c_of
from strataforge.operators import programs as P
from strataforge.sources import files


def test_crc32c_known_value():
    assert crc32c_of(b"123456789") == 0xE3069283


def test_crc32c_of_any_length():
    import random

    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    r = random.Random(2)
    values = [r.randbytes(n) for n in (0, 1, 3, 511, 512, 513, 1024, 5000, 0, 77)]
    assert crc32c_all(values).tolist() == [*map(slow, values)]


def test_checksums(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "k long, t string")
    assert [r.crc for r in P.block_checksums(df, "k", "t").orderBy("k").collect()] == [zlib.crc32(b"abc"), None, 0]
    assert [r.crc for r in P.block_checksums(df, "k", "t", castagnoli=True).orderBy("k").collect()] == [crc32c_of(b"abc"), None, 0]


def test_key_filter_is_pushed_down(spark, tmp_path):
    spark.range(100).withColumn("x", F.col("id") * 2).write.parquet(f"{tmp_path}/t")
    plan = P.key_finder(spark.read.parquet(f"{tmp_path}/t"), "id", 5).select("x")._jdf.queryExecution().toString()
    assert "EqualTo(id,5)" in plan


def test_newest_run_wins(spark):
    runs = [spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")], [(3, None)])]
    assert [tuple(r) for r in P.compaction(runs, "k").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_split_tables_follow_each_other(spark):
    made = P.split_compaction([spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))], "k", 250)
    bounds = P.table_properties(made, "table_no", "k", "v").orderBy("table_no").collect()
    assert 3 <= len(bounds) <= 4 and sum(r.entries for r in bounds) == 1000
    assert all(a.largest_key < b.smallest_key for a, b in zip(bounds, bounds[1:]))


def test_runs_round_trip(spark):
    df = spark.createDataFrame([(1, [5, 5, 7, 5]), (1, [5, 5]), (2, []), (3, None), (4, [None, None, 1])], "k long, values array<int>")
    back = P.unpack_runs(P.pack_runs(df, "k", "values"), "k")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert sorted(tuple(r) for r in P.run_length(df.where("k = 1"), "k", "values").collect()) == [(1, 5, 0, 2), (1, 5, 0, 2), (1, 5, 3, 1), (1, 7, 2, 1)]


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in numbers], "v long").select("v", C.varint_encode("v").alias("e"), C.le_encode("v").alias("w"), C.le_encode("v", 3).alias("n"))
    for r in df.select("*", C.varint_decode("e").alias("a"), C.le_decode("w").alias("b"), C.varint_size("v").alias("size"), C.le_decode("n", 3).alias("c")).collect():
        assert r.a == r.b == r.v and len(r.e) == r.size and bytes(r.w) == r.v.to_bytes(8, "little", signed=True)
        assert r.c == int.from_bytes((r.v % 2**24).to_bytes(3, "little"), "little", signed=True)
    texts = [b"", b"a", bytes(range(256)) * 9, None]
    df = spark.createDataFrame([(x,) for x in texts], "b binary")
    for r in df.select("b", C.lz4_decompress(C.lz4_compress("b")).alias("back"), C.byte_hash("b").alias("h")).collect():
        want = None if r.b is None else 0
        for x in r.b or b"":
            want = (want * 31 + x) % 2**32
        assert r.back == r.b and r.h == want


def test_hybrid_runs():
    import random

    import numpy as np

    r = random.Random(1)
    for width in (1, 3, 8, 13):
        for _ in range(60):
            values = np.array([x for _ in range(r.randint(0, 12)) for x in [r.randrange(1 << width)] * r.choice((1, 1, 2, 7, 8, 9, 40))], np.int64)
            assert C.hybrid_values(C.hybrid_bytes(values, width), width, len(values)).tolist() == values.tolist()
    assert C.hybrid_bytes(np.array([4] * 100), 3) == bytes([200, 1, 4])
    assert C.hybrid_bytes(np.arange(8), 3) == bytes([3, 0b10001000, 0b11000110, 0b11111010])


def test_nearest_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [9.0, 9.0])], "k long, v array<float>")
    assert [r.k for r in P.knn(df, "v", "k", [0.0, 0.0], 2).collect()] == [1, 2]


def test_registry(spark):
    P.register("double", lambda df: df.withColumn("id", F.col("id") * 2))
    assert P.execute("double", spark.range(3)).agg(F.sum("id")).first()[0] == 6
    with pytest.raises(ValueError):
        P.register("double", None)
    del P.PROGRAMS["double"]


def test_fixed_width_delimited_and_ordered_scans(spark, tmp_path):
    (tmp_path / "rows.bin").write_bytes(b"".join(k.to_bytes(4, "little") for k in range(16)))
    found = files.fixed_width(spark, str(tmp_path / "rows.bin"), files.KEY_ROW).orderBy("field0").collect()
    assert [r.field0 for r in found] == [0, 8] and found[1].field7 == 15
    (tmp_path / "t.tbl").write_text("1|a\n2|b\n")
    assert files.delimited(spark, str(tmp_path / "t.tbl"), "k int, v string").agg(F.sum("k")).first()[0] == 3
    for name in ("a/t1", "a/t10", "b/t1"):
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    found = files.parquet_in_order(spark, *(f"{tmp_path}/{x}" for x in ("a/t10", "a/t1", "b/t1", "a/t10"))).orderBy("scan_file", "scan_row").collect()
    assert [(r.scan_file, r.scan_row, r.id) for r in found] == [(a, b, b) for a in range(4) for b in range(3)]
    assert files.raw(spark, str(tmp_path / "rows.bin")).first().length == 64
    assert files.raw(spark, str(tmp_path / "rows.bin"), 4, 2).first().content == b"\x01\0"
    assert files.extents(spark.read.parquet(f"{tmp_path}/a/t1")).agg(F.sum("rows")).first()[0] == 3


def test_binary_rows_round_trip_and_torn_files(spark, tmp_path):
    row = [("a", "u32", 4), ("b", "i32", 4), ("c", "u64", 8), ("d", "text", 6), ("e", "bytes", 2)]
    df = spark.createDataFrame([(2**32 - 1, -5, 2**62, "\u00e9x", b"\0\x01"), (0, 2**31 - 1, 0, "", b"ab")], "a long, b int, c long, d string, e binary")
    assert files.write_fixed_width(df.repartition(1), f"file://{tmp_path}/bin", row) == 1
    found = files.fixed_width(spark, f"{tmp_path}/bin", row).orderBy("a").collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in df.orderBy("a").collect()]
    (tmp_path / "torn.bin").write_bytes(b"x" * 25)
    with pytest.raises(Exception):  # noqa: B017
        files.fixed_width(spark, str(tmp_path / "torn.bin"), row).collect()


def test_functions_of_all_kinds_can_be_registered(spark):
    P.register_function(spark, "sf_test_plus", lambda x: x + 1, "udf", "long")
    assert spark.sql("SELECT sf_test_plus(id) AS x FROM range(2)").agg(F.sum("x")).first()[0] == 3
    with pytest.raises(ValueError):
        P.register_function(spark, "sf_test_bad", None, "view", "long")

"""Rules of routing and deltas on hand-made rows, the stored table, concurrency and crash behaviour."""

import pytest
from pyspark.sql import functions as F

from strataforge.functions.packed import pack_delta, unpack_delta
from strataforge.functions.routing import child_of, partition_of, partitions_between
from strataforge.operators.deltas import apply_deltas, latest, unmatched
from strataforge.plans.spec import TableSpec
from strataforge.plans.table import Conflict, LeveledTable

SPEC = TableSpec("k", "rid", ("v2", "v3"), 4, 2)
BASE = "k long, rid long, v2 string, v3 double"
LOG = "row_id long, part_key long, value_map int, v2 string, v3 double, seq long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def applied(spark, base, log, spec=SPEC, **kinds):
    return rows(apply_deltas(spark.createDataFrame(base, BASE), spark.createDataFrame(log, LOG), spec, **kinds))


def test_routing_digits_and_numbers(spark):
    df = spark.range(64).select("id", child_of("id", 0, 4, 2).alias("c"), *(partition_of("id", k, 4, 2).alias(f"p{k}") for k in range(3)))
    for r in df.collect():
        assert r.c == r.id // 4 % 4 and (r.p0, r.p1, r.p2) == (r.id // 16 % 4, r.id // 4 % 16, r.id % 64)
        assert r.p1 == r.p0 * 4 + r.c


def test_large_keys_route_rows_and_deltas_alike(spark):
    assert spark.createDataFrame([(2**33,)], "id long").select(child_of("id", 0, 4, 2)).first()[0] == 2**33 // 4 % 4


def test_pruned_partitions_hold_every_key():
    for low in range(0, 150, 7):
        for high in range(low, low + 90, 11):
            for level in range(3):
                found = partitions_between(low, high, level, 4, 2)
                want = {k // 4 ** (2 - level) % 4 ** (level + 1) for k in range(low, high + 1)}
                assert found is None or set(found) == want


@pytest.mark.parametrize(
    ("base", "log", "want"),
    [
        ([(5, 1, "a", 1.0)], [(1, 5, 8, None, 9.0, 1)], [(5, 1, "a", 9.0)]),
        ([(5, 1, None, 1.0)], [(1, 5, 4, "b", None, 1)], [(5, 1, "b", 1.0)]),
        ([(5, 1, "a", 1.0)], [(1, 5, 4, "b", None, 1), (1, 5, 8, None, 9.0, 2)], [(5, 1, "a", 9.0)]),
        ([(5, 1, "a", 1.0), (6, 2, "c", 2.0)], [(1, 5, 0, None, None, 1)], [(6, 2, "c", 2.0)]),
        ([(5, 1, "a", 1.0)], [(1, 5, 0, None, None, 1), (1, 5, 8, None, 9.0, 2)], [(5, 1, "a", 9.0)]),
        ([(5, 1, "a", 1.0)], [(99, 7, 8, None, 9.0, 1)], [(5, 1, "a", 1.0)]),
        ([(5, 1, "a", 1.0)], [(1, 5, 3, "z", 9.0, 1)], [(5, 1, "a", 1.0)]),
        ([(5, 2**40 + 1, "a", 1.0), (5, 1, "b", 1.0)], [(2**40 + 1, 5, 8, None, 9.0, 1)], [(5, 1, "b", 1.0), (5, 2**40 + 1, "a", 9.0)]),
        ([], [(1, 5, 8, None, 9.0, 1)], []),
        ([(5, 1, "a", 1.0)], [], [(5, 1, "a", 1.0)]),
    ],
)
def test_delta_rules(spark, base, log, want):
    assert applied(spark, base, log) == want


def test_plain_variant_keeps_tombstoned_rows(spark):
    assert applied(spark, [(5, 1, "a", 1.0)], [(1, 5, 0, None, None, 1)], deletes=False) == [(5, 1, "a", 1.0)]


def test_only_the_first_of_equal_row_ids_takes_the_delta(spark):
    found = applied(spark, [(5, 1, "a", 1.0), (5, 1, "b", 2.0)], [(1, 5, 8, None, 9.0, 1)], first_match=F.col("v2"))
    assert found == [(5, 1, "a", 9.0), (5, 1, "b", 2.0)]


def test_merge_policy_keeps_each_column(spark):
    spec = TableSpec("k", "rid", ("v2", "v3"), 4, 2, delta_policy="merge")
    log = [(1, 5, 4, "b", None, 1), (1, 5, 8, None, 9.0, 2)]
    assert applied(spark, [(5, 1, "a", 1.0)], log, spec) == [(5, 1, "b", 9.0)]
    assert rows(latest(spark.createDataFrame(log, LOG), SPEC))[0][2] == 8


def test_all_unmatched_deltas_go_on_tombstones_too(spark):
    log = [(k, 7, 0 if k % 2 else 8, None, 1.0, k) for k in range(100, 150)]
    assert unmatched(spark.createDataFrame([(5, 1, "a", 1.0)], BASE), spark.createDataFrame(log, LOG), SPEC).count() == 50


def test_packed_entries_round_trip():
    kinds = {2: "string", 3: "double", 4: "boolean", 5: "int", 6: "binary"}
    values = {2: "é", 3: 1.5, 4: True, 6: b"\x00\x01"}
    data = pack_delta(0b1011100, 7, 2**40, values, kinds)
    assert unpack_delta(data, kinds) == (0b1011100, 7, 2**40, values)
    assert unpack_delta(pack_delta(0, 1, 2, {}, kinds), kinds) == (0, 1, 2, {})


def test_spec_is_checked():
    for bad in ({"spread": 1}, {"last_level": 0}, {"delta_policy": "x"}, {"payload": ("k",)}):
        with pytest.raises(ValueError):
            TableSpec(**({"partition_key": "k", "row_id": "rid", "payload": ("v",)} | bad))


@pytest.fixture
def table(spark, tmp_path):
    made = LeveledTable.create(spark, f"file://{tmp_path}/t", SPEC)
    made.append(spark.createDataFrame([(k, 1000 + k, f"v{k}", float(k)) for k in range(64)], BASE))
    made.append_deltas(spark.createDataFrame([(1000 + k, k, 0 if k % 5 == 0 else 8, None, -1.0, k) for k in range(0, 64, 3)] + [(5000, 9, 4, "w", None, 99)], LOG))
    return made


WANT = sorted(((k, 1000 + k, f"v{k}", -1.0 if k % 3 == 0 else float(k)) for k in range(64) if k % 15), key=repr)


def test_reading_before_during_and_after_moves_is_the_same(table):
    assert rows(table.read()) == WANT
    table.repartition(0, 1)
    assert rows(table.read()) == WANT
    last = table.cascade()
    assert rows(table.read(last)) == WANT
    assert {r.level for r in table.partition_map().where("rows > 0").collect()} == {2}
    assert rows(table.pending()) == [(5000, 9, 4, "w", None, 99)]
    assert [x[0] for x in rows(table.read(keys=(17, 21)))] == [17, 18, 19, 20, 21]
    assert table.stats().where("level = 2").first().written_bytes > 0


def test_map_counts_generations(table):
    table.repartition(0, 0)
    parent, child = (table.partition_map().where(f"level = {a} and partition_no = {b}").first() for a, b in ((0, 0), (1, 0)))
    assert (parent.rows, parent.size, parent.consumed, parent.generation) == (0, 0, 1, 0) and child.generation == 0 and child.rows > 0
    table.repartition(1, 0)
    assert table.partition_map().where("level = 1 and partition_no = 0").first().generation == 1
    table.append(table.spark.createDataFrame([(0, 9000, "n", 0.0)], BASE))
    table.repartition(0, 0)
    table.repartition(1, 0, roll_children=(0,))
    rolled = table.partition_map().where("level = 2 and partition_no = 0").first()
    assert (rolled.generation, rolled.rows) == (1, 1)
    with pytest.raises(ValueError):
        table.repartition(0, 0, roll_children=(1,))


def test_moving_nothing_is_no_version(table):
    table.cascade()
    before = table.versions()
    table.repartition(0, 0)
    assert table.versions() == before


def test_a_pinned_version_outlives_vacuum(table):
    with table.snapshot() as s:
        table.cascade()
        table.vacuum(keep=1)
        assert rows(s.read()) == WANT and s.partition_map().where("level = 0 and rows > 0").count() == 4
    assert table.vacuum(keep=1) > 0
    assert len(table.versions()) == 1 and rows(table.read()) == WANT


def test_unpublished_data_is_invisible_and_removed(table, spark):
    version = table.versions()[-1]
    table._write(spark.createDataFrame([(1, 7777, "lost", 0.0, 9, 0, 1)], BASE + ", _batch long, _pos long, partition_no int"), "data", 0)
    assert rows(table.read()) == WANT and table.versions()[-1] == version
    assert table.vacuum() == 1 and rows(table.read()) == WANT


def test_the_second_of_two_writers_fails(table):
    first, second = table._map(), table._map()
    table._publish(first)
    with pytest.raises(Conflict):
        table._publish(second)


@pytest.mark.parametrize("row", [(-1, 1, "a", 1.0), (None, 1, "a", 1.0), (1, None, "a", 1.0)])
def test_bad_keys_are_rejected(table, spark, row):
    with pytest.raises(Exception, match="must not be null or negative"):
        table.append(spark.createDataFrame([row], BASE))


def test_open_create_drop(table, spark):
    assert LeveledTable.open(spark, table.path, 1).spec == SPEC
    for bad in (lambda: LeveledTable.open(spark, table.path, 2), lambda: LeveledTable.create(spark, table.path, SPEC)):
        with pytest.raises(ValueError):
            bad()
    table.drop()
    assert not table.store.exists("spec.json")


def test_stream_of_deltas(table, spark, tmp_path):
    from strataforge.streaming.ingest import ingest_deltas

    spark.createDataFrame([(1001, 1, 8, None, 77.0, 500)], LOG).write.parquet(f"{tmp_path}/in")
    ingest_deltas(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/cp").awaitTermination()
    assert (1, 1001, "v1", 77.0) in rows(table.read())
    # the same batch again, as after a failure before the stream's own checkpoint: nothing comes twice
    before, pending = table.versions(), rows(table.pending())
    ingest_deltas(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/other-cp").awaitTermination()
    assert table.versions() == before and rows(table.pending()) == pending


def test_merge_policy_since_the_last_tombstone(spark):
    spec = TableSpec("k", "rid", ("v2", "v3"), 4, 2, delta_policy="merge")
    told = lambda log: rows(latest(spark.createDataFrame(log, LOG), spec))[0]
    assert told([(1, 5, 4, "b", None, 1), (1, 5, 0, None, None, 2), (1, 5, 8, None, 9.0, 3)]) == (1, 5, 8, None, 9.0, 3)
    assert told([(1, 5, 8, None, 9.0, 1), (1, 5, 0, None, None, 2)]) == (1, 5, 0, None, None, 2)
    assert told([(1, 5, 0, None, None, 1), (1, 5, 1, "z", None, 2)]) == (1, 5, 1, None, None, 2)
    assert applied(spark, [(5, 1, "a", 1.0)], [(1, 5, 4, "b", None, 1), (1, 5, 0, None, None, 2), (1, 5, 8, None, 9.0, 3)], spec) == [(5, 1, "a", 9.0)]


def test_the_first_row_in_scan_order_takes_the_delta_before_and_after_moves(spark, tmp_path):
    t = LeveledTable.create(spark, f"file://{tmp_path}/dup", SPEC)
    t.append(spark.createDataFrame([(5, 1, "z", 1.0), (5, 2, "k", 0.0), (5, 1, "a", 2.0)], BASE).coalesce(1))
    t.append(spark.createDataFrame([(5, 1, "b", 3.0)], BASE))
    t.append_deltas(spark.createDataFrame([(1, 5, 8, None, 9.0, 1), (2, 5, 0, None, None, 2)], LOG))
    want = rows(spark.createDataFrame([(5, 1, "z", 9.0), (5, 1, "a", 2.0), (5, 1, "b", 3.0)], BASE))
    assert rows(t.read()) == want
    t.cascade()
    assert rows(t.read()) == want
    assert [r.v2 for r in t.scan(2, 5).collect()] == ["z", "a", "b"]
    assert t.store.names("data") == ["level=0", "level=1", "level=2"]


def test_compaction_keeps_rows_order_and_deltas(table, spark):
    for k in range(3):
        table.append(spark.createDataFrame([(9, 8000 + k, "late", 0.0)], BASE))
        table.cascade()
    before, pending = rows(table.read()), rows(table.pending())
    table.compact(most=1)
    assert rows(table.read()) == before and rows(table.pending()) == pending
    assert table.partition_map().where("level = 2 and rows > 0").agg(F.max("folders")).first()[0] == 1
    assert [r.rid for r in table.scan(2, 9).collect()][-3:] == [8000, 8001, 8002]
    assert table.stats().where("level = 2").first().compacted_rows == table.partition_map().where("level = 2 and partition_no = 9").first().rows
    version = table.versions()[-1]
    assert table.compact(most=1) == version


def test_a_dead_reader_does_not_hold_its_version_for_good(table):
    held = table.snapshot()
    held.__enter__()
    table.cascade()
    table.vacuum(keep=1)
    assert len(table.versions()) == 2
    table.vacuum(keep=1, pin_hours=-1)
    assert len(table.versions()) == 1 and rows(table.read()) == WANT
    with pytest.raises(ValueError):
        table.vacuum(keep=0)

"""The pipeline's stages, each against plain Python over its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataforge.llm.common import documents, stored
from strataforge.llm.packing import pack
from strataforge.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import plain_groups, plain_measures, plain_spans

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def test_stages(spark):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    docs = documents(spark, DIR)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), "stage")
        seen.append(docs)
    given = {r.doc_id: r for r in documents(spark, DIR).collect()}
    lang, good, single, clean, packed = seen
    assert all(x.columns == columns for x in seen[:-1])
    assert {r.doc_id for r in lang.collect()} == {k for k, r in given.items() if any(c.isalpha() for c in r.text)}
    kept = {r.doc_id for r in good.collect()}
    for r in lang.collect():
        words, _, _, _, repeated = plain_measures(r.text)
        assert not (words < 50 or 100 * repeated > 50 * words) or r.doc_id not in kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert all(k in kept for k, q in labels.items() if q == 1 and plain_measures(given[k].text)[0] >= 50)
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    _, roots = plain_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k].doc_id for k in roots})
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not plain_spans(before[r.doc_id]))
    assert {r.doc_id for r in packed.collect()} == set(before)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content_digest string, __language string, __score double, lang_pred string, score string, row string, spans string, stay_id long, digest long, root long, own long, known string, n_words string, block long, length string"


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and keys, and columns named as the stages'
    own, each with a value that must come through."""
    prose = [" ".join(f"{'the and of to in is a that it for'.split()[(k * k + j) % 10]} word{(k * 91 + j * j) % 977}" for j in range(90)) for k in range(8)]
    texts = [*enumerate(prose), (0, "other text of a repeated key " + prose[7][:600]), (20, None), (21, ""), (22, "   \n"), (None, prose[1] + " the end of it"), (None, None), (23, " ".join(f"the stone{k % 4999} of river{k % 5003}" for k in range(40_000)))]
    texts += [texts[2], texts[2], (24, prose[3]), (25, f"{prose[4]} password=abcdef0123456789 and {prose[5]}")]
    clash = ("cd", "la", 0.5, "lp", "sc", "ro", "sp", 7, 8, 9, 10, "kn", "nw", 11, "le")
    rows = [(k, t, (None, "en")[j % 2], None if j % 3 else "src", None if j % 4 == 0 else len(t or ""), *clash) for j, (k, t) in enumerate(texts)]
    # a repeated row is equal in all its columns
    rows[-4] = rows[-3] = rows[2]
    return spark.createDataFrame(rows, SCHEMA), clash


def test_stages_on_odd_rows(spark):
    docs, clash = odd_rows(spark)
    given = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = [tuple(r) for r in out.collect()]
        assert all(r[5:] == clash for r in rows), name
        if name == "language ID":
            assert sorted(map(repr, rows)) == sorted(repr(r) for r in given if r[1] and any(map(str.isalpha, r[1])))
        elif name == "quality rules":
            assert all(r in given for r in rows) and not any(r[0] in (20, 21, 22) for r in rows) and sum(r == given[2] for r in rows) == 3
        elif name == "near-duplicates":
            assert all(r in given for r in rows)
            _, roots = plain_groups([r[1] for r in given])
            assert len(rows) == len({*roots})
            # of each group the least key, nulls first
            whole = lambda r: (r[0] is not None, r[0] or 0)
            least = sorted(min(whole(given[k]) for k in range(len(given)) if roots[k] == root) for root in {*roots})
            assert sorted(map(whole, rows)) == least
        else:
            plain = lambda r: (r[0], *r[2:4], *r[5:])
            assert sorted(map(repr, map(plain, rows))) == sorted(map(repr, map(plain, given)))
            assert sorted(repr(r) for r in rows if r[0] != 25) == sorted(repr(r) for r in given if r[0] != 25)
            (mine,) = (r for r in rows if r[0] == 25)
            assert "[SECRET]" in mine[1] and "abcdef0123456789" not in mine[1] and mine[4] == len(mine[1])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, DIR)
    assert packed.where("piece = 0").count() == len(given)


def test_stages_take_few_rows_and_short_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    docs = spark.createDataFrame([(k, "some words of a text " * (k % 7) + str(k)) for k in range(300)], "doc_id long, text string")
    found = lambda rows: sorted(tuple(r)[:5] for r in rows.collect())
    try:
        spark.conf.set(name, "10000")
        whole = pack(docs)
        packed = corpus_pipeline.best_fit_packing(spark, docs, "")
        assert spark.conf.get(name) == "1000" and found(packed) == found(whole) == found(pack(docs, step=50))
        assert packed.select("sequence_id").distinct().count() == whole.select("sequence_id").distinct().count()
        spark.conf.set(name, "77")
        corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit("en")), "")
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, own)


def test_stages_on_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DIR).count() == 0


def test_stages_without_labels(spark):
    docs, _ = odd_rows(spark)
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), DIR).count() == 0


def test_near_duplicates_dealt_by_key(spark, monkeypatch):
    """The way for more rows than may be broadcast gives the same rows."""
    from strataforge.llm import common, secret_scan, simhash

    docs, _ = odd_rows(spark)
    ways = []
    for most in (100_000, 0):
        for module in (common, secret_scan, simhash):
            monkeypatch.setattr(module, "MARKS", most)
        ways.append([sorted(repr(tuple(r)) for r in stage(spark, docs, DIR).collect()) for _, stage in corpus_pipeline.STAGES[2:4]])
    assert ways[0] == ways[1]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    from tests.test_oracle import compare

    compare(spark, QUERIES[name], ORACLE_SQL[name])

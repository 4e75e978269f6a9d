import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_op3_jaccard_join import brute as brute_links
from test_op7_suffix_dedup import brute as brute_repeats

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [sorted(d.collect(), key=lambda r: r.doc_id) for d in out], [d.columns for d in out]


def test_columns(steps):
    _, columns = steps
    assert all(c == columns[0] for c in columns[:-1])


def test_language_keeps_prose(steps):
    (before, after, *_), _ = steps
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert not [r for r in before if r.doc_id in gone and any(c.isalpha() for c in r.text or "")]


def test_one_of_each_group_stays(steps):
    (_, before, after, *_), _ = steps
    ids = [r.doc_id for r in before]
    want = {ids[c] for c, _, _ in brute_links([r.text for r in before]).values()}
    assert [r.doc_id for r in after] == sorted(want) and len(after) < len(before)


def test_repeats_go(steps):
    (_, _, before, after, *_), _ = steps
    want = brute_repeats([r.text for r in before], 200)
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    for r, b, (size, gone, _, _) in zip(after, before, want):
        assert r.n_chars == len(r.text) if gone else r == b
        assert size - gone - 6 * gone // 200 - 6 <= len(r.text.encode()) <= size - gone


def test_mix_and_encoding(steps):
    (_, _, _, before, mixed, encoded), _ = steps
    times = Counter(r.doc_id for r in mixed)
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in before}
    assert [r.doc_id for r in encoded] == [r.doc_id for r in mixed] and all(r.round_trip and len(r.ids) == r.n_pieces for r in encoded)


def test_run_and_empty(spark, steps, tmp_path):
    assert sorted(r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()) == [r.doc_id for r in steps[0][-1]]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_other_columns_are_carried_whatever_their_names(spark):
    """Names that the stages use themselves, in the tables that each stage gets."""
    names = ["key", "of", "own", "gone", "copies", "copy", "sha", "new", "rid", "class", "language", "p", "xx", "size", "rate", "carried", "part", "_key", "Text2"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    more = [(None, None, None, None, None), (None, "", "en", "a", 0), (-5, "two words", None, None, 9), (-5, "two words", None, None, 9), (-5, "other words here", None, None, 16)]
    wide = wide.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[n] is None if r.key is None else r[n] == f"{n}-{r.doc_id}" for n in names), name
    left = sorted((r.doc_id, r.text) for r in dict(cp.STAGES)["jaccard_join"](spark, wide, SF).where("key is null").collect() if r.doc_id)
    assert left == [(-5, "other words here"), (-5, "two words")]


def test_stages_leave_the_tables_of_others(spark, tmp_path):
    from sievework.scratch import materialize

    mine = materialize(spark.range(5), "mine")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).count()
    assert mine.count() == 5

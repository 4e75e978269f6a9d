import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import trigrams
from sievework.operators.paging import Key, deep_page


def test_search_on_the_index_is_the_scan(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 6)))
    rows = [(r.randint(-10, 300_000), " ".join(word() for _ in range(r.randint(0, 4))).title()) for _ in range(800)] + [(1, None), (None, "abc"), (5, "100% sure_thing"), (6, "100 sure thing"), (7, "ﬁn İab"), (8, "aaaaaa")]
    texts, path = spark.createDataFrame(rows, "key long, text string"), str(tmp_path / "index")
    trigrams.add_texts(texts.where("key % 2 = 0 or key is null"), path)
    trigrams.add_texts(texts.where("key % 2 <> 0"), path)
    for q in ("abc", "ABCé", "a b", "0% s", "e_t", "", "a", "ab", "aaaa", "zzzz", "abcabc", "bca"):
        want = sorted({k for k, t in rows if k is not None and t is not None and q.lower() in t.lower()})
        got = sorted(x.key for x in trigrams.search(texts, path, q).collect() if x.key is not None)
        assert got == want, q


def test_changed_texts_need_no_deletes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "key long, text string")
    path = str(tmp_path / "index")
    trigrams.add_texts(frame([(1, "clinic"), (2, "clinic one")]), path)
    trigrams.add_texts(frame([(1, "school"), (3, "my clinic")]), path)
    now = frame([(1, "school"), (2, "clinic one"), (3, "my clinic")])
    found = lambda p, q: sorted(r.key for r in trigrams.search(now, p, q).collect())
    assert found(path, "clinic") == [2, 3] and found(path, "school") == [1]
    trigrams.compact(now, path, f"{path}-2")
    assert found(f"{path}-2", "clinic") == [2, 3] and sorted(r.key for r in trigrams.find_keys(spark, f"{path}-2", "clinic").collect()) == [2, 3]
    with pytest.raises(ValueError, match="another path"):
        trigrams.compact(now, path, path)


def test_a_search_reads_its_own_trigrams(spark, tmp_path):
    path = str(tmp_path / "index")
    trigrams.add_texts(spark.range(3000).selectExpr("id as key", "concat('lead number ', id) as text"), path)
    found = trigrams.find_keys(spark, path, "777")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan.split("PartitionFilters")[1] and plan.count("FileScan") == 1 and "EqualTo(gram,777)" in plan and "ReadSchema: struct<gram:string,block:bigint,keys:array<int>>" in plan, plan
    assert sorted(r.key for r in found.collect()) == [777, 1777, 2777]
    assert trigrams.find_keys(spark, path, "77") is None and trigrams.find_keys(spark, path, "x77").count() == 0


def brute(rows, keys, number, size):
    for i, down in reversed(keys):
        none = [r for r in rows if r[i] is None]
        rows = sorted((r for r in rows if r[i] is not None), key=lambda r: r[i].encode() if isinstance(r[i], str) else r[i], reverse=down) + none
    return rows[(number - 1) * size : number * size]


@pytest.mark.parametrize("keys", [[("hot", True)], [("hot", False)], [("name", True)], [("name", False)], [("x", False)], [("same", True), ("name", False)]])
def test_deep_pages(spark, keys):
    """Ties of a third of the rows, nulls, texts with long common beginnings, pages over ranges, against sorting everything."""
    r = random.Random(2)
    rows = [(i, r.choice([0, 0, None, 5, r.randint(0, 50)]), r.choice(["Common beginning of " + str(r.randint(0, 900)), "é" * r.randint(0, 9), None, "z"]), r.random() * 10 - 5, "one") for i in range(3000)]
    names = ["id", "hot", "name", "x", "same"]
    df = spark.createDataFrame(rows, "id long, hot int, name string, x double, same string").cache()
    own = [Key(c, d) for c, d in keys] + [Key("id")]
    for number, size in ((1, 7), (20, 25), (61, 20), (300, 10), (301, 10)):
        got = [tuple(x) for x in deep_page(df, own, number, size, most=100).collect()]
        assert got == brute(rows, [(names.index(c), d) for c, d in keys] + [(0, False)], number, size), (number, size)
    df.unpersist()


def test_page_ten_thousand(spark):
    df = spark.range(300_000).select("id", (F.col("id") % 7).alias("followers"))
    got = [r.id for r in deep_page(df, [Key("followers", True), Key("id")], 10_000, 25, most=5000).collect()]
    order = sorted(range(300_000), key=lambda i: (-(i % 7), i))
    assert got == order[249_975:250_000]
    with pytest.raises(ValueError):
        deep_page(df, [Key("id")], 0, 5)


def test_postings_are_sets_made_in_one_shuffle(spark):
    far = trigrams.BLOCK + 5
    texts = spark.createDataFrame([(1, "ABCABC"), (1, "abcabc"), (1, "xabc"), (far, "abc"), (2, "ab"), (3, None), (None, "abc"), (4, "")], "key long, text string")
    out = trigrams.postings(texts)
    assert sorted((r.gram, r.block, r.n, r["keys"]) for r in out.collect()) == [("abc", 0, 1, [1]), ("abc", 1, 1, [5]), ("bca", 0, 1, [1]), ("cab", 0, 1, [1]), ("xab", 0, 1, [1])]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Generate explode") == 1
    first = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert first.count("Exchange hashpartitioning") == 1

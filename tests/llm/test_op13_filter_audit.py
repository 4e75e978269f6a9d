import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from sievework.llm import filter_audit as fa

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Document by document, order by order."""
    marks = defaultdict(set)
    for d, q, t in labels:
        marks[d] |= ({"good"} if q == 1 else set()) | ({"toxic"} if t == 1 else set())
    counts = defaultdict(Counter)
    for doc_id, text, part in docs:
        x, part = text or "", part or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        later = doc_id is not None and any((t or "") == x and d is not None and d < doc_id for d, t, _ in docs)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": later}
        mine = marks[doc_id] if doc_id is not None else set()
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = counts[part, order, step]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                now = not gone and fails[f]
                c["removed"] += now
                c["good_lost"] += now and "good" in mine
                c["toxic_lost"] += now and "toxic" in mine
                gone |= fails[f]
                c["kept"] += not gone
    worth = Counter()
    for (part, order, step), c in counts.items():
        worth[part, order[step - 1]] += c["removed"]
    return {k: (*(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), worth[k[0], k[1][k[2] - 1]]) for k, c in counts.items()}


def got(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_edges(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns of clashing names."""
    long = " ".join(f"w{i}" for i in range(5000))
    docs = [(1, None, "en"), (2, "", "en"), (3, "A#", None), (3, "A#", None), (None, "A#", "en"), (None, long, "de"), (4, long, "de"), (9, long, "de"), (5, "x " * 300, "de"), (6, "é" * 9 + "A", "fr"), (7, "é" * 8 + "A", "fr"), (8, "a b\x0bc", ""), (8, long + " $", ""), (None, None, None)]
    labels = [(1, 1, None), (3, 0, 1), (3, 1, 0), (None, 1, 1), (9, 1, 1), (77, 1, 1), (5, None, 1)]
    d = spark.createDataFrame([(*r, "x", 5) for r in docs], "doc_id long, text string, lang string, part string, mask int")
    m = spark.createDataFrame([(*r, 1) for r in labels], "doc_id int, quality int, toxic int, good int")
    assert got(fa.replay(fa.document_flags(d, m))) == brute(docs, labels)
    assert got(fa.replay(fa.document_flags(d.repartition(5), m.limit(0)))) == brute(docs, [])
    assert fa.replay(fa.document_flags(d.limit(0), m)).count() == 0


def test_query_and_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    docs, labels = c.sql("select doc_id, text, lang from documents").fetchall(), c.sql("select doc_id, quality, toxic from labels").fetchall()
    df = fa.op13_filter_audit(spark, SF)
    want = brute(docs, labels)
    assert got(df) == want and len(want) == 600 * len({r[2] for r in docs})
    rows = c.execute(f"select {', '.join(df.columns)} from ({fa.OP13_SQL})").fetchall()
    assert sorted(rows) == sorted(map(tuple, df.collect()))


def test_hot_text_and_part_are_spread(spark):
    """Half of all rows share text and part: no task reads more than its share of rows."""
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'same words', concat('text ', id)) as text", "if(id % 3 = 0, 'fr', 'en') as lang")
    flags = fa.document_flags(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert flags.where("mask & 16 = 16").count() == 9_999
    per_task = flags.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert max(per_task) <= 2 * 20_000 / len([n for n in per_task if n])


@pytest.mark.parametrize("letters", ["A", "ABC"])
def test_other_numbers_of_filters(spark, letters):
    flags = spark.createDataFrame([("", m, True, False) for m in range(1 << len(letters))], "part string, mask int, good boolean, toxic boolean")
    out = fa.replay(flags, letters).collect()
    assert len(out) == {1: 1, 3: 18}[len(letters)]
    assert all(r.kept + r.removed + sum(p.removed for p in out if p.filter_order == r.filter_order and p.step < r.step) == 1 << len(letters) for r in out)

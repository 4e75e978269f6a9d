import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import language_id as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return li.train(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 <> 0"))


def brute(rows, model):
    """(language, posterior) by plain loops over (text, declared, suffix, host, domain)."""
    size, out = len(model.languages), []
    ll = [model.score(r[0]) for r in rows]
    soft = []
    for s, n in ll:
        e = [math.exp(x) for x in s]
        soft.append([x / sum(e) if n else 0.0 for x in e])
    total = [sum(p[i] for p in soft) for i in range(size)]
    base = [(t + 1 / size) / (sum(total) + 1) for t in total]
    sums = [defaultdict(lambda: [0.0] * size) for _ in range(4)]
    for r, p in zip(rows, soft):
        for k in range(4):
            sums[k][r[k + 1]] = [a + b for a, b in zip(sums[k][r[k + 1]], p)]
    for r, (s, n), p in zip(rows, ll, soft):
        prior = base
        for k, key in ((3, r[4]), (2, r[3])):
            own = [max(0.0, a - b) if key is not None else 0.0 for a, b in zip(sums[k][key], p)]
            prior = [(own[i] + 5 * prior[i]) / (sum(own) + 5) for i in range(size)]
        own = [[max(0.0, a - b) for a, b in zip(sums[k][r[k + 1]], p)] for k in (0, 1)]
        log = [s[i] + sum(math.log((own[k][i] + 1 / size) / (max(0.0, total[i] - p[i]) + 1)) for k in (0, 1)) + math.log(prior[i]) for i in range(size)]
        e = [math.exp(x - max(log)) for x in log]
        post = [x / sum(e) for x in e]
        top = max(post)
        out.append(("und" if not n or top < 0.5 else model.languages[post.index(top)], top))
    return out


def test_against_brute_force(spark, model):
    r = random.Random(1)
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [None, "", "123 !!", "la", "é" * 50_000]
    rows = [(i, t[:80] if t and i % 2 else t, r.choice(["en", "fr", None]), r.choice(["com", "de", None]), h := r.choice(["a.x.com", "b.x.com", "c.y.de", None]), h and h[2:], 7) for i, t in enumerate(texts)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string, p int").withColumn("language", F.lit(7)).withColumn("carried", F.struct(F.col("p").alias("x"))).withColumn("none", F.lit(None).cast("double"))
    got = sorted((x.key, x.language, x.posterior) for x in li.identify(df, model).collect())
    want = sorted((row[0], *w) for row, w in zip(rows, brute([x[1:6] for x in rows], model)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert {(x.p, x.carried.x, x.none) for x in li.identify(df, model).collect()} == {(7, 7, None)}
    assert li.identify(df.limit(0), model).count() == 0
    assert li.train(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string")) is None
    assert {(x.language, x.rejected) for x in li.identify(df, None).collect()} == {("und", False)}


def test_held_out_accuracy(spark, model):
    held = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0").collect()]
    right = sum(model.languages[int(np.argmax(model.score(r.text)[0]))] == r.lang for r in held if r.text)
    assert right / len(held) > 0.95


def test_page_evidence(spark):
    html = "<!DOCTYPE html><HTML class=x lang='FR-ca'><style>a{}</style><script>var t='</p>';</script><!-- no --><p>Bon&amp;jour</p>"
    df = spark.createDataFrame([(1, "https://u@Blog.Example.ORG:80/fr/x?y", html), (2, None, None), (3, "nonsense", "<p>x")], "page_id long, url string, html string")
    r = {x.page_id: x for x in li.page_evidence(df).collect()}
    assert (r[1].declared, r[1].suffix, r[1].host, r[1].domain, r[1].text.split()) == ("fr", "org", "blog.example.org", "example.org", ["Bon&amp;jour"])
    assert (r[2].declared, r[2].host, r[2].text, r[3].host, r[3].text.strip()) == (None, None, "", None, "x")


def test_query(spark):
    out = li.op5_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert sum(r.language == r.declared for r in out) > 0.9 * len(out) and not any(r.rejected for r in out)


def test_character_references_stand_for_their_characters(spark, model):
    rows = [(1, "le caf&eacute; &#233;tait d&eacute;j&agrave; l&agrave;"), (2, "le café était déjà là")]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "k long, text string, declared string, suffix string, host string, domain string")
    a, b = sorted(li.identify(df, model, entities=True).collect())
    assert a[1:] == b[1:] and li.identify(df, model).where("k = 1").first().n_trigrams != b.n_trigrams


def test_every_language_is_in_the_model(spark, monkeypatch):
    df = spark.createDataFrame([(f"{chr(97 + i % 26)}{i}" * 9, f"l{i:02d}") for i in range(60)], "text string, lang string")
    assert li.train(df).languages == [f"l{i:02d}" for i in range(60)]
    monkeypatch.setattr(li, "MOST_LANGUAGES", 59)
    with pytest.raises(ValueError):
        li.train(df)


def test_unsettled_documents_go_whatever_their_other_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(50).select("*", F.lit(1).alias("key"), F.lit("x").alias("of"), F.lit(2).alias("Gone"), F.lit(3).alias("a.b"))
    junk = spark.createDataFrame([(None, "12 !", None, None), (None, None, "en", "s")], "doc_id long, text string, lang string, source string")
    every = df.unionByName(junk, allowMissingColumns=True)
    out = li.without_unsettled(every)
    assert out.columns == every.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in df.collect() if any(c.isalpha() for c in r.text or ""))

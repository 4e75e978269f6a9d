import zlib

import numpy as np
import pytest

from sievework.llm import quality_rank as q


def auc(score, label):
    good, bad = np.sort(score[label == 1]), score[label == 0]
    return 1 - np.mean([(np.searchsorted(good, b, "left") + np.searchsorted(good, b, "right")) / 2 for b in bad]) / len(good)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_query_on_held_out_labels(spark):
    """Learnt from three quarters of the labels, right on the others."""
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in q.op11_quality_rank(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held_out(d) and 0 < r.score < 1 and r.predicted == int(r.score >= 0.7) for d, r in out.items())
    test = [(out[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(r.doc_id)]
    s, y = (np.array(x) for x in zip(*test))
    right = (s >= 0.7) == y
    assert auc(s, y) > 0.99 and right[y == 1].mean() > 0.95 and right[y == 0].mean() > 0.9


def test_preferences_are_learned():
    """Pairs of hidden scores, one in ten turned round: the order comes back."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    hidden = x @ [3, -2, 1, 0, 0, 0.5]
    a, b = r.integers(0, 400, (2, 5000))
    a, b = a[a != b], b[a != b]
    swap = (hidden[a] < hidden[b]) ^ (r.random(len(a)) < 0.1)
    m = q.fit_preferences(x, np.where(swap, b, a), np.where(swap, a, b))
    assert np.corrcoef(m.raw(x), hidden)[0, 1] > 0.97
    # the gradient of the loss is zero there
    z = np.clip((x - m.mean) * m.scale, -4, 4)
    d = z[np.where(swap, b, a)] - z[np.where(swap, a, b)]
    assert np.abs(q.RIDGE * m.weights - d.T @ (1 / (1 + np.exp(d @ m.weights))) / len(d)).max() < 1e-4


@pytest.mark.parametrize("scores,label,want", [([1, 2, 3, 4], [0, 0, 1, 1], 2.5), ([1, 1, 1], [0, 1, 1], 1 - 1e-9), ([1, 1, 2], [0, 0, 0], 2 + 1e-9), ([5, 1, 2, 1], [1, 0, 0, 1], 3.5)])
def test_threshold(scores, label, want):
    assert q.best_quantile(np.array(scores, float), np.array(label), np.ones(len(scores))) == pytest.approx(want)


def test_labels_of_held_out_rows_and_other_columns_never_matter(spark):
    rows = [(i, ("good words of some length " if i % 2 else "bad! bad! bad! ") * (1 + i % 5), f"l{i % 2}", f"s{i % 2}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = [(i, i % 2) for i in range(80)]
    turned = [(i, 1 - y if held_out(i) else y) for i, y in labels]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    score = lambda d, m: sorted((r.doc_id, r.score) for r in q.score_texts(d, m).collect())
    m = q.fit_labels(docs, frame(labels))
    assert score(docs, m) == score(docs.drop("lang", "source"), q.fit_labels(docs.drop("lang", "source").repartition(7), frame(turned)))
    assert all((s >= 0.7) == bool(d % 2) for d, s in score(docs, m))


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, tables without rows or without one of the labels."""
    rows = [(1, None, 0.1), (1, None, 0.1), (2, "", 0.2), (None, "a", None), (3, "long " * 200_000, 0.3), (4, "word", 0.4), (4, "other word", 0.4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for known in ([], [(3, 1), (4, 1)], [(3, 0)], [(None, 1), (3, None)], [(90, 1), (91, 0)]):
        out = q.score_texts(docs, q.fit_labels(docs, labels(known))).collect()
        assert len(out) == len(rows) and len({r.score for r in out}) == 1 and not any(r.held_out for r in out if r.doc_id is None)
    m = q.fit_labels(docs, labels([(3, 0), (3, None), (4, 1), (4, 0), (None, 0)]))
    out = {r.doc_id: r.score for r in q.score_texts(docs, m).collect()}
    assert out[4] > out[3] and out[1] == out[2]
    assert q.score_texts(docs.limit(0), m).count() == 0 and q.score_texts(docs.limit(0), q.fit_labels(docs.limit(0), labels([(3, 0), (4, 1)]))).count() == 0


def test_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(q, "FIT_DOCS", 50)
    seen = []
    monkeypatch.setattr(q, "fit_preferences", lambda x, a, b: seen.append(len(x)) or q.RankModel(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1])))
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    q.fit_labels(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as quality"))
    assert 60 <= seen[0] <= 150


def test_every_label_teaches(spark, monkeypatch):
    """one labelled row outside of the drawn start changes the model; blocks add up to all pairs where there is one, and the cut is that of all scores."""
    monkeypatch.setattr(q, "FIT_DOCS", 20)
    docs = spark.range(600).selectExpr("id as doc_id", "concat(repeat(concat('w', id % 7, ' '), int(1 + id % 5)), if(id % 3 = 0, 'bad!', 'good')) as text").cache()
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 > 0) as quality")
    m = q.fit_labels(docs, labels)
    for one in [d for d in range(500, 540) if not held_out(d)][:3]:
        other = q.fit_labels(docs, labels.selectExpr("doc_id", f"if(doc_id = {one}, 1 - quality, quality) as quality"))
        assert np.abs(other.weights - m.weights).max() > 1e-3
    rows = [(r.doc_id, r.text) for r in docs.collect() if not held_out(r.doc_id)]
    x = np.stack([q.features(t) for _, t in rows])
    z = np.clip((x - m.mean) * m.scale, -4, 4)
    y = np.array([d % 3 > 0 for d, _ in rows])
    margin = (z[y] @ m.weights)[:, None] - z[~y] @ m.weights
    p = 1 / (1 + np.exp(margin))
    assert np.abs(q.RIDGE * m.weights + (z[~y].T @ p.sum(0) - z[y].T @ p.sum(1)) / p.size).max() < 1e-4
    monkeypatch.setattr(q, "BLOCK_DOCS", 50)
    b = q.fit_labels(docs, labels)
    assert np.corrcoef(b.raw(x), m.raw(x))[0, 1] > 0.99


def test_cut_through_all_scores(spark):
    r = np.random.default_rng(2)
    for n in (1, 5, 3000):
        y = r.integers(0, 2, n)
        s = np.round(r.normal(size=n) + y, 1 if n < 3000 else 3)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
        assert q.best_cut(df) == pytest.approx(q.best_quantile(s, y, np.ones(n)))

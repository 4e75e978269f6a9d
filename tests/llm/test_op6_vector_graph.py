import math
import os

import numpy as np
import pytest

from sievework.llm import vector_graph as vg


def brute(rows, threshold=0.93):
    ok = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            ok[i] = (label, a / np.linalg.norm(a))
    links = {i: [j for j in ok if j != i and i in ok and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= threshold] for i in range(len(rows))}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        low = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((vec_id, len(links[i]), low, low is not None and vec_id == low))
    return sorted(out, key=str)


def corpus(seed, n=500, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = r.normal(size=dim)
        rows.append((len(rows), base.tolist(), i % 3))
        if i % 9 == 0:
            rows += [(len(rows) + k, (base + r.normal(scale=0.08, size=dim)).tolist(), i % 3) for k in range(4)]
    hot = r.normal(size=dim)
    rows += [(len(rows) + k, (hot + r.normal(scale=0.1, size=dim)).tolist(), 1) for k in range(120)]
    return rows


@pytest.mark.parametrize("shard", [1024, 40])
def test_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(vg, "SHARD", shard)
    monkeypatch.setattr(vg, "PER_SHARD", 60)
    rows = corpus(0)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    rows = [(i, np.float32(v).astype(float).tolist(), l) for i, v, l in rows]
    out = vg.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()
    want = {r[0]: r for r in brute(rows)}
    links, there = sum(r.n_links for r in out), sum(w[1] for w in want.values())
    assert there > 10_000 and links <= there and links >= 0.99 * there
    assert np.mean([tuple(r) == want[r.vec_id] for r in out]) > 0.97


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 0), (7, [1.0, None], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0, 0.0], None), (11, [1.0], 0), (3, [1.0, 0.0], 0), (None, [1.0, 0.001], 0), (12, [-1.0, 0.0], 0), (13, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = vg.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)
    assert vg.near_vectors(df.limit(0)).count() == 0


def test_recall_among_the_table_and_near_copies_of_it(spark):
    """Links between different vectors, of the ids divisible by 20 against all rows; the table itself has none."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").where("embedding is not null").collect()
    r = np.random.default_rng(5)
    more = []
    for i, row in enumerate(rows):
        v = np.array(row.embedding, float)
        if i % 10 == 0 and np.isfinite(v).all():
            more += [(10_000_000 + 20 * i + k, (v + r.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * 0.22).tolist(), row.label) for k in range(4)]
    df = spark.createDataFrame([(row.vec_id, [float(x) for x in row.embedding], row.label) for row in rows] + more, "vec_id long, embedding array<double>, label long")
    got, there = vg.audit_recall(df)
    print("recall", got, there)
    assert there > 500 and 0.95 * there <= got <= there


def test_recall_on_the_check_table(spark):
    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no check tables here")
    got, there = vg.audit_recall(spark.read.parquet(path))
    print("recall on check_s", got, there)
    assert there > 0 and 0.95 * there <= got <= there


def test_large_shards_split_and_lose_no_node(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("PER_SHARD", 20), ("CENTROIDS", 4), ("FAN", 4), ("SPLIT_NODES", 50)):
        monkeypatch.setattr(vg, name, value)
    rows = corpus(1, 400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = []
    split = vg.split_shards
    monkeypatch.setattr(vg, "split_shards", lambda shards, n: seen.append((shards, split(shards, n))) or seen[-1][1])
    links = sum(r.n_links for r in vg.near_vectors(df).collect())
    there = sum(w[1] for w in brute(rows))
    before, after = seen[0]
    assert 0.95 * there <= links <= there
    assert {r.node for r in after.where("rank = 0").collect()} == {r.node for r in before.collect()}
    sizes = lambda d: sorted(r["count"] for r in d.groupBy("label", "shard").count().collect())
    assert sizes(after)[-1] < sizes(before)[-1] / 2 and len(sizes(after)) > 3 * len(sizes(before))

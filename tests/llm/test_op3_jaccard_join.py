import random
import re

import numpy as np
import pytest

from sievework.llm import jaccard_join as jj


def brute(texts, words=5, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    n = len(texts)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i].append(j)
                links[j].append(i)
    label = list(range(n))
    for i in range(n):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        label[i] = min(seen)
    text = [next(j for j in range(n) if sets[j] == sets[i]) if sets[i] else i for i in range(n)]
    return {i: (label[i], text[i], len(links[i])) for i in range(n)}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = [" ".join(prose(r.randint(1, 80))) for _ in range(60)] + [None, "", " \n", "one two", "one two", "one  two\n", "a b c d e"]
    for _ in range(6):
        base = prose(120)
        for _ in range(9):
            x = base[:]
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(vocab)
            texts.append(" ".join(x))
    texts += [texts[5]] * 4
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(0, 512), (1, 4)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_NODES", block)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id int, node string")
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in jj.jaccard_join(df).collect()}
    assert got == brute(texts)


def test_dense_and_sparse_verification_agree():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 50, 30).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert jj._shared(sets, i, j).tolist() == want and jj._shared(sets, i[:9], j[:9]).tolist() == want[:9]


def test_posterior_bounds():
    least = jj.fewest_matches(0.8, 1e-9)
    assert list(least) == [32, 64, 96, 128] and 5 < least[32] < 16 and 65 < least[128] < 85
    assert jj.fewest_matches(0.8, 0.01)[128] > least[128]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "z"), (None, "q"), (2, "long " * 60_000)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(df).collect()), key=str)
    assert out == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (1, 1, 0), (None, None, 0), (2, 2, 0)], key=str)
    assert jj.jaccard_join(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    ids = [r.doc_id for r in rows]
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in jj.op3_jaccard_join(spark, sf).collect()}
    assert got == {ids[i]: (ids[c], ids[t], n) for i, (c, t, n) in want.items()}

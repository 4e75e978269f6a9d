import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import suffix_dedup as sd


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=5), st.integers(2, 6))
def test_maximal_repeats_are_all_and_only_those(texts, least):
    strings = [t.encode() for t in texts]
    of, offset, found = sd.repeats_of(strings, [len(s) for s in strings], least)
    got = {(n, frozenset(zip(of[f : z + 1].tolist(), offset[f : z + 1].tolist()))) for n, f, z in found}
    where = defaultdict(set)
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for z in range(a + least, len(s) + 1):
                where[s[a:z]].add((i, a))
    want = set()
    for x, at in where.items():
        before = {strings[i][a - 1] if a else (i, a) for i, a in at}
        after = {strings[i][a + len(x)] if a + len(x) < len(strings[i]) else (i, -1) for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((len(x), frozenset(at)))
    assert got == want


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(length // 2), prose(3 * length)
    near = lambda t: t.replace(r.choice(t.split()), word(), 1)
    texts = [prose(r.randint(0, 200)) for _ in range(30)] + [None, "", "x" * (length - 1), "y" * length, "z" * (3 * length), "ab" * (2 * length), "ab" * length + "c"]
    texts += [prose(9) + " " + passage + " " + prose(20) for _ in range(12)] + [near(long) for _ in range(8)] + [long] * 3 + [passage + passage]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,length,hot", [(0, 200, sd.HOT), (1, 200, 1), (2, 64, sd.HOT)])
def test_against_brute_force(spark, seed, length, hot):
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], "doc_id long, text string, rid int, keys string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest() if r.kept is not None else bytes(r.sha).hex()) for r in sd.remove_repeats(df, length, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_edges(spark):
    t = "q" + "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + "x"), (2, None), (2, "short")], "doc_id long, text string")
    out = sorted((r.n_bytes, r.n_removed) for r in sd.remove_repeats(df).collect())
    assert out == [(0, 0), (5, 0), (301, 301), (301, 301), (302, 301)]
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 200))}
    assert {r[0]: tuple(r)[1:] for r in sd.op7_suffix_dedup(spark, sf).collect()} == want

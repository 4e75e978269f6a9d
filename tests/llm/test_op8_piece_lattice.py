import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import piece_lattice as pl

PATH = public_tokenizers.path("piece_bpe_32k.model")
LAT = pl.lattice(PATH)


def every(text):
    """All segmentations of a text, best first: (score, ids)."""
    def walk(s):
        if not s:
            return [(0.0, ())]
        out = []
        for e in range(1, min(len(s), LAT.longest) + 1):
            for a, w, ids in LAT.edges(s[:e], e):
                if a == 0:
                    out += [(w + x, ids + rest) for x, rest in walk(s[e:])]
        return out
    return sorted(walk(" " + text), key=lambda x: -x[0]) if text else [(0.0, ())]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("the an\nié▁")), max_size=9))
def test_n_best_against_all_segmentations(text):
    want, got = every(text), LAT.encode([text], 4)[0]
    assert [s for s, _ in got] == [s for s, _ in want[: len(got)]] and len(got) == min(4, len(want))
    assert all((s, tuple(ids.tolist())) in want for s, ids in got)
    assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    assert all(LAT.decode(ids) == text for _, ids in LAT.encode([text], 3)[0])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrst hou.")), min_size=1, max_size=30))
def test_batched_lattice_equals_search(text):
    LAT.clear()
    for c in LAT.chunks(text):
        LAT.encode([c[1:]] if c[0] == " " else [text])
        i = LAT.known.get(c)
        if i is not None:
            best = LAT.search(c, 2)
            assert LAT.best[i] == best[0][0] and (len(best) == 1 or LAT.loss[i] == pytest.approx(best[0][0] - best[1][0]))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a  b\n\n c ", 0), (3, "x" * 30_000, 0), (4, "the the", 0), (4, "the the", 0)], "doc_id long, text string, score int")
    rows = pl.encode_pieces(df, PATH, with_ids=True).collect()
    assert len(rows) == 6 and all(r.round_trip for r in rows)
    assert [r.n_pieces for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert pl.encode_pieces(df.limit(0), PATH).count() == 0


def test_query_against_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pl.op8_piece_lattice(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True)
        if len(t) < 1200:
            want = LAT.search(" " + t, pl.N_BEST)
            assert r.nbest_scores == [s for s, _ in want] and r.ids_crc32 == r.nbest_crc32[0]
            same = [zlib.crc32(np.array(ids, "<u4").tobytes()) for s, ids in want if s == want[0][0]]
            assert r.ids_crc32 in same or len(same) > 1


@pytest.fixture(scope="module")
def model():
    """Pieces and scores as the sentencepiece library tells them, without a line of the lattice's own code."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = {m.id_to_piece(i).replace("▁", " "): (i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    fall = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    worst = min(s for _, s in pieces.values() if s > -1e8) - pl.UNKNOWN
    return m, pieces, fall, worst


def viterbi(text, n, pieces, fall, worst):
    """The n best (score, ids) of a whole text, by keeping the n best of every prefix."""
    whole = " " + text
    best = [[(0.0, ())]] + [[] for _ in whole]
    longest = max(map(len, pieces))
    for e in range(1, len(whole) + 1):
        ways = []
        for s in range(max(0, e - longest), e):
            hit = pieces.get(whole[s:e])
            if hit or s == e - 1:
                w, ids = (hit[1], (hit[0],)) if hit else (worst, tuple(fall[b] for b in whole[s].encode()))
                ways += [(x + w, own + ids) for x, own in best[s]]
        best[e] = sorted(ways, key=lambda x: -x[0])[:n]
    return best[-1]


def test_whole_texts_against_an_independent_viterbi_and_the_library(spark, model):
    m, pieces, fall, worst = model
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [r.text for r in rows if r.text and len(r.text) < 3000][:40] + ["x" * 200 + " end", "猫は a▁b", "a" * 45 + "é" * 45, "  two  spaces "]
    for text, got in zip(texts, LAT.encode(texts, 4)):
        want = viterbi(text, 4, pieces, fall, worst)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-6)
        for s, ids in got:
            names = [m.id_to_piece(int(i)) for i in ids]
            assert sum(m.get_score(int(i)) for i in ids if not m.is_byte(int(i))) >= s - 1e-6 and names
            plain = text if "▁" not in text else None
            assert plain is None or m.decode([int(i) for i in ids]).lstrip(" ") == plain.lstrip(" ")

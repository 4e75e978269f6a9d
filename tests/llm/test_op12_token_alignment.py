import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def libraries():
    """Token ids and their bytes, straight from the libraries."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    ranks = {int(i): base64.b64decode(b) for b, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return (lambda x: [(i, ranks[i]) for i in t.encode(" " + x, add_special_tokens=False).ids]), (lambda x: [(i, piece(i)) for i in sp.encode(x)])


def brute(texts):
    """Each text by itself, by ranges of bytes; then the counts over all of them."""
    enc_a, enc_b = libraries()
    each = []
    for text in texts:
        links, groups = [], []
        a, b = (enc_a(text), enc_b(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
            spans = []
            for tokens in (a, b):
                at, out = 0, []
                for i, x in tokens:
                    out.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(out)
            links = [(i, j) for i, p, q in spans[0] for j, r, s in spans[1] if p < s and r < q]
            ends = sorted({q for *_, q in spans[0]} & {s for *_, s in spans[1]})
            for lo, hi in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(i) for i, p, q in side if lo <= p and q <= hi) for side in spans))
            each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            each.append((0, 0, 0, [], ""))
    count = Counter(link for *_, links, _ in each for link in links)
    most = Counter()
    for (i, j), n in count.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, n_groups, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for n_a, n_b, n_groups, links, sha in each]


def by_id(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


TEXTS = [
    None, "", " ", "a", "hello hello the the", "<|endoftext|> </s> <unk>", "  two  spaces\n\nand\ttabs ", "naïve café – 日本語 😀", "a▁b", "x" * 3000, "the " * 700, "٠١ digits", "'s't're", "ﬁ ligature é",
    "0123456789", "ḁ ɐ Ж", "\x00\x01", "Ünïcödé  nbsp ", "the same line", "the same line",
]


def test_edges(spark):
    """Nulls, empty and long texts, special strings, texts whose tokens do not join, repeated rows, clashing columns."""
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, n_a string")
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert sum(w[-1] == "" for w in want) >= 3
    assert by_id(ta.align_tokens(df, A, B)) == want == by_id(ta.align_tokens(df.repartition(7), A, B))
    assert ta.align_tokens(df.limit(0), A, B).count() == 0
    assert by_id(ta.align_tokens(df.where("text is null"), A, B)).total() == 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = sorted(docs, key=lambda r: len(r.text or ""))[:150]
    df = spark.createDataFrame(short)
    assert by_id(ta.align_tokens(df, A, B)) == Counter((r.doc_id, *w) for r, w in zip(short, brute([r.text for r in short])))
    out = by_id(ta.op12_token_alignment(spark, sf))
    assert {x[0] for x in out} == {r.doc_id for r in docs} and out.total() == len(docs)


def test_small_blocks_and_hot_ids_change_nothing(spark, monkeypatch):
    """Every id hot, salted over many parts, with blocks of a few postings, against one part and one block."""
    texts = [f"the {w} the" for w in ("cat", "dog", "cats", "dogs", "the", "then") * 20] + ["the"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = Counter((i, *w) for i, w in enumerate(brute(texts)))
    assert by_id(ta.align_tokens(df, A, B)) == want
    monkeypatch.setattr(ta, "hot_ids", lambda p, n: p.groupBy("b").count().selectExpr("b", "int(3) as salts"))
    assert by_id(ta.align_tokens(df, A, B)) == want


def test_blocks(monkeypatch):
    """What the stream emits adds up to the same, however small its blocks and batches are."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    rows = []
    for b in range(12):
        for chunk in range(4):
            n = int(r.integers(1, 30))
            rows.append((b, 0, chunk, r.integers(0, 9, n).astype("<u2").tobytes(), r.integers(0, 600, n).astype("<u2").tobytes(), r.integers(1, 5, n).astype("u1").tobytes(), None))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("b", pa.int32()), ("salt", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("doc", pa.binary()), ("m", pa.binary()), ("known", kind)])

    def total(size, block):
        monkeypatch.setattr(ta, "BLOCK", block)
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows[i : i + size]], schema=schema) for i in range(0, len(rows), size)]
        out = Counter()
        for x in ta._contributions("<u2")(iter(batches)):
            for y in x.to_pylist():
                for d, p, q in zip(np.frombuffer(y["docs"], "u1"), np.frombuffer(y["best"], "<i8"), np.frombuffer(y["total"], "<i8")):
                    out[y["chunk"], y["part"], int(d), "best"] += int(p)
                    out[y["chunk"], y["part"], int(d), "total"] += int(q)
        return +out

    assert total(5, 1) == total(7, 60) == total(48, 10**9)


_BYTES = ta.ByteTokenizer(A)
_OWN = Tokenizer.from_file(A)
_OWN.encode_special_tokens = True


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(list("the 's\n\t  12<|endoftext|>"))), max_size=60))
def test_quick_ids_are_the_librarys(text):
    assert _BYTES.quick and _BYTES.encode(text).tolist() == _OWN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["日本語 text", "ͅx", "😀😀", "ß" * 5000, "ẞŉ"])
def test_other_letters(text):
    assert _BYTES.encode(text).tolist() == _OWN.encode(text, add_special_tokens=False).ids


def test_hot_ids(spark):
    rows = [(1, 10_000), (1, 10_000), (2, 100)] + [(i, 50) for i in range(3, 200)]
    out = {r.b: r.salts for r in ta.hot_ids(spark.createDataFrame(rows, "b int, n long"), 10).collect()}
    assert out == {1: 14}

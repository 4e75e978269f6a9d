import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=900))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data, index = tf.encode_blocks(ids)
    assert (tf.decode_blocks(data, index, len(ids)) == ids).all()


def test_blocks_use_exceptions_and_narrow_widths():
    ids = np.full(512, 7, np.uint32)
    ids[5] = 40_000
    data, _ = tf.encode_blocks(ids)
    assert len(data) < 2 * 7 + 6 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .,.,!İÉé_3ªǅ\u0345\n")), max_size=40), max_size=4))
def test_stops_and_cases_encode_as_whole_texts(texts):
    t = Tokenizer.from_file(PATH)
    ids, n = tf.encoder(PATH).encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abÉé ñ\n\t\r\u0085 ́'sßΣ19!<|>endoftx\x1c")), max_size=40), max_size=6))
def test_words_encode_as_whole_texts(texts):
    t = Tokenizer.from_file(PATH)
    ids, n = tf.encoder(PATH).encode(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [(5, "Hello World <|endoftext|> ok"), (2, None), (9, "a " * 3000), (None, "last"), (3, ""), (1, "Éá ß\nx")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_files(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, n_tokens long")
    got = sorted((tuple(r) for r in tf.token_files(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_repeated_rows_all_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert tf.token_files(df, PATH).count() == 3


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in tf.op9_token_files(spark, sf).collect()) == sorted(expected(rows))


def test_whole_texts_are_checked():
    enc = tf.encoder(PATH)
    ids, _ = enc.encode(["some words"])
    enc.check_text("some words", ids)
    with pytest.raises(ValueError):
        enc.check_text("other words", ids)


def test_starts_go_on_from_bucket_to_bucket(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_IDS", 20)
    rows = [(i, "a b c " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in tf.token_files(df, PATH).collect()), key=lambda r: r[1]) == expected(rows)

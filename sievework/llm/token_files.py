"""Token-ID / binary output: patched frame-of-reference (PFOR) blocks.

File format, all little-endian, one file for each run of documents in ascending doc_id::

    magic    8 bytes  b"PFORIDS1"
    header   n_ids u64, n_docs u64, n_blocks u64, block length u32, end id u32
    docs     n_docs x (doc_id i64, is_null u8, n_tokens u64)
    index    (n_blocks + 1) x u64, where each block starts, counted from the first block
    blocks   minimum u32, width u8, n_exceptions u16, packed words u64 x (length * width / 64),
             exceptions: positions u16, then whole differences u32

A block holds ``BLOCK`` ids less their minimum, packed at the bit width that ``PERCENTILE`` of them
fit; the others leave zero bits and stand in the exception list. The last block is padded with its
minimum; ``n_ids`` tells where it ends. The index gives direct access to any block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, get_file, partitions, put_file
from sievework.scratch import materialize, new_dir

MAGIC, BLOCK, PERCENTILE, END_ID = b"PFORIDS1", 256, 90, 1
#: A file is closed once it holds so many ids: it bounds what a reader holds.
FILE_IDS = 1 << 20
#: Words a worker remembers before it starts again; a memory bound, without effect on results.
CACHE_WORDS = 1_500_000
#: Bytes of text that are encoded at a time; a memory bound, without effect on results.
SLICE = 1_000_000
#: Texts whose doc_id is divisible by it are encoded by the tokenizer as a whole too, and must give the same ids.
CHECKED = 1009

#: What keeps a text from being lower-cased and divided before it is encoded: characters from U+0250
#: on, the one below whose lower case is two characters, and what may be a special token.
_OTHER = re.compile("[\u0130\u0250-\U0010ffff]|<\\|")

_DOC = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n", "<u8")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) differences below 2**width -> (blocks, BLOCK * width / 64) words."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    column = np.ascontiguousarray(values.T.astype(np.uint64))
    for j in range(BLOCK if width else 0):
        k, s = divmod(j * width, 64)
        words[k] |= column[j] << np.uint64(s)
        if s + width > 64:
            words[k + 1] |= column[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint32)
    column = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        k, s = divmod(j * width, 64)
        v = column[k] >> np.uint64(s)
        if s + width > 64:
            v = v | (column[k + 1] << np.uint64(64 - s))
        out[j] = v & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes, and the index of where each one starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, "<u8")
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    diff = full - low[:, None]
    edge = np.partition(diff, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    width = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.uint8)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    kept = np.where(over, 0, diff)
    parts: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = pack(kept[rows], int(w))
        for i, row in enumerate(rows):
            at = np.flatnonzero(over[row])
            head = low[row].astype("<u4").tobytes() + bytes([int(w)]) + np.uint16(len(at)).astype("<u2").tobytes()
            parts[row] = head + packed[i].astype("<u8").tobytes() + at.astype("<u2").tobytes() + diff[row][at].astype("<u4").tobytes()
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("<u8")


def decode_blocks(data: bytes, index: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(index) - 1
    raw = np.frombuffer(data, np.uint8)
    at = index[:-1].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    field = lambda start, size, kind: raw[(at + start)[:, None] + np.arange(size)].copy().view(kind)[:, 0]
    if not n:
        return out.reshape(-1)
    low, width, n_over = field(0, 4, "<u4"), field(4, 1, "u1"), field(5, 2, "<u2").astype(np.int64)
    for w in np.unique(width):
        rows, size = np.flatnonzero(width == w), BLOCK * int(w) // 8
        words = raw[(at[rows] + 7)[:, None] + np.arange(size)].copy().view("<u8") if w else np.zeros((len(rows), 0), np.uint64)
        out[rows] = unpack(words, int(w))
    for row in np.flatnonzero(n_over):
        k, start = int(n_over[row]), int(at[row]) + 7 + BLOCK * int(width[row]) // 8
        where = np.frombuffer(data, "<u2", k, start)
        out[row, where] = np.frombuffer(data, "<u4", k, start + 2 * k)
    return (out + low[:, None]).reshape(-1)[:n_ids]


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, end_id: int = END_ID) -> bytes:
    docs = np.zeros(len(doc_ids), _DOC)
    docs["doc_id"] = [0 if x is None else x for x in doc_ids]
    docs["is_null"] = [x is None for x in doc_ids]
    docs["n"] = lengths
    blocks, index = encode_blocks(ids)
    head = np.array([len(ids), len(docs), len(index) - 1], "<u8").tobytes() + np.array([BLOCK, end_id], "<u4").tobytes()
    return MAGIC + head + docs.tobytes() + index.tobytes() + blocks


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) as they were given to write_file()."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n_ids, n_docs, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
    at = 40
    docs = np.frombuffer(data, _DOC, n_docs, at)
    index = np.frombuffer(data, "<u8", n_blocks + 1, at + docs.nbytes)
    ids = decode_blocks(data[at + docs.nbytes + index.nbytes :], index, n_ids)
    return [None if x["is_null"] else int(x["doc_id"]) for x in docs], docs["n"].astype(np.int64), ids


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    Sound for tokenizers whose pre-tokens never hold a space, tab or line break and that have no
    context across them; ``check_text`` compares with the tokenizer's own result on whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.clear()
        # the short way is taken only if it gives the tokenizer's own ids on a probe of each kind
        probe = ["abc", "é", "ß", "ÿ", "naïveté", "ɏ", "abcdefghijklmnopqrstuvwxyz", "æðøþœ"]
        self.plain = True
        self.plain = all(self.ids_of(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.mark = np.zeros(1 << 16, np.int8)
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 1

    def ids_of(self, word: str) -> list[int]:
        """The tokenizer's ids of one word; a plain word is one pre-token that its normalizer leaves as it is."""
        if self.plain and word.isascii() and word.isalpha() and word.islower():
            return [t.id for t in self.tokenizer.model.tokenize(word)]
        if not (self.plain and word.isalpha() and word == word.lower() and not _OTHER.search(word)):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.shown.__getitem__, word.encode())))]

    def learn(self, words: list[str]) -> None:
        found = [self.ids_of(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.known), int(sizes.sum())
        while first + len(words) > len(self.start):
            self.start, self.size, self.mark = (np.resize(x, 2 * len(x)) for x in (self.start, self.size, self.mark))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.size[first : first + len(words)] = sizes
        self.start[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        # 1: a stop that may have been divided off; 2: ends with what would be one pre-token with a stop
        self.mark[first : first + len(words)] = [(w in (".", ",")) + 2 * (not w[-1].isalnum()) for w in words]
        self.used += total
        self.known.update(zip(words, range(first, first + len(words))))

    @staticmethod
    def plain_words(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def words(self, text: str) -> list[str]:
        """The words of a text; where that is sound, in lower case and with the stops behind them divided off."""
        if not self.plain or "<|" in text:
            return self.plain_words(text)
        try:
            text.encode("latin-1")  # a copy at most, where a search would look at every character
        except UnicodeEncodeError:
            if _OTHER.search(text):
                return self.plain_words(text)
        return (text.lower().replace("\n", " ") + " ").replace("\t", " ").replace("\r", " ").replace(". ", " . ").replace(", ", " , ").split(" ")

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text), each with ``end_id`` behind it if given."""
        each = [self.words(t or "") for t in texts]
        at = self._look_up(each)
        last = np.cumsum([len(ws) for ws in each])
        # a stop behind other punctuation belongs to it: such texts are divided at white space only
        mark = self.mark[at]
        odd = np.flatnonzero((mark[1:] & 1 > 0) & (mark[:-1] >= 2)) + 1
        if len(odd):
            for i in np.unique(np.searchsorted(last, odd, side="right")).tolist():
                each[i] = self.plain_words(texts[i])
            at = self._look_up(each)
            last = np.cumsum([len(ws) for ws in each])
        if end_id is not None:  # a word of its own, whose ids stand at place 0
            self.flat[0] = end_id
            at = np.insert(at, last, -1)
            last = last + np.arange(1, len(last) + 1)
        sizes, begins = self.size[at], self.start[at]
        if end_id is not None:
            sizes[last - 1], begins[last - 1] = 1, 0
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total, dtype=np.int32) + np.repeat(begins - ends + sizes, sizes)]
        done = np.concatenate([[0], ends])[last] if len(each) else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], done])).astype(np.int64)

    def check_text(self, text: str, ids: np.ndarray) -> None:
        """Raise unless the tokenizer's own ids of the whole text are ``ids``."""
        if self.tokenizer.encode(text, add_special_tokens=False).ids != ids.tolist():
            raise ValueError("the words' ids are not those of the whole text; this tokenizer needs whole texts")

    def _look_up(self, each: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        words = list(chain.from_iterable(each))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list({words[i] for i in new}))
            at[new] = [self.known[words[i]] for i in new]
        return at


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, z - a)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in slices(batch):
                texts = b.column("text").to_pylist()
                ids, n = enc.encode(texts, end_id)
                ends = np.cumsum(n)
                for k, doc in enumerate(b.column("doc_id").to_pylist()):
                    if doc is not None and doc % CHECKED == 0 and texts[k]:
                        enc.check_text(texts[k], ids[ends[k] - n[k] : ends[k] - 1])
                ids = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
                cuts = (np.concatenate([[0], np.cumsum(n)]) * ids.itemsize).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("bucket"), pa.array(n), raw], ["doc_id", "bucket", "n_tokens", "ids"])

    return run


def _write(folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_ids, part, bucket = 0, 0, None

        def flush() -> pa.RecordBatch:
            lengths = np.array([x[1] for x in held], np.int64)
            ids = np.concatenate([np.frombuffer(x[2], "<u2" if len(x[2]) == 2 * x[1] else "<u4").astype(np.uint32) for x in held])
            name = put_file(folder, f"{bucket:08d}-{part:06d}", write_file([x[0] for x in held], lengths, ids, end_id))
            row = {"file": [name], "bucket": [bucket], "part": [part], "n_docs": [len(held)], "n_ids": [n_ids]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            for d, k, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "bucket", "n_tokens", "ids"))):
                if held and (k != bucket or n_ids >= FILE_IDS):
                    yield flush()
                    held, n_ids, part = [], 0, part + 1 if k == bucket else 0
                bucket = k
                held.append((d, n, ids))
                n_ids += n
        if held:
            yield flush()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("file_start").to_pylist()):
                docs, n, ids = read_file(get_file(folder, name))
                ends = np.cumsum(n)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[z - k : z]) for z, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode each row's ``text`` (null: empty), append ``end_id`` and write the ids in ascending doc_id.

    Returns the manifest (file, bucket, part, n_docs, n_ids), a written table; files of failed
    attempts are not in it. Rows with a null doc_id come last; equal doc_ids stand in the order of
    their ids' bytes. An empty table gives no files; other columns are ignored. Buckets are ranges of
    about as many rows each, found from quantiles of doc_id; each goes to a task of its own.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 20_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    bucket = F.lit(len(cuts) + 1)
    if cuts:
        # cuts has at most one entry for each partition, so this literal is bounded by the cluster's size
        bucket = F.when(F.col("doc_id").isNotNull(), F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("doc_id")))).otherwise(len(cuts) + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), bucket.cast("int").alias("bucket"))
    ids = arrow_map(rows, _encode(tokenizer_path, end_id), "doc_id long, bucket int, n_tokens long, ids binary")
    ordered = ids.repartitionById(len(cuts) + 2, "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), "ids")
    return materialize(arrow_map(ordered, _write(folder, end_id), "file string, bucket int, part int, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    # sums of buckets first, of which there are as many as tasks, then those of files within one bucket
    past = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n_ids")).select("bucket", past(Window.orderBy("bucket")).alias("before"))
    files = manifest.join(buckets, "bucket").withColumn("file_start", F.col("before") + past(Window.partitionBy("bucket").orderBy("part")))
    spread = files.select("file", "file_start").repartition(partitions(manifest.sparkSession), "file")
    return arrow_map(spread, _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    folder = folder or new_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, folder), folder)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often everywhere.

Tokens A and B of a text cut the same bytes. Offsets where both end divide them into groups; an A and
a B token whose byte ranges overlap are linked. How often an id pair is linked corpus-wide needs all
documents, so links become postings:

1. Each batch of texts is encoded once and written: the documents' own figures, and for each B id the
   batch's postings (A id, document, multiplicity), packed.
2. Postings are shuffled by B id and sorted there by Spark, which spills. A stream over them sums each
   pair, finds the largest of each B id, and emits what every document's postings are worth.
3. These contributions are shuffled by document and summed.

A B id that holds more than half a task's share of all postings is hot: its pair counts are summed
ahead, combined before they are shuffled, and sent to as many salted parts as it needs, each of which
streams a part of its postings past them. Such ids are at most as many as the vocabulary has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import BATCH_ROWS, arrow_map, partitions, table
from sievework.llm.token_files import slices
from sievework.scratch import materialize

#: Bytes of text that are aligned at a time, and postings that are counted at a time; they bound a worker's memory.
CHUNK_BYTES, BLOCK = 4 << 20, 2_000_000
#: Documents of a batch that are summed together.
PART = 256
#: Fixed value: how GPT-2 style byte-level tokenizers divide a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NOT_LATIN = re.compile("[^\x00-ɏ]")


class ByteTokenizer:
    """Ids by a byte-level tokenizer file, special tokens' strings being plain text.

    Where the file is plain byte-level BPE with its merges in the order of its ids, tiktoken applies
    them, which is several times faster; texts with letters beyond the Latin ones, whose classes may
    differ between the two libraries' Unicode tables, and all other files go to the tokenizers library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path) as f:
            spec = json.load(f)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["id"] for x in spec["added_tokens"]}
        entry = {i: t for t, i in self.own.get_vocab(True).items()}
        self.size = max(entry) + 1
        self.bytes = [b"" for _ in range(self.size)]
        for i, t in entry.items():
            self.bytes[i] = t.encode() if i in special else bytes(map(byte.__getitem__, t))
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        plain = (model["type"], spec["normalizer"], split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("BPE", None, "ByteLevel", True, False)
        plain &= not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and [model["vocab"].get(m) for m in merged] == list(range(256, 256 + len(merged)))
        self.quick = None
        if plain:
            import tiktoken

            ranks = {self.bytes[i]: i for i in model["vocab"].values()}
            self.quick = tiktoken.Encoding("of-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.quick and (text.isascii() or not _NOT_LATIN.search(text)):
            return np.array(self.quick.encode_ordinary(text), np.int64)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokenizer:
    """Ids by a sentencepiece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.own.get_piece_size()
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes = []
        for piece in map(self.own.id_to_piece, range(self.size)):
            m = byte.fullmatch(piece)
            self.bytes.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.own.encode(texts, num_threads=1)]


class Aligner:
    """Both tokenizers of a worker, with what its ids look like as bytes and in a list of groups."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        # an A id is followed by "," or, last of its group, "|"; a B id by "," or ";"
        names = [str(i).encode() for i in range(max(self.a.size, self.b.size))]
        self.names = np.array([n + s for s in (b",", b"|", b";") for n in names], object)
        self.size = len(names)

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], dict[str, np.ndarray]]:
        """Figures of each text; links (a, b, doc, m), sorted by b, a and doc, of all of them."""
        own: dict[str, list] = {"n_a": [], "n_b": [], "n_groups": [], "n_links": [], "groups_sha256": []}
        at, ids_a, ids_b = [], [], []
        some = [i for i, t in enumerate(texts) if t]
        for i, b in zip(some, self.b.encode([texts[i] for i in some])):
            text = " " + texts[i]
            raw = text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.b.bytes.__getitem__, b.tolist())) != raw:
                continue
            a = self.a.encode(text)
            if b"".join(map(self.a.bytes.__getitem__, a.tolist())) == raw:
                at.append(i)
                ids_a.append(a)
                ids_b.append(b)
        n_a, n_b, n_groups, n_links = np.zeros((4, len(texts)), np.int64)
        sha = [""] * len(texts)
        none = np.zeros(0, np.int64)
        if not at:
            return own | {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha}, {"a": none, "b": none, "doc": none, "m": none}
        # all texts one after another: each ends where both tokens end, so groups and links never cross texts
        n_a[at], n_b[at] = [len(x) for x in ids_a], [len(x) for x in ids_b]
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends_here = np.zeros((2, end_a[-1] + 1), bool)
        ends_here[0, end_a], ends_here[1, end_b] = True, True
        both, any_ = np.flatnonzero(ends_here[0] & ends_here[1]), np.flatnonzero(ends_here[0] | ends_here[1])
        of_a, of_b = (np.searchsorted(e, any_) for e in (end_a, end_b))  # the tokens that cover the bytes before each end
        text_end = end_a[np.cumsum(n_a[at]) - 1]
        per = lambda e: np.diff(np.searchsorted(e, text_end, "right"), prepend=0)
        n_groups[at], n_links[at] = per(both), per(any_)
        for i, digest in zip(at, self._groups(a, b, end_a, end_b, both, n_a[at] + n_b[at])):
            sha[i] = digest
        doc = np.repeat(np.array(at), n_links[at])
        # one number for each (b, a, document), equal ones counted
        key, m = np.unique((b[of_b] * self.a.size + a[of_a]) * BATCH_ROWS + doc, return_counts=True)
        pair = key // BATCH_ROWS
        links = {"b": pair // self.a.size, "a": pair % self.a.size, "doc": key % BATCH_ROWS, "m": m}
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": sha}, links

    def _groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, both: np.ndarray, sizes: np.ndarray) -> Iterator[str]:
        """Digest of the list of groups of each text; ``sizes`` has its number of tokens."""
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        before_b = np.searchsorted(group_b, np.arange(len(both)))  # B tokens of earlier groups
        through_a = np.searchsorted(group_a, np.arange(len(both)), "right")  # A tokens of this group and earlier ones
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = a + self.size * last_a
        order[np.arange(len(b)) + through_a[group_b]] = b + 2 * self.size * last_b
        words = self.names[order].tolist()
        at = 0
        for n in sizes.tolist():
            yield hashlib.sha256(b"".join(words[at : at + n])[:-1]).hexdigest()
            at += n


_ALIGNERS: dict[tuple[str, str], Aligner] = {}

OWN = "chunk long, b int, n long, a binary, doc binary, m binary, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_OWN = pa.schema([("chunk", pa.int64()), ("b", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("doc", pa.binary()), ("m", pa.binary()), ("idx", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _FIGURES], ("groups_sha256", pa.string())])


def _rows(columns: dict[str, object], n: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch in which the columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values`` cut at ``starts`` (with the end), as binaries."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(column: pa.Array, dtype: str) -> np.ndarray:
    """The bytes of all rows of a binary column one after another; it has no nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype) if len(column) else np.zeros(0, dtype)


def _encode(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _ALIGNERS[path_a, path_b]
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in slices(batch, most=CHUNK_BYTES):
                own, links = aligner.align(s.column("text").to_pylist())
                yield _rows({"chunk": [chunk] * s.num_rows, "idx": np.arange(s.num_rows), "doc_id": s.column("doc_id"), **own}, s.num_rows, _OWN)
                over = (links["m"] + 254) // 255  # a multiplicity is a byte; larger ones are several postings
                if len(over) and over.max() > 1:
                    rest = links["m"] - 255 * (over - 1)
                    links = {k: np.repeat(v, over) for k, v in links.items()}
                    links["m"] = np.full(len(links["b"]), 255)
                    links["m"][np.cumsum(over) - 1] = rest
                b = links["b"]
                starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, int)
                packed = {k: _packed(links[k].astype(t), starts) for k, t in (("a", _id_type(aligner.a.size)), ("doc", "<u2"), ("m", "u1"))}
                yield _rows({"chunk": np.full(len(starts) - 1, chunk), "b": b[starts[:-1]], "n": np.diff(starts), **packed}, len(starts) - 1, _OWN)
                chunk += 1

    return run


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _pair_counts(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key = np.repeat(x.column("b").to_numpy().astype(np.int64), x.column("n").to_numpy()) << 32 | _unpacked(x.column("a"), dtype)
            pair, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, _unpacked(x.column("m"), "u1"), len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int64)), pa.array(n)], ["b", "a", "n"])

    return run


def _contributions(dtype: str):
    """Postings sorted by (b, salt), those of a hot b behind its pair counts, to what each document's are worth."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("docs", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])

    def worth(rows: list[tuple], known: dict) -> pa.RecordBatch:
        group, chunk, n = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
        a, doc, m = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (3, 4, 5))
        names, g = np.unique(group, return_inverse=True)
        pair, at = np.unique(np.repeat(g, n) << 32 | a, return_inverse=True)
        count = np.bincount(at, m, len(pair)).astype(np.int64)
        of = pair >> 32
        first = np.searchsorted(of, np.arange(len(names)))
        most = np.maximum.reduceat(count, first)
        for i, name in enumerate(names.tolist()):
            if name in known:
                ids, counts = known[name]
                end = first[i + 1] if i + 1 < len(names) else len(pair)
                count[first[i] : end] = counts[np.searchsorted(ids, pair[first[i] : end] & 0xFFFFFFFF)]
                most[i] = counts.max()
        total = m * count[at]
        best = np.where((count == most[of])[at], m, 0)
        names, c = np.unique(chunk, return_inverse=True)
        key = np.repeat(c, n) * BATCH_ROWS + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        best, total, key = np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts), key[starts]
        c, doc = key // BATCH_ROWS, key % BATCH_ROWS
        cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (doc[1:] // PART != doc[:-1] // PART), [True]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(names[c[cut[:-1]]]), pa.array((doc[cut[:-1]] // PART).astype(np.int32)), _packed((doc % PART).astype("u1"), cut), _packed(best.astype("<i8"), cut), _packed(total.astype("<i8"), cut)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, known = 0, {}
        for x in batches:
            group = x.column("b").to_numpy().astype(np.int64) << 32 | x.column("salt").to_numpy()
            counted = np.array(x.column("known").is_valid())
            for i in np.flatnonzero(counted).tolist():
                pairs = x.column("known")[i].values
                known[int(group[i])] = pairs.field("a").to_numpy(), pairs.field("n").to_numpy()
            x = x.filter(pa.array(~counted))
            if not x.num_rows:
                continue
            group = group[~counted]
            n = np.diff(np.frombuffer(x.column("m").buffers()[1], np.int32)[x.column("m").offset :][: x.num_rows + 1]).astype(np.int64)
            rows.append((group, x.column("chunk").to_numpy(), n, _unpacked(x.column("a"), dtype), _unpacked(x.column("doc"), "<u2"), _unpacked(x.column("m"), "u1")))
            held += int(n.sum())
            if held < BLOCK:
                continue
            # what belongs to a group that is still open waits, unless its counts are known
            last = int(group[-1])
            open_ = [r[0] == last if last not in known else np.zeros(len(r[0]), bool) for r in rows]
            if all(o.all() for o in open_):
                continue
            done, wait = [], []
            for r, o in zip(rows, open_):
                k = int(np.count_nonzero(~o))  # sorted, so the open group stands behind
                p = int(r[2][:k].sum())
                done += [tuple(v[:k] for v in r[:3]) + tuple(v[:p] for v in r[3:])] if k else []
                wait += [tuple(v[k:] for v in r[:3]) + tuple(v[p:] for v in r[3:])] if k < len(o) else []
            yield worth(done, known)
            rows, held = wait, sum(int(r[2].sum()) for r in wait)
            known = {k: v for k, v in known.items() if k == last}
        if rows:
            yield worth(rows, known)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, part), those of documents first, to the documents with their sums."""
    own = ["doc_id", *_FIGURES, "groups_sha256"]
    now, docs, sums = None, [], np.zeros((2, PART), np.int64)

    def result() -> pa.RecordBatch:
        columns = {c: [d[c] for d in docs] for c in own}
        at = [d["idx"] % PART for d in docs]
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*_FIGURES, "n_best", "count_sum")], ("groups_sha256", pa.string())])
        return _rows({**columns, "n_best": sums[0, at], "count_sum": sums[1, at]}, len(docs), schema)

    for x in batches:
        for r in x.to_pylist():
            if (r["chunk"], r["part"]) != now:
                if docs:
                    yield result()
                now, docs, sums = (r["chunk"], r["part"]), [], np.zeros((2, PART), np.int64)
            if r["docs"] is None:
                docs.append(r)
                continue
            at = np.frombuffer(r["docs"], "u1")  # each document once
            sums[0, at] += np.frombuffer(r["best"], "<i8")
            sums[1, at] += np.frombuffer(r["total"], "<i8")
    if docs:
        yield result()


def hot_ids(postings: DataFrame, n_partitions: int) -> DataFrame:
    """b, salts of the ids that hold more than half a partition's share of the postings, with the parts they need for that."""
    sizes = postings.groupBy("b").agg(F.sum("n").alias("n"))
    share = F.floor(F.col("n") * 2 * n_partitions / F.col("every")).cast("int")
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("every")))).select("b", (share + 1).alias("salts")).where("salts > 1")


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs`` (doc_id, text).

    ``path_a`` is a byte-level tokenizer file, which encodes a space and the text, ``path_b`` a
    sentencepiece model, which encodes the text and puts the space itself. A text that is null or empty,
    or whose tokens do not join to the same bytes, has no tokens: zeros and an empty digest. n_best
    counts links of pairs that are the most frequent ones of their B id, ties included; count_sum adds
    up the frequency of each link's pair. Repeated rows count and stay; rows without doc_id too. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = materialize(arrow_map(own, _encode(path_a, path_b), OWN), "alignment")
    n = max(1, partitions(spark))
    from tokenizers import Tokenizer

    dtype = _id_type(max(Tokenizer.from_file(path_a).get_vocab(True).values()) + 1)
    postings = encoded.where("b is not null").select("b", "chunk", "n", "a", "doc", "m")
    hot = materialize(hot_ids(postings, n), "alignment-hot")  # no more rows than B ids
    salted = postings.join(F.broadcast(hot), "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("chunk"), F.col("salts")), F.lit(0)).cast("int"))
    pairs = arrow_map(postings.join(F.broadcast(hot), "b", "left_semi").select("b", "n", "a", "m"), _pair_counts(dtype), "b int, a long, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    known = pairs.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("known"))  # of a B id, at most one for each A id
    known = known.join(F.broadcast(hot), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "known")
    empty = F.lit(None)
    stream = salted.select("b", "salt", "chunk", "a", "doc", "m", empty.cast("array<struct<a:bigint,n:bigint>>").alias("known"))
    stream = stream.unionByName(known.select("b", "salt", empty.cast("long").alias("chunk"), *[empty.cast("binary").alias(c) for c in ("a", "doc", "m")], "known"))
    stream = stream.repartition(n, "b", "salt").sortWithinPartitions("b", "salt", F.desc(F.col("known").isNotNull()))
    worth = arrow_map(stream, _contributions(dtype), "chunk long, part int, docs binary, best binary, total binary")
    figures = encoded.where("b is null").select("chunk", F.floor(F.col("idx") / PART).cast("int").alias("part"), "idx", "doc_id", *_FIGURES, "groups_sha256")
    both = figures.unionByName(worth, allowMissingColumns=True).repartition(n, "chunk", "part").sortWithinPartitions("chunk", "part", F.asc(F.col("docs").isNotNull()))
    return arrow_map(both, _sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

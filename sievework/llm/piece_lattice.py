"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

Pieces and scores come from a SentencePiece model; the best segmentation maximises the sum of scores.
A forward pass gives the Viterbi score of every prefix. Those scores are the exact cost to go for a
backward A* search from the end of the text, so the search takes complete segmentations off its queue
in order of score, best first.

Pieces hold spaces only at their front and no line break, so a lattice falls into chunks (spaces and
what follows, or a line break) at places every path passes. The lattices of the distinct chunks of a
batch are solved together, one array operation for each piece length: prefix and suffix scores, the
best path, and the loss of the second best, which is the best path over any edge off the best one.
A text's N best segmentations change only chunks with one of its N - 1 smallest such losses; A* runs
for those, and their alternatives are merged.

The text is reversible: a space is put before it, spaces stand for the model's U+2581, characters no
piece covers (U+2581 itself too) become UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, table
from sievework.llm.token_files import slices

N_BEST = 4
#: Chunks a worker remembers before it starts again; a memory bound, without effect on results.
CACHE_CHUNKS, CACHE_ALTERNATIVES = 250_000, 50_000
#: Characters of a chunk beyond which it is solved by itself; without effect on results.
LONG_CHUNK = 40
#: What an uncovered character scores below the worst piece.
UNKNOWN = 10.0
SPACE = "▁"
_B = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(size)]
        self.byte_id: dict[int, int] = {int(names[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        text = {i: names[i].replace(SPACE, " ") for i in plain}
        self.pieces: dict[str, tuple[int, float]] = {text[i]: (i, m.get_score(i)) for i in plain}
        self.longest = max(map(len, self.pieces))
        real = [s for _, s in self.pieces.values() if s > -1e8]
        self.unknown = min(real) - UNKNOWN
        self.raw = [b""] * size
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        for i in plain:
            self.raw[i] = text[i].encode()
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("pieces with a space behind a letter are not supported")
        self.split = re.compile(r" +[^ \n]*|\n|[^ \n]+" if not any("\n" in p for p in self.pieces) else r" +[^ ]*|[^ ]+")
        self.single = {ord(p) for p in self.pieces if len(p) == 1}
        # pieces by hash of their characters; a bit table turns most other substrings away at once
        pairs = sorted((int(self._hash(p)), i, s) for p, (i, s) in self.pieces.items())
        self.hashes = np.array([h for h, _, _ in pairs], np.uint64)
        if len(np.unique(self.hashes)) < len(pairs):
            raise ValueError("two pieces share a hash")
        self.ids, self.scores = np.array([i for _, i, _ in pairs], np.int64), np.array([s for _, _, s in pairs])
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.clear()

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_B)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return np.uint64(h)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.best, self.loss = np.zeros(1 << 16), np.zeros(1 << 16)
        self.others: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def edges(self, chunk: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the lattice's edges that end at ``end``."""
        for s in range(max(0, end - self.longest), end):
            hit = self.pieces.get(chunk[s:end])
            if hit:
                yield s, hit[1], (hit[0],)
            elif s == end - 1:
                yield s, self.unknown, tuple(self.byte_id[b] for b in chunk[s].encode("utf-8", "surrogatepass"))

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first: forward Viterbi, then A* from the end."""
        alpha = [0.0] + [-np.inf] * len(chunk)
        into = [[]] + [list(self.edges(chunk, e)) for e in range(1, len(chunk) + 1)]
        for e in range(1, len(chunk) + 1):
            alpha[e] = max(alpha[s] + w for s, w, _ in into[e])
        out: list[tuple[float, tuple[int, ...]]] = []
        serial = 0
        # (cost, place, serial, score behind, path as a linked list): ties go on where the start is nearest
        queue: list[tuple] = [(-alpha[-1], len(chunk), serial, 0.0, None)]
        taken = [0] * (len(chunk) + 1)
        while queue and len(out) < n:
            cost, at, _, behind, path = heapq.heappop(queue)
            taken[at] += 1
            if taken[at] > n:  # n better ways on from here are known already
                continue
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((-cost, tuple(ids)))
                continue
            for s, w, ids in into[at]:
                serial += 1
                heapq.heappush(queue, (-(alpha[s] + w + behind), s, serial, behind + w, (ids, path)))
        return out

    def _solve(self, chunks: list[str], length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(flat ids, sizes, best scores, losses) of chunks of one length, every character a piece."""
        n = len(chunks)
        code = np.array(chunks, f"<U{length}").view(np.uint32).reshape(n, length).astype(np.uint64)
        minus = -np.inf
        score: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}
        for s in range(length):
            h = np.zeros(n, np.uint64)
            for e in range(s + 1, min(length, s + self.longest) + 1):
                h = (h + code[:, e - 1] + np.uint64(1)) * _B
                h ^= h >> np.uint64(29)
                rows = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[rows]
                if hit.any():
                    w, ids = np.full(n, minus), np.zeros(n, np.int64)
                    w[rows[hit]], ids[rows[hit]] = self.scores[at[hit]], self.ids[at[hit]]
                    score[s, e], piece[s, e] = w, ids
        alpha, beta = np.full((length + 1, n), minus), np.full((length + 1, n), minus)
        alpha[0], beta[length] = 0, 0
        came = np.zeros((length + 1, n), np.int64)
        for e in range(1, length + 1):
            for s in range(max(0, e - self.longest), e):
                if (s, e) in score:
                    t = alpha[s] + score[s, e]
                    better = t > alpha[e]
                    alpha[e] = np.where(better, t, alpha[e])
                    came[e] = np.where(better, s, came[e])
        for s in range(length - 1, -1, -1):
            for e in range(s + 1, min(length, s + self.longest) + 1):
                if (s, e) in score:
                    np.maximum(beta[s], score[s, e] + beta[e], out=beta[s])
        # the best path, from the end
        on = np.zeros((length + 1, n), bool)  # on[e]: the path has an edge that ends at e
        at = np.full(n, length)
        ids = np.zeros((n, length), np.int64)
        count = np.zeros(n, np.int64)
        every = np.arange(n)
        for e in range(length, 0, -1):
            here = np.flatnonzero(at == e)
            on[e, here] = True
            for s in np.unique(came[e, here]):
                rows = here[came[e, here] == s]
                count[rows] += 1
                ids[rows, length - count[rows]] = piece[int(s), e][rows]
            at[here] = came[e, here]
        second = np.full(n, minus)
        for (s, e), w in score.items():
            t = alpha[s] + w + beta[e]
            np.maximum(second, np.where(on[e] & (came[e] == s), minus, t), out=second)
        keep = np.arange(length)[None, :] >= (length - count)[:, None]
        return ids[keep], count, alpha[length], alpha[length] - second, every

    def learn(self, chunks: list[str]) -> None:
        groups: dict[int, list[str]] = {}
        alone = []
        for c in chunks:
            (groups.setdefault(len(c), []) if len(c) <= LONG_CHUNK and self.single.issuperset(map(ord, c)) and "\0" not in c else alone).append(c)
        for length, own in groups.items():
            for i in range(0, len(own), 20_000):
                self._add(own[i : i + 20_000], *self._solve(own[i : i + 20_000], length)[:4])
        if alone:
            found = [self.search(c, 2) for c in alone]
            ids = [x[0][1] for x in found]
            self._add(alone, np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids]), np.array([x[0][0] for x in found]), np.array([x[0][0] - x[1][0] if len(x) > 1 else np.inf for x in found]))

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray, best: np.ndarray, loss: np.ndarray) -> None:
        first, last, total = len(self.known), len(self.known) + len(chunks), len(ids)
        while last > len(self.start):
            self.start, self.size, self.best, self.loss = (np.resize(x, 2 * len(x)) for x in (self.start, self.size, self.best, self.loss))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last], self.best[first:last], self.loss[first:last] = sizes, best, loss
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.known.update(zip(chunks, range(first, last)))

    def alternatives(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        if chunk not in self.others:
            if len(self.others) > CACHE_ALTERNATIVES:
                self.others.clear()
            self.others[chunk] = self.search(chunk, n)
        return self.others[chunk]

    def chunks(self, text: str) -> list[str]:
        return self.split.findall(" " + text) if text else []

    def encode(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, np.ndarray]]]:
        """The ``n`` best (score, ids) of each text, best first; an empty text has the empty one."""
        each = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        if new := list({c for cs in each for c in cs}.difference(self.known)):
            self.learn(new)
        out = []
        for cs in each:
            at = np.fromiter(map(self.known.__getitem__, cs), np.int64, len(cs))
            size, begin = self.size[at], self.start[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.arange(total) + np.repeat(begin - ends + size, size)]
            score = float(self.best[at].sum())
            loss = self.loss[at]
            near = np.argpartition(loss, n - 2)[: n - 1] if n > 1 and len(loss) > n - 1 else np.arange(len(loss) if n > 1 else 0)
            ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            for k in sorted(near.tolist()):
                if np.isinf(loss[k]):
                    continue
                alt = self.alternatives(cs[k], n)
                ways = sorted((lost + alt[0][0] - s, way + (((k, r),) if r else ())) for lost, way in ways for r, (s, _) in enumerate(alt))[:n]
            found = []
            for lost, way in ways:
                parts, done = [], 0
                for k, r in way:
                    parts += [ids[done : ends[k] - size[k]], np.array(self.alternatives(cs[k], n)[r][1], np.int32)]
                    done = ends[k]
                found.append((score - lost, np.concatenate([*parts, ids[done:]]) if way else ids))
            out.append(found)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


_KINDS = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.float64()), ("ids_crc32", pa.int64()), ("nbest_scores", pa.list_(pa.float64())), ("nbest_crc32", pa.list_(pa.int64())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))]


def _encode(path: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
        kinds = _KINDS if with_ids else _KINDS[:-1]
        for batch in batches:
            for b in slices(batch):
                rows = []
                texts = [t or "" for t in b.column("text").to_pylist()]
                for doc, text, best in zip(b.column("doc_id").to_pylist(), texts, lat.encode(texts, n)):
                    first = best[0][1]
                    back = [lat.decode(ids) for _, ids in best[:1]]
                    sha = hashlib.sha256(back[0].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, len(first), best[0][0], crc(first), [s for s, _ in best], [crc(ids) for _, ids in best], sha, back[0] == text, first))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    return run


def encode_pieces(docs: DataFrame, model_path: str, n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, score, ids_crc32, nbest_scores, nbest_crc32, decoded_sha256, round_trip (and ids).

    One row for each row of ``docs`` (doc_id, text): the best segmentation of the whole text, the
    scores and ids' checksums (CRC-32 of little-endian 32-bit ids) of its ``n`` best in order of
    score, and whether decoding the best gives the text back. A null or empty text has no piece and
    one empty segmentation; repeated rows and null doc_ids stay; an empty table gives no rows; other
    columns are ignored. Equal scores stand in an order fixed by the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean"
    return arrow_map(rows, _encode(model_path, n, with_ids), schema + (", ids array<int>" if with_ids else ""))


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

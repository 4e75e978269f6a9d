"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

No machine can hold one suffix array of a whole corpus, so suffixes are dealt out losslessly first.
A string of ``length`` bytes belongs to its minimizer, the smallest hash among its ``GRAM``-byte
substrings: equal strings have equal minimizers, and neighbouring ones mostly share theirs. Runs of
starts with one minimizer form one *piece* of text (the run and the ``length - 1`` bytes behind it).

* Texts that are equal as a whole, by SHA-256, are repeated whole; no spans are worked out for them.
* Pieces that are equal as a whole, told by two rolling hashes and the minimizer, are repeated whole.
* Minimizers that occur once cannot hold a repeat; their pieces end here, without moving any text.
* What is left, different pieces under one minimizer, goes to that minimizer's task with its bytes.
  There a suffix array (prefix doubling on the ties that are left) and its LCP values are scanned
  with a stack; intervals of at least ``length`` whose occurrences differ in the byte before them
  are the maximal repeats, with all their occurrences.
* Minimizers with more than ``HOT`` different pieces are split finer, one row for each start with two
  rolling hashes of its string, and counted with partial aggregation: exact, and of no bounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.llm.common import arrow_map, partitions, spare, table
from sievework.scratch import materialize

LENGTH, GRAM = 200, 32
#: Different pieces under one minimizer beyond which it is split by start; bounds a task's suffix array.
HOT = 10_000
#: Bytes of pieces that one suffix array takes in, for many minimizers together.
CHUNK = 700_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
#: Starts of a long text that are taken at a time; a memory bound, without effect on results.
SEGMENT = 1 << 22


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            steps = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
            self.up, self.down = steps(self.base), steps(self.inverse)
        return self.up, self.down


_POWERS = [Powers(b) for b in _BASES]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefix_hash(b: np.ndarray, which: int) -> np.ndarray:
    up, _ = _POWERS[which].get(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=out[1:])
    return out


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    _, down = _POWERS[which].get(len(p))
    return _mix((p[end] - p[start]) * down[start])


def pieces(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, piece hash, first start, number of starts) of each piece of the bytes ``b``."""
    none = np.zeros(0, np.uint64)
    if len(b) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    if len(b) > SEGMENT + length:  # the starts of each segment by themselves; pieces are only cut once more
        parts = [(*pieces(b[i : i + SEGMENT + length - 1], length, gram), i) for i in range(0, len(b) - length + 1, SEGMENT)]
        return tuple(np.concatenate([x[k] + x[4] if k == 2 else x[k] for x in parts]) for k in range(4))
    w = length - gram + 1
    p = prefix_hash(b, 0)
    _, down = _POWERS[0].get(len(p))
    h = _mix((p[gram:] - p[:-gram]) * down[: len(p) - gram])
    # ordered by 40 bits of the hash and then by place, so that equal strings agree on the leftmost
    # smallest one; a run then has one occurrence of its minimizer, and so no string twice
    m, s = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    n = len(h) - w + 1
    while 2 * s <= w:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    m = np.minimum(m[:n], m[w - s :])
    start = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    count = np.diff(np.append(start, len(m)))
    end = start + count + length - 1
    q = prefix_hash(b, 1)
    ch = range_hash(p, start, end, 0) * np.uint64(0x2545F4914F6CDD1D) + range_hash(q, start, end, 1)
    return h[m[start] & _PLACE], ch, start, count


#: A piece's place is its first start times this, plus its number of starts.
PLACE = 1 << 16
#: Pieces that a task counts before it sends its counts on.
COUNTED = 1 << 20


def _scan(length: int):
    """Each text's digest and its pieces: minimizers, hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                key, ch, start, count = pieces(np.frombuffer(raw, np.uint8), length)
                for o, x in zip(out, (hashlib.sha256(raw).digest(), len(raw), key.view(np.int64), ch.view(np.int64), start * PLACE + count)):
                    o.append(x)
            longs = lambda xs: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *xs]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), *(longs(x) for x in out[2:])], ["rid", "doc_id", "sha", "n_bytes", "keys", "chs", "places"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ch, n, rid, place) of the different pieces among many texts, with one place of each."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        key, ch, rid, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, rid, ch, key))
        key, ch, rid, place = key[order], ch[order], rid[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ch[1:] != ch[:-1])])) if len(key) else np.zeros(0, np.int64)
        columns = (key[new], ch[new], np.diff(np.append(new, len(key))), rid[new], place[new])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "ch", "n", "rid", "place"])

    for b in batches:
        sizes = b.column("keys").value_lengths().to_numpy(zero_copy_only=False)
        held.append((*(b.column(c).flatten().to_numpy() for c in ("keys", "chs")), np.repeat(b.column("rid").to_numpy(), sizes), b.column("places").flatten().to_numpy()))
        size += int(sizes.sum())
        if size >= COUNTED:
            yield from counted()
            held, size = [], 0
    if held:
        yield from counted()


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Order of all suffixes by their first ``depth`` codes at least, and ranks by 8, 16, 32, ... codes.

    Only suffixes that still tie are sorted again. ``codes`` are below 512; 0 stands behind the end.
    """
    n = len(codes)
    padded = np.zeros(n + 8, np.uint16)
    padded[:n] = codes
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven codes of nine bits
        key <<= np.uint64(9)
        key |= padded[j : j + n]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    ranks, k = {7: rank.copy()}, 7
    slots = _tied(new)
    while k < depth and len(slots):
        at = order[slots]
        after = at + k
        pair = rank[at].astype(np.uint64) << np.uint64(32)
        pair |= np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        new[slots] |= fresh
        slots = slots[_tied(fresh)]
        k *= 2
        ranks[k] = rank.copy()
    return order, ranks


def _tied(new: np.ndarray) -> np.ndarray:
    """Places that share their group with another."""
    last = np.append(new[1:], True)
    return np.flatnonzero(~(new & last)).astype(np.int32)


def common_prefix(codes: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (as far as the ranks go twice over)."""
    n, out = len(codes), np.zeros(len(a), np.int64)
    for k in sorted(ranks, reverse=True):
        for _ in range(2):
            x, y = a + out, b + out
            ok = (x < n) & (y < n)
            out += np.where(ok & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)]), k, 0)
    for _ in range(7):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        out += ok & (codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)])
    return out


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each left-diverse LCP interval of at least ``least``, by one stack scan.

    ``lcp[i]`` is the common prefix of the suffixes at places i - 1 and i, ``left`` the code before
    the suffix at each place. The intervals form a tree; children come before their parents.
    """
    stack: list[list] = []  # [length, first, code before all occurrences so far or None if they differ]
    join = lambda p, q: p if p == q else None
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        first, code = i - 1, int(left[i - 1])
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            code = join(own, code)
            if code is None:
                yield length, first, i - 1
        if now < least:
            continue
        if stack and stack[-1][0] == now:
            stack[-1][2] = join(stack[-1][2], code)
        else:
            stack.append([now, first, code])


def repeats_of(strings: list[bytes], starts: list[int], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Maximal repeats of at least ``least`` bytes among suffixes at the first ``starts[i]`` places of each string.

    Returns (string of each place of the suffix array, offset in it, [(length, first, last place)]).
    The first place of a string counts as different on its left from every other.
    """
    size = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    codes[base + size] = 0
    of = np.repeat(np.arange(len(strings), dtype=np.int32), size + 1)
    offset = np.arange(len(codes), dtype=np.int32) - base.astype(np.int32)[of]
    owned = offset < np.array(starts, np.int32)[of]
    order, ranks = suffix_array(codes, int(size.max(initial=0)))
    order = order[owned[order]]
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(order), np.int64)
    near = np.flatnonzero((ranks[7][a] == ranks[7][b]) | (least < 7))
    lcp[near + 1] = common_prefix(codes, ranks, a[near], b[near])
    rest = size[of[order]] - offset[order]
    if len(order) > 1:
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[:-1], rest[1:]))
    left = np.where(offset[order] == 0, 1000 + of[order], codes[np.maximum(order - 1, 0)])
    # an outermost interval without left diversity has none inside: those need no scan
    deep = lcp >= least
    first = np.flatnonzero(~deep)  # each place that starts an outermost interval
    last = np.append(first[1:], len(lcp)) - 1
    differs = np.zeros(len(left), bool)
    differs[1:] = (left[1:] != left[:-1]) & deep[1:]
    many = np.add.reduceat(differs, first) > 0 if len(first) else np.zeros(0, bool)
    out = []
    for f, z in zip(first[many], last[many]):
        part = lcp[f : z + 1].copy()
        part[0] = 0
        out += [(n, f + i, f + j) for n, i, j in maximal_repeats(part, left[f : z + 1], least)]
    return of[order], offset[order], out


def _cover(strings: list[bytes], starts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """Merged (from, to) spans of each string that maximal repeats cover."""
    of, offset, found = repeats_of(strings, starts, least)
    reach = np.zeros(len(of), np.int64)
    for n, f, z in found:
        np.maximum(reach[f : z + 1], n, out=reach[f : z + 1])
    hit = np.flatnonzero(reach)
    hit = hit[np.lexsort((offset[hit], of[hit]))]
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for s, a, n in zip(of[hit].tolist(), offset[hit].tolist(), reach[hit].tolist()):
        spans = out[s]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], a + n))
        else:
            spans.append((a, a + n))
    return out


def _cut(length: int):
    """Texts with the list of pieces wanted of each: one row for each piece with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("key", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("piece", pa.binary())]
        for b in batches:
            rows = []
            for rid, text, wanted in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "wanted"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows += [(w["key"], rid, w["start"], w["count"], w["single"], w["hot"], raw[w["start"] : w["start"] + w["count"] + length - 1]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    return run


_SPAN = [("rid", pa.int64()), ("a", pa.int64()), ("z", pa.int64())]


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_SPAN)], [c for c, _ in _SPAN])


def _arrays(length: int):
    """Pieces ordered by minimizer: the spans that repeats cover in those that occur once. Hot ones go the other way."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        covers = _cover([h[4] for h in held], [h[3] for h in held], length)
        return _spans([(h[1], h[2] + a, h[2] + z) for h, spans in zip(held, covers) if h[5] for a, z in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            b = b.filter(pc.invert(b.column("hot")))
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "rid", "start", "count", "piece", "single"))):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def _starts(length: int):
    """Pieces of hot minimizers: two hashes of the string at each start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("hot"))
            for rid, start, count, piece, single in zip(*(b.column(c).to_pylist() for c in ("rid", "start", "count", "piece", "single"))):
                raw = np.frombuffer(piece, np.uint8)
                i = np.arange(count)
                h = [range_hash(prefix_hash(raw, k), i, i + length, k).view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(count, rid)), pa.array(start + i), pa.array(np.full(count, single))], ["h0", "h1", "rid", "at", "single"])

    return run


def take_out(raw: bytes, spans: list[tuple[int, int]], whole_characters: bool) -> tuple[int, bytes]:
    """(number of merged spans, the bytes outside of them); whole characters go if one of their bytes does."""
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        while whole_characters and 0x80 <= raw[a] < 0xC0:
            a -= 1
        while whole_characters and z < len(raw) and 0x80 <= raw[z] < 0xC0:
            z += 1
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    kept, at = [], 0
    for a, z in merged:
        kept.append(raw[at:a])
        at = z
    return len(merged), b"".join([*kept, raw[at:]])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their covered spans: what is removed and kept."""
    for b in batches:
        rows = []
        for rid, text, spans in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "spans"))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            n, kept = take_out(raw, [(x["a"], x["z"]) for x in spans], False)
            rows.append((rid, len(raw) - len(kept), n, kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["rid", "n_removed", "n_spans", "kept"])


@F.pandas_udf(StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans (from, to, from, to, ...); null where either is."""
    out = []
    for t, s in zip(text, spans):
        if t is None or s is None:
            out.append(None)
        else:
            pairs = np.asarray(s, np.int64).reshape(-1, 2).tolist()
            out.append(take_out(t.encode("utf-8", "surrogatepass"), pairs, True)[1].decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype="object")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): every row with its digest and number of rows of equal text, and what repeats cover.

    texts: rid, doc_id, sha, n_bytes, copies, first (true for one row of each text). spans: rid, a, z
    in bytes, for texts of one row only; texts of several rows are repeated whole if long enough.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    scan = materialize(arrow_map(rows, _scan(length), "rid long, doc_id long, sha binary, n_bytes long, keys array<long>, chs array<long>, places array<long>"), "sa-scan")
    groups = scan.groupBy("sha").agg(F.min("rid").alias("first_rid"), F.count("*").alias("copies"))
    texts = materialize(scan.select("rid", "doc_id", "sha", "n_bytes").join(groups, "sha").withColumn("first", F.col("rid") == F.col("first_rid")).drop("first_rid"), "sa-texts")
    # Pieces are counted where the texts are, then those found more than once together, and only then is
    # anything dealt by minimizer: one that a third of all texts hold comes to as many rows as it has
    # different pieces, and a few for each task.
    counted = arrow_map(scan.select("rid", "keys", "chs", "places"), _count, "key long, ch long, n long, rid long, place long")
    one = F.min(F.struct("rid", "place")).alias("p")
    many = counted.where("n > 1").groupBy("key", "ch").agg(F.sum("n").alias("n"), one).select("key", "ch", "n", "p.rid", "p.place")
    dealt = counted.where("n = 1").union(many).repartition(n, "key").groupBy("key", "ch").agg(F.sum("n").alias("n"), one)
    of_key = Window.partitionBy("key")
    same = dealt.select("key", "ch", "n", "p.*", F.sum("n").over(of_key).alias("every"), F.count("*").over(of_key).alias("d"))
    # one occurrence of a minimizer cannot repeat anything
    start, count = F.floor(F.col("place") / PLACE).cast("long"), F.col("place") % PLACE
    same = materialize(same.where("every > 1").select("key", "ch", "n", "d", "rid", start.alias("start"), count.alias("count")), "sa-distinct")
    each = scan.select("rid", F.explode(F.arrays_zip("keys", "chs", "places")).alias("p")).select("rid", F.col("p.keys").alias("key"), F.col("p.chs").alias("ch"), F.col("p.places").alias("place"))
    whole = each.join(same.where("n > 1").select("key", "ch"), ["key", "ch"], "left_semi").select("rid", start.alias("a"), (start + count + length - 1).alias("z"))
    wanted = same.where("d > 1").groupBy("rid").agg(F.collect_list(F.struct("key", "start", "count", (F.col("n") == 1).alias("single"), (F.col("d") > hot).alias("hot"))).alias("wanted"))
    cut = arrow_map(_with_text(docs, wanted.join(texts.select("rid", "doc_id", "sha"), "rid"), "wanted"), _cut(length), "key long, rid long, start long, count long, single boolean, hot boolean, piece binary")
    # both ways take the same shuffled pieces, and their texts the same shuffle as the spans at the end, so
    # each text moves once; the ways pick their pieces themselves, as a filter would be pushed below the shuffle
    cut = cut.repartition(n, "key")
    ordered = arrow_map(cut.sortWithinPartitions("key"), _arrays(length), "rid long, a long, z long")
    at = arrow_map(cut, _starts(length), "h0 long, h1 long, rid long, at long, single boolean")
    twice = at.groupBy("h0", "h1").agg(F.count("*").alias("n")).where("n > 1").select("h0", "h1")
    split = at.where("single").join(twice, ["h0", "h1"]).select("rid", F.col("at").alias("a"), (F.col("at") + length).alias("z"))
    return texts, whole.union(ordered).union(split)


def _with_text(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """rid, text and ``column`` for rows (rid, doc_id, sha, column); the text is found by id and digest.

    Repeated rows give their text more than once, which is a repeat of it anyway.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("s", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    return text.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("sha"))).select("rid", "text", column)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept (bytes; null where the whole text is kept), sha.

    One row for each row of ``docs`` (doc_id, text). A null text is empty; texts shorter than
    ``length`` bytes keep all; repeated rows are copies of each other and lose all if long enough;
    an empty table gives no rows; other columns are ignored. Spans are judged on the input: every
    byte goes that a string of ``length`` bytes covers which also starts anywhere else.
    """
    texts, spans = repeated_spans(docs, length, hot)
    alone = texts.where("copies = 1")
    by_doc = spans.groupBy("rid").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    hit = by_doc.join(alone.select("rid", "doc_id", "sha"), "rid")
    cut = arrow_map(_with_text(docs, hit, "spans"), _finish, "rid long, n_removed long, n_spans long, kept binary")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = texts.join(cut, "rid", "left")
    return out.select(
        "rid", "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("kept")).alias("kept"), "sha",
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with every repeated span taken out of ``text`` and ``n_chars`` counted again; all rows stay, other columns may have any name.

    The other bytes of a character that loses one go too. Spans go to the rows, which move once; what
    is kept never moves, and only texts that lose something pass through Python.
    """
    of, own, sha, cut, new = (spare(c, docs) for c in ("of", "own", "sha", "cut", "new"))
    texts, spans = repeated_spans(docs, length)
    flat = spans.groupBy("rid").agg(F.flatten(F.collect_list(F.array("a", "z"))).alias("spans"))
    part = flat.join(texts.where("copies = 1").select("rid", "doc_id", "sha"), "rid").select("doc_id", "sha", "spans")
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).groupBy("doc_id", "sha").agg(F.max("n_bytes").alias("n")).select("doc_id", "sha", F.array(F.lit(0).cast("long"), F.col("n")).alias("spans"))
    cuts = part.union(whole).select(F.col("doc_id").alias(of), F.col("sha").alias(own), F.col("spans").alias(cut))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(sha, F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))).join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(sha) == F.col(own)), "left")
    out = out.withColumn(new, _without(F.when(F.col(cut).isNotNull(), text), F.col(cut)))
    changed = {"text": F.coalesce(F.col(new), F.col("text")), "n_chars": F.when(F.col(new).isNotNull(), F.length(F.col(new)).cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[(changed[c] if c in changed else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("kept").isNull(), F.lower(F.hex("sha"))).otherwise(F.sha2("kept", 256))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"))

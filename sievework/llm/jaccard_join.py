"""N-gram Jaccard join with Bayesian candidate pruning (after BayesLSH, Satuluri and Parthasarathy, VLDB 2012).

* Texts with the same set of word shingles collapse to one node first, so copies are never paired.
* Nodes that agree in a band of MinHash values may be similar. Within each bucket of a band, cut into
  blocks if it is large, one byte of each MinHash value is compared a few at a time; a pair goes once
  the posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``.
  What stays of a bucket leaves as a spanning forest, and the connected components of all forests
  say which nodes must meet: every pair to verify is inside one component, and no pair is written
  out. Texts that merely share a band do not chain components together.
* A component's nodes meet in blocks of bounded rows and bytes, each block with each other block of
  the component as one unit of work. There whole MinHash values are compared, pruned in the same way,
  and the rest is verified exactly on the shingle sets. One row for each node leaves: how many documents
  it is linked with, and one link of a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import WORD, arrow_map, partitions, spare, table
from sievework.llm.suffix_dedup import prefix_hash, range_hash
from sievework.operators.components import connected_components
from sievework.scratch import materialize

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4 values: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, BAND = 32, 4
HASHES = BANDS * BAND
#: Values compared at a time, and the posterior probability below which a pair goes.
STEP, TOLERANCE = 32, 1e-9
#: Most nodes and bytes of shingles in a block: they bound a task, not what is compared.
BLOCK_NODES, BLOCK_BYTES = 512, 8_000_000
#: Most nodes of a band's bucket in a block, and nodes of a bucket that is compared pair by pair with others at once.
BUCKET_NODES, SMALL = 2048, 8

_MULTIPLY = np.random.default_rng(42).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(43).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one shingle, an empty one none."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], (b != 32) & ((b < 9) | (b > 13)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    w = range_hash(prefix_hash(b, 0), start, end, 0) * np.uint64(0x2545F4914F6CDD1D) + (end - start).astype(np.uint64)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _PLACE[j % 64]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(29)))


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * _MULTIPLY[None, :]).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(m: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for v in m.reshape(BANDS, BAND).T:
        out = (out ^ v) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each n compared, the fewest matches m at which a pair stays.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and the
    probability that it reaches t is that a binomial of n + 1 trials at t gives m at most.
    """
    out, t = {}, Fraction(str(threshold))
    for n in range(STEP, HASHES + 1, STEP):
        total, m = Fraction(0), -1
        while total < Fraction(str(tolerance)):
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, bands, low = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, words)
                m = min_hashes(s) if len(s) else None
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                bands.append(band_keys(m) if len(s) else None)
                low.append(m.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), b.column("xx"), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["rid", "doc_id", "xx", "fp", "n", "bands", "low"])

    return run


def _sets(words: int):
    """The shingle sets of texts that must meet others; the fingerprint tells the right text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sets, mins = [], [], []
            for i, (text, fp) in enumerate(zip(b.column("text").to_pylist(), b.column("fp").to_pylist())):
                s = shingles(text, words)
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == fp:
                    keep.append(i)
                    sets.append(s.tobytes())
                    mins.append(min_hashes(s).tobytes())
            own = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("node", "component", "blocks", "block", "copies")), pa.array(sets, pa.binary()), pa.array(mins, pa.binary())], ["node", "component", "blocks", "block", "copies", "shingles", "mins"])

    return run


def candidates(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tables of MinHash values that the posterior does not rule out."""
    i = j = None
    got = np.zeros(0, np.int64)
    for n, m in least.items():
        if i is None:
            hit = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64)]
            parts = []
            for r in range(0, len(a), 64):
                count = (a[r : r + 64, None, :n] == b[None, :, :n]).sum(2)
                x, y = np.nonzero(count >= m)
                parts.append((x + r, y, count[x, y]))
            i, j, got = (np.concatenate(p) for p in zip(*parts)) if parts else hit
            if same:
                i, j, got = (v[i < j] for v in (i, j, got)) if len(i) else (i, j, got)
        else:
            got = got + (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(1)
            stay = got >= m
            i, j, got = i[stay], j[stay], got[stay]
    return i, j


def forest(nodes: np.ndarray, values: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the pairs that the posterior does not rule out; what is connected is not compared again."""
    rest, out = np.arange(len(nodes)), []
    while len(rest) > 1:
        first, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            met = np.zeros(len(rest), bool)
            for k in range(0, len(front), 256):
                left = np.flatnonzero(~met)
                met[left[np.unique(candidates(values[front[k : k + 256]], values[rest[left]], False, least)[1])]] = True
            front, rest = rest[met], rest[~met]
            out.append((front, np.full(len(front), first)))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (rest[:0], rest[:0])
    return nodes[a], nodes[b]


def _near(least: dict[int, int]):
    """Rows of buckets' units (band, lo, hi): the spanning forest of each; small units are compared many at a time."""

    def small(units: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        nodes, values = (np.concatenate(x) for x in zip(*units))
        size = np.repeat([len(n) for n, _ in units], [len(n) for n, _ in units])
        place = np.arange(len(nodes)) - np.repeat(np.cumsum([0, *(len(n) for n, _ in units[:-1])]), [len(n) for n, _ in units])
        i = np.concatenate([np.flatnonzero(place + k < size) for k in range(1, SMALL)])
        j = i + np.repeat(np.arange(1, SMALL), [int((place + k < size).sum()) for k in range(1, SMALL)])
        got = np.zeros(len(i), np.int64)
        for n, m in least.items():
            got = got + (values[i, n - STEP : n] == values[j, n - STEP : n]).sum(1)
            i, j, got = i[got >= m], j[got >= m], got[got >= m]
        return nodes[j], nodes[i]

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, waiting, rows = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, rows
            if len(held) > 1:
                nodes, values = np.array([h[0] for h in held], np.int64), np.stack([np.frombuffer(h[1], np.uint8) for h in held])
                if len(held) > SMALL:
                    yield edges(*forest(nodes, values, least))
                else:
                    waiting.append((nodes, values))
                    rows += len(held)
            if waiting and rows >= 4096:
                yield edges(*small(waiting))
                waiting, rows = [], 0

        for b in batches:
            for band, lo, hi, node, low in zip(*(b.column(c).to_pylist() for c in ("band", "lo", "hi", "node", "low"))):
                if (band, lo, hi) != unit:
                    yield from close()
                    unit, held = (band, lo, hi), []
                held.append((node, low))
        yield from close()
        if waiting:
            yield edges(*small(waiting))

    return run


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i] and sets[j], pair by pair or, where pairs are dense, as a product of matrices."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = count[inverse] > 1
    row, col = row[often], (np.cumsum(count > 1) - 1)[inverse[often]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
    for c in range(0, int((count > 1).sum()), 2048):
        x = np.zeros((len(sets), 2048), np.float32)
        lo, hi = np.searchsorted(col, [c, c + 2048])
        x[row[lo:hi], col[lo:hi] - c] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def meet(nodes: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], mins: np.ndarray, threshold: float, least: dict[int, int]) -> list[tuple[int, int, int]]:
    """(node, smallest node it is connected with here, documents it is linked with here) of each linked node."""
    one = block == block.min()
    if one.all():
        i, j = candidates(mins, mins, True, least)
    else:
        first, second = np.flatnonzero(one), np.flatnonzero(~one)
        i, j = candidates(mins[first], mins[second], False, least)
        i, j = first[i], second[j]
    if not len(i):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    t = Fraction(str(threshold))
    p, q = t.numerator, t.denominator
    shared = _shared(sets, i, j)
    linked = shared * (p + q) >= p * (size[i] + size[j])  # shared / union >= p / q
    i, j = i[linked], j[linked]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = nodes.copy()
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        if (now == root).all():
            break
        root = now
    return [(int(nodes[k]), int(root[k]), int(links[k])) for k in np.flatnonzero(links)]


def _meet(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = fewest_matches(threshold, TOLERANCE)
        held: dict[int, tuple] = {}
        unit = None

        def solve() -> pa.RecordBatch:
            rows = list(held.values())
            out = meet(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows], np.stack([np.frombuffer(r[4], np.uint32) for r in rows]), threshold, least)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["node", "root", "links"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("component", "lo", "hi", "node", "block", "copies", "shingles", "mins"))):
                if row[:3] != unit:
                    if len(held) > 1:
                        yield solve()
                    held, unit = {}, row[:3]
                held[row[3]] = row[3:]
        if len(held) > 1:
            yield solve()

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """rid, doc_id, xx, class_id, text_id, n_links, class for each row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of
    ``threshold`` at least. ``n_links`` counts the other rows linked directly, copies included;
    ``class_id`` is the smallest doc_id reachable by links, ``text_id`` the smallest doc_id of an
    equal set; ``class`` is a number of the class, ``xx`` the text's xxhash64. Words are divided by ASCII white space; a text of fewer words is one shingle; null
    texts and those without words are linked with nothing and stand in a class of their own.
    Repeated rows are copies and all stay; null doc_ids stay but give no class its id. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("xx", F.xxhash64("text"))
    rows = base.withColumn("rid", F.monotonically_increasing_id())
    sketch = materialize(arrow_map(rows, _sketch(words), "rid long, doc_id long, xx long, fp binary, n long, bands array<long>, low binary"), "nj-sketch")
    nodes = sketch.where("fp is not null").select("fp", "rid", "doc_id", "n", "xx").groupBy("fp").agg(F.min(F.struct("rid", "doc_id", "n", "xx")).alias("r"), F.min("doc_id").alias("text_id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.select("fp", F.col("r.rid").alias("node"), F.col("r.doc_id").alias("at"), F.col("r.n").alias("n"), F.col("r.xx").alias("xx"), "text_id", "copies"), "nj-nodes")
    bands = sketch.select(F.col("rid").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band", F.ceil(F.col("c") / BUCKET_NODES).cast("int").alias("blocks"))
    held = bands.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = held.select("band", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("band", "node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(sketch.select(F.col("rid").alias("node"), "low"), "node")
    near = arrow_map(each.repartition(n, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi"), _near(fewest_matches(threshold, TOLERANCE)), "u long, v long")
    component = connected_components(near)
    members = nodes.join(component, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    members = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    text = base.select(F.col("doc_id").alias("d"), "text", F.col("xx").alias("x"))
    known = text.join(members, F.col("d").eqNullSafe(F.col("at")) & (F.col("x") == F.col("xx"))).select("node", "component", "blocks", "block", "copies", "fp", "text")
    sets = arrow_map(known, _sets(words), "node long, component long, blocks int, block int, copies long, shingles binary, mins binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = sets.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    units = units.repartition(n, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    met = materialize(arrow_map(units, _meet(threshold), "node long, root long, links long"), "nj-met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(met.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.join(links, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    ids = placed.groupBy("class").agg(F.min("text_id").alias("class_id"))
    placed = placed.join(ids, "class").select("fp", "class", "class_id", "text_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketch.select("rid", "doc_id", "xx", "fp").join(placed, "fp", "left")
    alone = F.col("fp").isNull()
    return out.select("rid", "doc_id", "xx", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.coalesce("class", "rid").alias("class"))


def keep_one(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of each class: a row of its smallest doc_id (null last), of the smallest hash of its text.

    Rows without words are in no class and all stay. Rows of one doc_id and text are copies, of
    which one stays; rows of one doc_id with different texts are told apart by them. Other columns
    are carried along, whatever their names; an empty table gives no rows.
    """
    words = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    of, own, key = spare("of", docs), spare("own", docs), spare("key", docs)
    joined = materialize(joined.select("doc_id", "xx", "class"), "nj-joined")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("xx"))
    firsts = joined.groupBy("class").agg(F.min(order).alias("f"))
    firsts = materialize(firsts.select(F.col("f.doc_id").alias(of), F.col("f.xx").alias(own)).distinct(), "nj-firsts")
    hashed = docs.where(words).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(firsts, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(own)), "left_semi")
    if joined.groupBy("doc_id", "xx").agg(F.count("*").alias("n")).where("n > 1 and xx is not null").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.drop(key).unionByName(docs.where(~words))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("rid", "xx", "class")

"""Embedding near-dedup: a robust-pruned flat graph, searched from medoids (after Vamana, DiskANN, NeurIPS 2019).

* Equal vectors of one label collapse to a node first; copies are counted, never paired.
* Centroids are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors, at most
  ``CENTROIDS`` of them); every node is indexed, in the shards of its ``OVERLAP`` nearest centroids of
  its own label. A shard of more than ``SHARD`` nodes is split again by centroids of its own, fitted
  where its nodes are, up to ``LEVELS`` times, so the number of shards grows with the data and their
  size does not. What cannot be split is built in blocks, each with each other one.
* In a shard each node's nearest candidates are robust-pruned: a neighbour that is ``ALPHA`` times
  nearer to one already kept goes. A node's lists from all its shards are united.
* Search runs in cells: a block of a shard's nodes with everything their united lists lead to, all of
  them with their united lists. Each node is a query; it starts at the shard's medoid and greedily
  expands its best ``BEAM`` nodes; every node found in range is expanded too, until the range is
  exhausted. A path that leaves the cell's nodes ends there, which ``audit_recall`` accounts for.
* Links found are verified by cosine in double precision and leave packed, a list for each node of a
  cell and an edge of the cell's spanning forest. ``audit_recall`` counts the links between different
  vectors that were found against brute force, for the nodes with an id divisible by 20 and all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, partitions, table
from sievework.operators.components import connected_components
from sievework.scratch import materialize

THRESHOLD = 0.93
SAMPLE, CENTROIDS, ROUNDS = 20_000, 1024, 8
PER_SHARD, SHARD, OVERLAP = 100, 512, 3
#: How often a shard is split again, into how many at most, fitted on how many of its nodes; and nodes that one task places.
LEVELS, FAN, SPLIT_SAMPLE, SPLIT_NODES = 3, 64, 2048, 50_000
CANDIDATES, DEGREE, NEAREST, ALPHA = 64, 24, 6, 1.2
BEAM, SLACK = 24, 0.02
_EPS = 1e-12


def centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters keep their centre."""
    c = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = (vectors @ c.T).argmax(1)
        for j in range(k):
            own = vectors[of == j]
            if len(own):
                m = own.mean(0)
                c[j] = m / max(np.linalg.norm(m), _EPS)
    return c


def robust_prune(ids: np.ndarray, near: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of candidates ``ids`` by falling cosine ``near``: the nearest ones, then those no kept one covers."""
    order = np.argsort(-near, kind="stable")
    ids, near, v = ids[order], near[order], vectors[order]
    among = v @ v.T
    kept: list[int] = []
    alive = np.ones(len(ids), bool)
    for i in range(len(ids)):
        if len(kept) >= DEGREE:
            break
        if alive[i] or i < NEAREST:
            kept.append(i)
            # squared distance of unit vectors: 2 - 2 cos
            alive &= ALPHA * (1 - among[i]) > (1 - near)
    return ids[kept]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a usable vector keep it as bytes of doubles, others get null."""
    for b in batches:
        out = []
        for label, v in zip(b.column("label").to_pylist(), b.column("embedding").to_pylist()):
            x = None
            if label is not None and v and None not in v:
                a = np.array(v, np.float64)
                if np.isfinite(a).all() and (a != 0).any():
                    x = (a + 0.0).tobytes()  # minus zero equals zero
            out.append(x)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _direction(raw: list[bytes]) -> np.ndarray:
    a = np.stack([np.frombuffer(x, np.float64) for x in raw])
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _assign(centres: dict[tuple[int, int], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, label, raw in zip(*(b.column(c).to_pylist() for c in ("node", "label", "v"))):
                c = centres.get((label, len(raw) // 8))
                near = [0] if c is None else np.argsort(-(c @ _direction([raw])[0]), kind="stable")[:OVERLAP].tolist()
                rows += [(node, label, len(raw) // 8, s, r, raw) for r, s in enumerate(near)]
            kinds = [("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("rank", pa.int32()), ("v", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    held: list[tuple] = []
    now = None
    for b in batches:
        for k, row in zip(zip(*(b.column(c).to_pylist() for c in key)), zip(*(b.column(c).to_pylist() for c in columns))):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pruned lists of one shard's blocks."""
    for _, rows in _groups(batches, ("label", "dim", "shard", "lo", "hi"), ("node", "v", "block")):
        rows = list({r[0]: r for r in rows}.values())
        nodes, v = np.array([r[0] for r in rows], np.int64), _direction([r[1] for r in rows])
        block = np.array([r[2] for r in rows])
        near = v @ v.T
        np.fill_diagonal(near, -2)
        if block.min() != block.max():
            near[block[:, None] == block[None, :]] = -2  # within a block the block itself is built
        out_a, out_b = [], []
        k = min(CANDIDATES, len(rows) - 1)
        for i in range(len(rows) if k > 0 else 0):
            c = np.argpartition(-near[i], k - 1)[:k]
            c = c[near[i][c] > -2]
            kept = robust_prune(c, near[i][c], v[c])
            out_a += [int(nodes[i])] * len(kept)
            out_b += nodes[kept].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["node", "to"])


def range_search(v: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) with a cosine in range, by greedy search on the graph from ``start``."""
    n = len(v)
    degree = max((len(x) for x in lists), default=0)
    graph = np.full((n, max(degree, 1)), -1, np.int64)
    for i, x in enumerate(lists):
        graph[i, : len(x)] = x
    step = max(1, 40_000 // graph.shape[1])
    out_q, out_f = [], []
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        seen = np.full((len(q), n), -2.0)
        done = np.zeros((len(q), n), bool)
        rows = np.arange(len(q))
        seen[:, start] = v[q] @ v[start]
        seen[rows, q] = 1.0  # the query is a node: its own list is a second way in
        while True:
            beam = np.partition(seen, n - min(BEAM, n), axis=1)[:, n - min(BEAM, n)][:, None]
            todo = ~done & (seen > -2) & ((seen >= beam) | (seen >= threshold - SLACK))
            i, j = np.nonzero(todo)
            if not len(i):
                break
            done[i, j] = True
            for c in range(0, len(i), step):  # in parts, so that many nodes in range at once take no more memory
                x, y = np.repeat(i[c : c + step], graph.shape[1]), graph[j[c : c + step]].reshape(-1)
                ok = y >= 0
                ok[ok] = seen[x[ok], y[ok]] == -2
                key = np.unique(x[ok] * n + y[ok])
                x, y = key // n, key % n
                seen[x, y] = np.einsum("ij,ij->i", v[q[x]], v[y])
        i, j = np.nonzero(seen >= threshold)
        other = q[i] != j
        out_q.append(q[i[other]])
        out_f.append(j[other])
    return (np.concatenate(out_q), np.concatenate(out_f)) if out_q else (np.zeros(0, int), np.zeros(0, int))


def _search(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ("label", "dim", "shard", "block"), ("node", "v", "to", "member", "copies")):
            best: dict[int, tuple] = {}
            for r in rows:
                if r[0] not in best or r[3]:
                    best[r[0]] = r
            rows = list(best.values())
            at = {r[0]: i for i, r in enumerate(rows)}
            v = _direction([r[1] for r in rows])
            lists = [np.array([at[t] for t in (r[2] or []) if t in at], np.int64) for r in rows]
            members = np.array([i for i, r in enumerate(rows) if r[3]], np.int64)
            if not len(members) or len(rows) < 2:
                continue
            centre = v[members].mean(0)
            q, f = range_search(v, lists, members, int(members[(v[members] @ centre).argmax()]), threshold)
            sure = np.einsum("ij,ij->i", v[q], v[f]) >= threshold
            yield _adjacency(np.array([r[0] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64), q[sure], f[sure])

    return run


def _adjacency(nodes: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """For each node with links here: its root in a spanning forest of them, and its links with their numbers of copies, packed."""
    key = np.unique(np.concatenate([a * len(nodes) + b, b * len(nodes) + a]))
    a, b = key // len(nodes), key % len(nodes)
    root = nodes.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        if (low == root).all():
            break
        root = low
    first, start = np.unique(a, return_index=True)
    offsets = np.append(start, len(a)).astype(np.int32)
    links = pa.StructArray.from_arrays([pa.array(nodes[b], pa.int64()), pa.array(copies[b], pa.int64())], ["node", "copies"])
    return pa.RecordBatch.from_arrays([pa.array(nodes[first], pa.int64()), pa.array(root[first], pa.int64()), pa.ListArray.from_arrays(offsets, links)], ["node", "root", "links"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centroids of each shard's sample, packed into one row."""
    for (label, dim, shard, k, salts), rows in _groups(batches, ("label", "dim", "shard", "k", "salts"), ("v",)):
        v = _direction([r[0] for r in rows])
        c = centroids(v, min(k, len(v)))
        kinds = [("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("salts", pa.int32()), ("v", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((label, dim, shard, salts, c.tobytes()), kinds)], [n for n, _ in kinds])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, its centroids first: each node with the parts it goes to, two if this is its nearest shard."""
    unit = c = None
    for b in batches:
        rows = []
        for label, dim, shard, salt, side, node, rank, raw in zip(*(b.column(x).to_pylist() for x in ("label", "dim", "shard", "salt", "side", "node", "rank", "v"))):
            if (label, dim, shard, salt) != unit:
                unit, c = (label, dim, shard, salt), None
            if not side:
                c = np.frombuffer(raw, np.float64).reshape(-1, dim)
                continue
            near = [0] if c is None else np.argsort(-(c @ _direction([raw])[0]), kind="stable")[: 1 if rank else 2].tolist()
            rows += [(node, label, dim, shard * (FAN + 1) + 1 + part, rank + i, raw) for i, part in enumerate(near)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_SHARDS)], [n for n, _ in _SHARDS])


_SHARDS = [("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("rank", pa.int32()), ("v", pa.binary())]


def split_shards(shards: DataFrame, n: int) -> DataFrame:
    """``shards`` with those of more than ``SHARD`` nodes split by centroids of their own, level by level."""
    key = ["label", "dim", "shard"]
    names = [c for c, _ in _SHARDS]
    for level in range(LEVELS):
        big = shards.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > SHARD)
        if not big.limit(1).count():
            break
        parts = F.least(F.ceil(F.col("size") / PER_SHARD), F.lit(FAN)).cast("int")
        big = materialize(big.select(*key, "size", parts.alias("k"), F.ceil(F.col("size") / SPLIT_NODES).cast("int").alias("salts")), "vg-big")
        large = shards.join(big, key)
        draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = large.where(draw < F.lit(float(SPLIT_SAMPLE)) / F.col("size")).select(*key, "k", "salts", "v")
        centres = arrow_map(sample.repartition(n, *key).sortWithinPartitions(*key), _fit, "label long, dim int, shard long, salts int, v binary")
        none = lambda t: F.lit(None).cast(t)
        heads = centres.select(*key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), none("long").alias("node"), none("int").alias("rank"), "v")
        rows = large.select(*key, F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "node", "rank", "v")
        unit = [*key, "salt"]
        placed = arrow_map(heads.union(rows).repartition(n, *unit).sortWithinPartitions(*unit, "side"), _place, "node long, label long, dim int, shard long, rank int, v binary")
        rest = shards.join(big.select(*key), key, "left_anti").withColumn("shard", F.col("shard") * (FAN + 1)).select(*names)
        shards = materialize(rest.union(placed), "vg-shards")
    return shards


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, label, n_links, component_id, kept, node for each row of ``vectors`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine of their vectors, in double
    precision, is ``threshold`` at least. Vectors that are null, empty or all zero, or hold a null or
    non-finite component, are linked with nothing, as are vectors of different lengths. n_links
    counts the other rows linked directly, copies and repeated rows included; component_id is the
    smallest vec_id reachable; kept marks it. Null vec_ids stay; an empty table gives no rows.
    """
    return _result(*find_links(vectors, threshold))


def find_links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their usable vectors, nodes, found lists of each cell, all links of each node)."""
    spark = vectors.sparkSession
    n = max(1, partitions(spark))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(arrow_map(rows, _unit, "vec_id long, label long, v binary"), "vg-rows")
    same = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(same, "vg-nodes")
    # a bounded sample: the nodes with the smallest hashes
    picked = nodes.select("label", "v", F.xxhash64("v").alias("h")).orderBy("h", "label").limit(SAMPLE).collect()
    sizes = {(r[0], r[1] // 8): r[2] for r in nodes.groupBy("label", F.octet_length("v")).count().orderBy(F.desc("count")).limit(CENTROIDS).collect()}
    whole = max(1, sum(sizes.values()))
    centres = {}
    for key, count in sizes.items():
        own = [bytes(r["v"]) for r in picked if (r["label"], len(r["v"]) // 8) == key]
        k = min(-(-count // PER_SHARD), max(1, CENTROIDS * count // whole), len(own))
        if k > 1:
            centres[key] = centroids(_direction(own), k)
    shards = materialize(arrow_map(nodes.select("node", "label", "v"), _assign(centres), "node long, label long, dim int, shard long, rank int, v binary"), "vg-shards")
    shards = split_shards(shards, n)
    many = shards.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    placed = shards.join(many, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    key = ["label", "dim", "shard", "lo", "hi"]
    edges = arrow_map(pair.select(*key, "node", "v", "block").repartition(n, *key).sortWithinPartitions(*key), _build, "node long, to long")
    # united lists, of DEGREE nodes from each shard's block at most; a link needs one of its ends to reach the other
    graph = materialize(edges.groupBy("node").agg(F.collect_set("to").alias("to")), "vg-lists")
    known = materialize(nodes.select("node", "v", "copies").join(graph, "node", "left"), "vg-graph")
    cell = ["label", "dim", "shard", "block"]
    members = placed.where("rank = 0").select(*cell, "node")  # each node is a query once, in its nearest shard
    halo = members.join(graph, "node").select(*cell, F.explode("to").alias("node")).distinct()
    near = placed.where("rank > 0").select(*cell, "node").union(halo)
    # rows of a cell: its nodes and what their lists of at most DEGREE a shard lead to, never more than that multiple of the nodes
    cells = members.withColumn("member", F.lit(True)).union(near.withColumn("member", F.lit(False))).groupBy(*cell, "node").agg(F.max("member").alias("member"))
    cells = cells.join(known, "node").repartition(n, *cell).sortWithinPartitions(*cell)
    found = materialize(arrow_map(cells.select(*cell, "node", "v", "to", "member", "copies"), _search(threshold), "node long, root long, links array<struct<node:long,copies:long>>"), "vg-found")
    links = materialize(found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "vg-links")
    return rows, nodes, found, links


def _result(rows: DataFrame, nodes: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.select("node", F.aggregate("links", F.lit(0).cast("long"), lambda k, x: k + x.copies).alias("k"))
    classes = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = nodes.join(counts, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    ids = placed.groupBy("class").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(ids, "class").select(F.col("label").alias("l"), F.col("v").alias("w"), "node", "component_id", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(placed, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), "node")


#: Vectors of a block that the audit compares with another block at once.
AUDIT_BLOCK = 512


def audit_recall(vectors: DataFrame, threshold: float = THRESHOLD, every: int = 20) -> tuple[int, int]:
    """(links found, links there are) between different vectors, of those with a vec_id divisible by ``every``, by brute force against all in blocks."""
    rows, nodes, _, links = find_links(vectors, threshold)
    asked = rows.where(f"v is not null and vec_id % {every} = 0").select("label", "v").distinct()
    queries = nodes.join(asked, ["label", "v"], "left_semi").select("label", "node", "v")

    def packed(df: DataFrame, name: str) -> DataFrame:
        held = df.select("label", F.octet_length("v").alias("dim"), "node", "v")
        blocks = held.groupBy(F.col("label").alias("l"), F.col("dim").alias("d")).agg(F.ceil(F.count("*") / AUDIT_BLOCK).alias("blocks"))
        held = held.join(blocks, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        return held.groupBy("label", "dim", block.alias("block")).agg(F.collect_list(F.struct("node", "v")).alias(name)).drop("block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for q, x in zip(b.column("q").to_pylist(), b.column("x").to_pylist()):
                near = _direction([r["v"] for r in q]) @ _direction([r["v"] for r in x]).T >= threshold
                n += int((near & (np.array([r["node"] for r in q])[:, None] != np.array([r["node"] for r in x])[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    both = packed(queries, "q").join(packed(nodes, "x"), ["label", "dim"]).select("q", "x")
    there = arrow_map(both, count, "n long").agg(F.sum("n")).first()[0] or 0
    got = links.join(queries.select("node"), "node", "left_semi").agg(F.sum(F.size("links"))).first()[0] or 0
    return int(got), int(there)


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP6_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM ok UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014).

Only equi-joins and partially aggregated minima. The minima that edges look up are aggregated, and
Spark does not split a skewed join with such a side by itself; so the edges of a node that holds more
than its share of a task are dealt by a salt (``skew.lookup``), by counts that come with the minima.
Nothing but the number and a digest of the edges reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievework.operators.skew import HEAVY_SHARE, lookup, tasks
from sievework.scratch import materialize

#: Edges that one task joins in a second or two; callers say whether they want that.
SMALL = 20_000


def _low(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """The smallest neighbour of each u, and the nodes that are heavy among ``n_edges`` edges."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(1, n_edges) * HEAVY_SHARE / tasks(edges)
    heavy = low.where(F.col("n") > most).select(F.col("u").alias("key"), F.ceil(F.col("n") / most).cast("int").alias("salts"))
    return low.select(F.col("u").alias("of"), "m"), heavy


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One round over edges (u, v) with u > v; each node's neighbours move to the smallest of them."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, heavy = _low(both, 2 * n_edges)
        moved = lookup(both, low, "u", "of", heavy=heavy).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        low, heavy = _low(edges, n_edges)
        moved = lookup(edges, low, "u", "of", heavy=heavy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(low.select(F.col("of").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with a mark of them taken while they are written; two equal marks in a row mean no edge moved."""
    mark = Observation()
    out = materialize(edges.observe(mark, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")), "cc")
    got = mark.get
    return out, (got["n"], got["s"], got["x"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for all edges at once, in one task: each node's edge to the smallest of its component."""
    low: dict = {}

    def root(x):
        while (y := low.get(x, x)) != x:
            low[x] = low.get(y, y)
            x = y
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            x, y = root(u), root(v)
            low[u], low[v] = low.get(u, u), low.get(v, v)
            low[max(x, y)] = min(x, y)
    ends = [(x, root(x)) for x in low]
    yield pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["u", "v"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    A graph of at most ``small`` edges, counted first, is joined by one task instead of in rounds.
    Null ends, self-loops and repeated edges are ignored; without edges the result is empty. Raises
    if the stars have not settled after ``rounds`` rounds (they halve the depth each time).
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(
        F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))
    ) if {u, v} != {"u", "v"} else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        "u is not null and v is not null and u <> v"
    )
    now, mark = _written(now.distinct())
    if 0 < mark[0] <= small:
        now, mark = materialize(now.coalesce(1).mapInPandas(_joined, now.schema), "cc"), (0,)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        last = mark
        # a large star keeps or lowers the number of edges, so the first mark's serves the small one too
        now, mark = _written(_star(_star(now, True, mark[0]), False, mark[0]))
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Human review of candidate pairs: a log of decisions, folded in order for each group of connected pairs."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievework.operators.components import SMALL, connected_components
from sievework.operators.skew import tasks
from sievework.scratch import materialize

# workers get the fold with the plan, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DECISIONS = ("confirmed_duplicate", "rejected_distinct", "pending")
HOPS = 16
#: Decisions of one connected group that are folded together; more are an error, as a group is one task.
MOST_DECISIONS = 1_000_000
#: States that a task tells at once.
OUT_ROWS = 10_000


class DecisionError(ValueError):
    """A decision that its contract does not allow."""


def check_decision(decision: str, reviewer: str, survivor: int | None = None, note: str | None = None) -> None:
    if decision not in DECISIONS:
        raise DecisionError(f"decision must be one of {DECISIONS}")
    if not 1 <= len(reviewer or "") <= 128:
        raise DecisionError("a reviewer has 1 to 128 characters")
    if survivor is not None and decision != DECISIONS[0]:
        raise DecisionError("only a confirmation names a survivor")
    if note is not None and len(note) > 2000:
        raise DecisionError("a note has 2000 characters at most")


def choose_survivor(pairs: DataFrame, leads: DataFrame) -> DataFrame:
    """lead_a, lead_b, survivor: the better score, then more identifiers, then the older (smaller) key."""
    rank = lambda p: leads.select(F.col("lead_key").alias(f"lead_{p}"), F.struct(F.coalesce("score", F.lit(0.0)), F.col("n_identifiers"), -F.col("lead_key")).alias(f"r{p}"))
    out = pairs.join(rank("a"), "lead_a").join(rank("b"), "lead_b")
    return out.select("lead_a", "lead_b", F.when(F.col("ra") >= F.col("rb"), F.col("lead_a")).otherwise(F.col("lead_b")).alias("survivor"))


def merge_root(pointers: DataFrame) -> DataFrame:
    """lead_key, root for pointers (lead_key, merged_into), by doubling: each round follows twice as far, up to HOPS or until nothing moves."""
    now = pointers.select("lead_key", F.col("merged_into").alias("root"))
    hops = 1
    while hops < HOPS:
        step, moved = now.select(F.col("lead_key").alias("_k"), F.col("root").alias("_r")), Observation()
        now = now.join(step, F.col("root") == F.col("_k"), "left").observe(moved, F.count("_r").alias("n")).select("lead_key", F.coalesce("_r", "root").alias("root"))
        now = materialize(now, "roots")
        if not moved.get["n"]:
            break
        hops *= 2
    return now


_FOLD = "lead_a long, lead_b long, method string, status string, reviewer string, applied_loser long, applied_target long, conflict string"


def _fold_rows(log: list[tuple]) -> list[tuple]:
    """The states (as in ``_FOLD``) that one group's decisions (lead_a, lead_b, method, decision, reviewer, survivor) leave, in the order they stand in."""
    if len(log) > MOST_DECISIONS:
        raise ValueError(f"a connected group of more than {MOST_DECISIONS} decisions")
    into: dict[int, int] = {}
    state: dict[tuple[int, int, str], dict] = {}
    holders: Counter = Counter()  # candidates whose confirmation holds a pointer (loser, target)

    def root(x: int) -> int:
        seen = set()
        while x in into and x not in seen and len(seen) < HOPS:
            seen.add(x)
            x = into[x]
        return x

    for lead_a, lead_b, method, decision, reviewer, survivor in log:
        pair = (lead_a, lead_b)
        s = state.setdefault((*pair, method), {"status": "pending", "reviewer": None, "loser": None, "target": None, "conflict": None})
        holds = (s["loser"], s["target"]) if s["status"] == DECISIONS[0] and s["loser"] is not None else None
        undone = None
        if holds and holders[holds] == 1 and into.get(holds[0]) == holds[1]:  # reverse what it applied, unless another candidate still holds it
            undone = holds[0], into.pop(holds[0])
        loser = target = conflict = None
        if decision == DECISIONS[0]:
            if survivor not in pair:
                conflict = "survivor is not of the pair"
            else:
                loser = pair[1] if survivor == pair[0] else pair[0]
                target = root(survivor)
                if loser == target:
                    conflict = "already merged the other way"
                elif into.get(loser, target) != target:
                    conflict = "already merged elsewhere"
        if conflict:  # a refused decision leaves everything as it was
            s["conflict"] = conflict
            if undone:
                into[undone[0]] = undone[1]
            continue
        if holds:
            holders[holds] -= 1
        if loser is not None:
            into[loser] = target
            holders[loser, target] += 1
        s |= {"status": decision, "reviewer": reviewer, "loser": loser, "target": target, "conflict": None}
    return [(*p, s["status"], s["reviewer"], s["loser"], s["target"], s["conflict"]) for p, s in state.items()]


def _fold(log: pd.DataFrame) -> pd.DataFrame:
    """The same for one group as a frame, in the order of seq."""
    rows = [(int(d.lead_a), int(d.lead_b), d.method, d.decision, d.reviewer, None if pd.isna(d.survivor) else int(d.survivor)) for d in log.sort_values("seq").itertuples(index=False)]
    return pd.DataFrame(_fold_rows(rows), columns=["lead_a", "lead_b", "method", "status", "reviewer", "applied_loser", "applied_target", "conflict"]).astype({"applied_loser": "Int64", "applied_target": "Int64"})


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds groups whose decisions follow one another, by component and seq; most have one or two, so a frame for each would cost more than its fold."""
    names, types = zip(*(x.split() for x in _FOLD.split(", ")))
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in zip(names, types)])
    told: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), schema)], schema=schema)

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for _, group in groupby(rows, itemgetter(0)):
        told += _fold_rows([r[1:] for r in islice(group, MOST_DECISIONS + 1)])
        if len(told) >= OUT_ROWS:
            yield out()
            told = []
    if told:
        yield out()


def fold_decisions(log: DataFrame, survivors: DataFrame | None = None) -> DataFrame:
    """State of each candidate after the log (seq, lead_a, lead_b, method, decision, reviewer, survivor), and the merge it applied.

    A confirmation that names no survivor takes that of ``survivors`` (lead_a, lead_b, survivor);
    without one it is refused. A refused decision changes nothing but ``conflict``. Decisions of pairs
    that share no lead, however far, do not touch each other, so each connected group is folded by
    itself; a group is as large as people's decisions, not as the corpus, and raises an error beyond
    ``MOST_DECISIONS``. (a, b) and (b, a) are one pair, told with the smaller lead first.
    """
    if "method" not in log.columns:
        log = log.withColumn("method", F.lit(""))
    log = log.withColumn("_a", F.least("lead_a", "lead_b")).withColumn("lead_b", F.greatest("lead_a", "lead_b")).withColumn("lead_a", F.col("_a")).drop("_a")
    if survivors is not None:
        log = log.join(survivors.withColumnRenamed("survivor", "_chosen"), ["lead_a", "lead_b"], "left").withColumn("survivor", F.coalesce("survivor", "_chosen")).drop("_chosen")
    comp = connected_components(log.select(F.col("lead_b").alias("u"), F.col("lead_a").alias("v")), small=SMALL).withColumnRenamed("node", "lead_a")
    own = log.join(comp, "lead_a").select("component", "lead_a", "lead_b", "method", "decision", "reviewer", F.col("survivor").cast("long"), "seq")
    # the number is given, since decisions are few bytes and adaptive execution would put them all into one task
    own = own.repartition(tasks(own), "component").sortWithinPartitions("component", F.asc_nulls_last("seq"), "lead_a", "lead_b", "method")
    return own.drop("seq").mapInArrow(_fold_sorted, _FOLD)


def pointers(folded: DataFrame) -> DataFrame:
    """lead_key, merged_into of every lead that an applied confirmation took away; merged_into is the end of its chain."""
    applied = folded.where("status = 'confirmed_duplicate' and applied_loser is not null")
    own = applied.groupBy(F.col("applied_loser").alias("lead_key")).agg(F.min("applied_target").alias("merged_into"))
    return merge_root(own).withColumnRenamed("root", "merged_into")


def with_status(candidates: DataFrame, folded: DataFrame) -> DataFrame:
    """Candidates with the status and reviewer that the folded log leaves them, pending without a decision."""
    last = folded.select("lead_a", "lead_b", "method", "status", "reviewer")
    return candidates.join(last, ["lead_a", "lead_b", "method"], "left").withColumn("status", F.coalesce("status", F.lit("pending")))

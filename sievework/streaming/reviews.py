"""Decisions folded as they come: the state of every candidate and lead pointer, whatever order decisions arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievework.operators.components import connected_components
from sievework.operators.review import _FOLD, _fold
from sievework.scratch import materialize

#: What the fold needs of a decision, and milliseconds that a group waits for others that belong before.
DECISION = ["seq", "lead_a", "lead_b", "method", "decision", "reviewer", "survivor"]
WAIT_MS = 1000


def candidate_groups(pairs: DataFrame) -> DataFrame:
    """lead_key, component of all leads of candidate pairs (lead_a, lead_b): decisions of one group touch each other."""
    found = connected_components(pairs.select(F.greatest("lead_a", "lead_b").alias("u"), F.least("lead_a", "lead_b").alias("v")))
    return materialize(found.select(F.col("node").alias("lead_key"), "component"), "candidate-groups")


class ReviewFold(StatefulProcessor):
    """Keeps a group's decisions by seq and the merges they left; a timer folds them once those that came late are there.

    A decision that is stored again changes nothing. What the fold leaves is kept as a map of pointers
    (lead to the lead it was merged into) and compared with the states told before, so that only
    candidates whose state changed are told again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, number = lambda n: StructField(n, StringType()), lambda n: StructField(n, LongType())
        self.handle = handle
        self.log = handle.getMapState("log", StructType([number("seq")]), StructType([number("lead_a"), number("lead_b"), text("method"), text("decision"), text("reviewer"), number("survivor")]))
        self.told = handle.getMapState("told", StructType([number("lead_a"), number("lead_b"), text("method")]), StructType([text("state")]))
        self.pointers = handle.getMapState("pointers", StructType([number("lead_key")]), StructType([number("merged_into")]))
        self.timer = handle.getValueState("timer", StructType([number("at")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = False
        for batch in rows:
            for d in batch[DECISION].itertuples(index=False):
                if not self.log.containsKey((int(d.seq),)):
                    self.log.updateValue((int(d.seq),), (int(d.lead_a), int(d.lead_b), d.method, d.decision, d.reviewer, None if pd.isna(d.survivor) else int(d.survivor)))
                    new = True
        if new:
            if self.timer.exists():  # one timer a group: it moves on with every batch
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + WAIT_MS
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        log = pd.DataFrame([(k[0], *v) for k, v in self.log.iterator()], columns=DECISION)
        log["survivor"] = log["survivor"].astype("Int64")
        state = _fold(log)
        applied = state[(state["status"] == "confirmed_duplicate") & state["applied_loser"].notna()]
        for k in [k for k, _ in self.pointers.iterator()]:
            self.pointers.removeKey(k)
        for r in applied.itertuples(index=False):
            self.pointers.updateValue((int(r.applied_loser),), (int(r.applied_target),))
        changed = []
        for i, r in enumerate(state.itertuples(index=False)):
            k, text = (int(r.lead_a), int(r.lead_b), r.method), repr(tuple(r))
            if not self.told.containsKey(k) or self.told.getValue(k)[0] != text:
                self.told.updateValue(k, (text,))
                changed.append(i)
        if changed:
            yield state.iloc[changed]

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, groups: DataFrame) -> DataFrame:
    """Changes of candidates' states (the columns of ``fold_decisions``) from a stream of decisions; the last one of a candidate holds.

    ``groups`` is what ``candidate_groups`` gives of the candidates that can be decided on; a decision on
    leads outside of it is a group of its smaller lead. Confirmations name their survivor. Needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    own = stream.select(*[F.col(c) for c in DECISION]).withColumn("_a", F.least("lead_a", "lead_b")).withColumn("lead_b", F.greatest("lead_a", "lead_b")).withColumn("lead_a", F.col("_a")).drop("_a")
    own = own.withColumn("method", F.coalesce("method", F.lit(""))).join(groups, F.col("lead_a") == F.col("lead_key"), "left").withColumn("component", F.coalesce("component", "lead_a")).drop("lead_key")
    return own.groupBy("component").transformWithStateInPandas(ReviewFold(), _FOLD, "Update", "ProcessingTime")

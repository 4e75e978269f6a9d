"""Streams: observations deduplicated within a watermark, events counted in windows, decisions folded as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_observations(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each observation once, if its repeat comes within ``late``; state older than that is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n, total of each window of ``width``; rows later than ``late`` are not waited for."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), "kind", "n", "total")


def _last(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, decision, reviewer = state.get if state.exists else (-1, "pending", "")
    for b in batches:
        newest = b.loc[b["seq"].idxmax()]
        if newest["seq"] > seq:
            seq, decision, reviewer = int(newest["seq"]), newest["decision"], newest["reviewer"]
    state.update((seq, decision, reviewer))
    yield pd.DataFrame({"pair": [key[0]], "seq": [seq], "decision": [decision], "reviewer": [reviewer]})


def latest_decisions(stream: DataFrame) -> DataFrame:
    """pair, seq, decision, reviewer: the decision of the highest seq for each pair, whatever order they come in."""
    kept = "seq long, decision string, reviewer string"
    return stream.groupBy("pair").applyInPandasWithState(_last, f"pair string, {kept}", kept, "update", GroupStateTimeout.NoTimeout)

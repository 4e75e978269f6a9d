"""Upserts by natural key, and tables that are swapped whole."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _latest(df: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """One row for each key: the last by ``order``, then by the other columns in their order, maps as JSON."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.select(*keys).distinct()
    comparable = lambda c: F.to_json(c) if "map<" in df.schema[c].dataType.simpleString() else F.col(c)
    rank = F.struct(*[F.col(c) for c in order], *[comparable(c).alias(f"_{i}") for i, c in enumerate(others) if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_one")).select(*keys, *[F.col(f"_one.{c}").alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``new`` over ``old`` by ``keys``: old values stay in ``keep`` columns, and in ``fill`` columns where the new one is null.

    Rows of either side alone stay, so nothing stale is deleted. Keys compare null-safe; of new rows
    with one key the last by the ``order`` columns stands for all, and of those that tie the one whose
    other columns are largest.
    """
    new = _latest(new, keys, order)
    there = lambda s: F.col(f"{s}._there").isNotNull()
    a, b = old.withColumn("_there", F.lit(1)).alias("a"), new.withColumn("_there", F.lit(1)).alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    out = a.join(b, on, "full_outer")

    def pick(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keep:
            return F.when(there("a"), x).otherwise(y)
        if c in fill:
            return F.coalesce(y, x)
        return F.when(there("b"), y).otherwise(x)

    return out.select(*[pick(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with a row of ``new`` for each key that it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns).dropDuplicates(keys))


def replace_for(old: DataFrame, new: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """Delete then insert: all rows of the ``owners`` are replaced, by default of those that ``new`` has rows of.

    Given apart, owners that came again without any row lose the rows they had.
    """
    gone = (new if owners is None else owners).select(owner).distinct()
    return old.join(gone, owner, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def elect_primary(rows: DataFrame, newest: DataFrame, keys: tuple[str, ...] = ("lead_key", "kind"), value: str = "value", flag: str = "is_primary") -> DataFrame:
    """``rows`` with ``flag`` on one row of each group of ``keys``: that which ``newest`` flags, else one that was flagged before.

    Of several the smallest value is taken, also where none was flagged; so after any number of upserts
    a group has one flagged row. ``value`` names a row within its group.
    """
    chosen = newest.where(flag).groupBy(*keys).agg(F.min(value).alias("_new"))
    flagged = rows.join(chosen, list(keys), "left")
    first = flagged.groupBy(*keys).agg(F.min(F.struct((~F.col(value).eqNullSafe(F.col("_new"))).alias("a"), (~F.col(flag)).alias("b"), F.col(value).alias("v"))).alias("_p"))
    return rows.join(first, list(keys)).withColumn(flag, F.col(value) == F.col("_p.v")).select(*rows.columns)


class Table:
    """A Parquet table whose versions are folders; a pointer file, moved into place whole, names the current one.

    One writer at a time. A reader keeps the version it opened: the one before the current stays,
    older ones are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        names = [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.path}/current-*")) or []]
        return max(names).removeprefix("current-") if names else None

    def read(self) -> DataFrame | None:
        v = self.current()
        return self.spark.read.parquet(f"{self.path}/v-{v}") if v else None

    def write(self, df: DataFrame) -> DataFrame:
        last = self.current()
        version = f"{time.time_ns():020d}"
        df.write.parquet(f"{self.path}/v-{version}")
        self._fs.create(self._path(f"{self.path}/current-{version}")).close()
        if last:
            self._fs.delete(self._path(f"{self.path}/current-{last}"), False)
        for old in self._fs.globStatus(self._path(f"{self.path}/v-*")) or []:
            if old.getPath().getName().removeprefix("v-") < (last or version):
                self._fs.delete(old.getPath(), True)
        return self.read()

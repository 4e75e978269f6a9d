"""Lookups by a key that may hold a large part of all rows.

Spark's adaptive execution splits a skewed join only where both sides come straight from a shuffle; a
side that was aggregated before has a required distribution of its own, and the hot key stays in one
task. Here the heavy keys are found by partial counts, their rows are dealt over several tasks by a
salt, and the few rows that such a key looks up are copied to each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.scratch import materialize

#: A key is heavy from this part of a task's even share of all rows.
HEAVY_SHARE = 0.5


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tasks(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, key: str, n_tasks: int | None = None, share: float = HEAVY_SHARE) -> DataFrame:
    """(key, salts) of the keys with more than ``share`` of a task's rows, and over how many tasks they go.

    Counts are combined before they are shuffled. Only ``n_tasks`` / ``share`` keys can be that heavy,
    which is what bounds the result, whatever the size of ``df``. Null keys look nothing up and are none.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return heavy_of(sizes, "key", "n", n_tasks or tasks(df), share)


def heavy_of(sizes: DataFrame, key: str, n: str, n_tasks: int, share: float = HEAVY_SHARE) -> DataFrame:
    """The same from a table that has the number of rows of each key, as another aggregation of the rows may leave."""
    most = F.col("every") * share / n_tasks
    every = F.broadcast(sizes.agg(F.sum(n).alias("every")))  # one row
    return sizes.select(F.col(key).alias("key"), F.col(n).alias("rows")).crossJoin(every).where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).cast("int").alias("salts"))


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str | None = None, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``df`` joined with ``table`` on ``key`` = ``table_key``, an inner or left join, with heavy keys spread.

    ``heavy`` (key, salts) may be given where it is known already; it is broadcast, so it must be as bounded
    as what ``heavy_keys`` gives. ``table`` should have few rows of each key, as they are copied to every task that has rows of it.
    The columns of both follow one another, ``table_key`` not among them unless it has another name than
    ``key``; other names must differ. Rows of null keys match nothing; repeated rows all stay.
    """
    of = table_key or key
    heavy = materialize(heavy_keys(df, key), "heavy") if heavy is None else heavy
    names = [spare(x, df, table) for x in ("key", "salts", "salt", "of", "at")]
    hk, salts, salt, tk, at = names
    few = F.broadcast(heavy.select(F.col("key").alias(hk), F.col("salts").alias(salts)))
    # rows that are equal are told apart by the partition they come from
    deal = F.pmod(F.hash(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns if _hashable(df, c)]), F.col(salts))
    left = df.join(few, F.col(f"`{key}`") == F.col(hk), "left").withColumn(salt, F.coalesce(deal, F.lit(0))).drop(hk, salts)
    right = table.withColumn(tk, F.col(f"`{of}`")).join(few, F.col(tk) == F.col(hk), "left")
    right = right.withColumn(at, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(hk, salts)
    right = right.drop(of) if of == key else right
    return left.join(right, (F.col(f"`{key}`") == F.col(tk)) & (F.col(salt) == F.col(at)), how).drop(salt, tk, at)


def _hashable(df: DataFrame, c: str) -> bool:
    return not df.schema[c].dataType.simpleString().startswith(("map", "variant"))


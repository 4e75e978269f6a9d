"""Mixing sources to target weights by entropy balancing.

Document rates r = min(cap, base * exp(lambda of its source)) minimise the token-weighted relative
entropy to ``base`` under one token constraint for each source. Its convex dual separates by source,
so every Newton iteration is one grouped aggregation over (source, base) cells and one join; the
duals stay a table and only the number of sources still off target reaches the driver. Rates are
then rounded into whole copies: every document takes floor(r) copies, and the rest of the tokens goes to
documents of about the same fraction of a copy, in the order of a hash, until they have what their
rates add up to; so documents of a higher rate get their extra copy more often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import WORD, spare, table
from sievework.scratch import materialize

#: Weights dealt to the sources by rank, the share of all words that the mix takes, and the most copies.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
TOLERANCE, ITERATIONS = 1e-9, 60
#: Fractions of a copy are rounded within so many bands of equal width.
BANDS = 16


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target for a table (source, source_size) with one row for each source.

    Weights repeat over the sources by code point, null last. A target above ``cap`` times its
    source stops there and the excess goes to the others by weight, until none is above: with the
    sources in the order of size by weight, those that stop are the first of them. The windows order
    all sources in one task: a few numbers for each, so a million sources take tens of megabytes.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.lit([float(x) for x in weights]).cast("array<double>"), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(past), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source whose level it can take sets the level of it and all after it
    s = s.withColumn("fits", F.col("w") * F.col("level") <= F.col("most"))
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(F.col("w") * F.col("level"), F.col("most")), F.col("most")).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP, iterations: int = ITERATIONS) -> DataFrame:
    """source, lambda: Newton's iterations on the dual of each source's token constraint.

    ``cells`` (source, base, tokens) is aggregated; a source without tokens or target, or one whose
    rates are all at the cap below its target, keeps its lambda. Tables of one source or none work;
    the loop ends when every source is within ``TOLERANCE`` of its target; if that takes more than
    ``iterations`` rounds, it raises a RuntimeError.
    """
    dual = targets.select("source", "target", F.lit(0.0).alias("lambda"))
    for _ in range(iterations):
        free = F.col("base") * F.exp("lambda")
        now = cells.join(dual, cells.source.eqNullSafe(dual.source)).select(dual.source, "target", "lambda", (F.col("tokens") * F.least(free, F.lit(cap))).alias("all"), F.when(free < cap, F.col("tokens") * free).otherwise(0.0).alias("slope"))
        now = now.groupBy("source", "target", "lambda").agg(F.sum("all").alias("all"), F.sum("slope").alias("slope"))
        gap = F.col("target") - F.col("all")
        # Newton's step on the logarithm of the constraint; where every rate is at the cap the slope is 0
        scale = F.when(F.col("slope") > 0, F.least(F.col("all") / F.col("slope"), F.lit(8.0))).otherwise(1.0)
        met = (F.abs(gap) <= F.lit(TOLERANCE) * F.greatest("target", F.lit(1.0))) | (F.col("all") <= 0) | (F.col("target") <= 0) | ((F.col("slope") <= 0) & (gap > 0))
        step = F.when(met, 0.0).otherwise(F.ln(F.col("target") / F.col("all")) * scale)
        dual = materialize(now.select("source", "target", (F.col("lambda") + step).alias("lambda"), (step != 0).alias("off")), "mix-dual")
        if not dual.where("off").limit(1).count():
            return dual.select("source", "lambda")
        dual = dual.drop("off")
    raise RuntimeError(f"rates are still off their targets after {iterations} rounds")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, base: str | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each row of ``docs``.

    Needs doc_id, text and source; a null text has size 0, null sources form one source, a null or
    negative ``base`` weight is 0. Documents of size 0 take copies but no words. Rows that tie in
    doc_id stand in the order of size; repeated rows are interchangeable. No document takes more
    than ``cap`` copies, a whole number or rounded up. In each of the ``BANDS`` bands of a source's
    rates the taken words differ from the rates' sum by at most half of one document; a source with
    one ``base`` has one band. An empty table gives no rows; other columns are ignored.
    """
    weight = F.lit(1.0) if base is None else F.greatest(F.coalesce(F.col(base).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), weight.alias("base"))
    rows = materialize(rows, "mix-sizes")
    cells = materialize(rows.groupBy("source", "base").agg(F.sum("size").alias("tokens")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    dual = balance(cells, targets, cap, iterations)
    facts = targets.join(dual.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    facts = facts.withColumnRenamed("source", "of")
    rated = rows.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # a rate within 1e-7 of a whole number is that number: the dual is solved to 1e-9
    rate = F.least(F.col("base") * F.exp("lambda"), F.lit(float(cap)))
    rated = rated.withColumn("rate", F.when(F.abs(rate - F.rint(rate)) < 1e-7, F.rint(rate)).otherwise(rate))
    rated = rated.withColumn("floor", F.floor("rate").cast("long")).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rated = rated.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    rated = rated.withColumn("extra", F.col("size") * (F.col("rate") - F.col("floor")))
    # rows whose rate is whole are a band of their own, in which nothing is left to take
    rated = rated.withColumn("band", F.when(F.col("rate") > F.col("floor"), F.floor((F.col("rate") - F.col("floor")) * BANDS)).otherwise(-1).cast("int"))
    # Running sums in two levels, so that a source with a third of all rows is not one task: sums of
    # 4096 hash ranges of a source's band first, then the order within one range.
    parts = rated.groupBy("source", "band", "part").agg(F.sum("extra").alias("part_extra"), F.sum("size").alias("part_size"))
    before = Window.partitionBy("source", "band").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source", "band")
    ranges = parts.select(F.col("part").alias("p"), F.col("band").alias("b"), F.col("source").alias("of"), F.round(F.sum("part_extra").over(every)).cast("long").alias("want"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    placed = rated.join(ranges, (F.col("part") == F.col("p")) & (F.col("band") == F.col("b")) & F.col("source").eqNullSafe(F.col("of"))).drop("p", "b", "of")
    inside = Window.partitionBy("source", "band", "part").orderBy("h", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = (F.col("rate") > F.col("floor")) & (2 * at + F.col("size") <= 2 * F.col("want"))
    placed = placed.withColumn("copies", F.col("floor") + more.cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that share a doc_id take the same. Other columns may have any name."""
    of, copies, copy = spare("of", docs), spare("copies", docs), spare("copy", docs)
    taken = mixed.groupBy(F.col("doc_id").alias(of)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(of)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, "source", CAST(coalesce(length(regexp_extract_all("text", '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT "source", CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY "source" NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, "source" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY most / w, "source" NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT "source", source_size, coalesce(least(w * (SELECT max(level) FROM l WHERE w * level <= most), most), most) AS target FROM l),
r AS (SELECT d.doc_id, d."source", d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 1.0 END AS rate0 FROM d JOIN t ON d."source" IS NOT DISTINCT FROM t."source"),
f AS (SELECT *, CASE WHEN abs(rate0 - round_even(rate0, 0)) < 1e-7 THEN round_even(rate0, 0) ELSE rate0 END AS rate FROM r),
p AS (SELECT *, CAST(floor(rate) AS BIGINT) AS fl, CAST(round(source_size * (rate - floor(rate))) AS BIGINT) AS want,
   coalesce(sum(size) OVER (PARTITION BY "source" ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM f),
c AS (SELECT *, fl + CASE WHEN rate > fl AND 2 * pos + size <= 2 * want THEN 1 ELSE 0 END AS copies FROM p)
SELECT doc_id, "source", size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM c
"""

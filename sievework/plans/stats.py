"""Statistics over the store, and profiles of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.plans.serve import active, current_scores, merged_leads
from sievework.plans.store import NOW, Store
from sievework.scratch import materialize


def reconcile(s: Store) -> DataFrame:
    """rows_read, leads_total, rows_merged; the first is always the sum of the others."""
    return s.rows.agg(F.count("*").alias("rows_read"), F.countDistinct("lead_key").alias("leads_total")).withColumn("rows_merged", F.col("rows_read") - F.col("leads_total"))


def corpus_stats(s: Store) -> DataFrame:
    gone = merged_leads(s).select("lead_key", F.lit(True).alias("gone"))
    here = F.col("gone").isNull()
    known = F.col("category_slug").isNotNull()
    return s.leads.join(gone, "lead_key", "left").agg(
        F.count_if(here).alias("leads_active"), F.count_if(~here).alias("leads_merged"), F.count_if(here & F.col("company_domain").isNotNull()).alias("with_owned_site"), F.count_if(here & F.col("location_slug").isNotNull()).alias("with_location"),
        F.count_if(here & known).alias("with_category"), F.count_if(here & known & (F.col("category_slug") != fixed.UNCLASSIFIED)).alias("classified"),
    )


def active_scores(s: Store) -> DataFrame:
    return active(s).select("lead_key").join(current_scores(s), "lead_key")


def quality_stats(s: Store) -> DataFrame:
    """Mean and nearest-rank percentiles: the value at place round_half_even(f * (n - 1)).

    Exact order statistics from counts of the distinct scores (two decimals, so 10,001 at most),
    not from one sorted list of all leads.
    """
    c = active_scores(s).groupBy("score").agg(F.count("*").alias("c"))
    c = c.withColumn("upto", F.sum("c").over(Window.orderBy("score"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(float(f)) * (F.col("n") - 1), 0), F.col("score")))
    return c.agg(F.sum("c").alias("n"), F.bround(F.sum(F.col("score") * F.col("c")) / F.sum("c"), 2).alias("mean"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


def quality_histogram(s: Store) -> DataFrame:
    band = F.lit(None).cast("string")
    for name, low, high in fixed.QUALITY_BANDS:
        band = F.when((F.col("score") >= low) & (F.col("score") < high), name).otherwise(band)
    n = active_scores(s).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    names = s.rows.sparkSession.createDataFrame([(b[0],) for b in fixed.QUALITY_BANDS], "band string")
    return names.join(n, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def quality_deciles(s: Store) -> DataFrame:
    return current_scores(s).groupBy(F.least(F.floor(F.col("score") / 10) * 10, F.lit(90)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def coverage(cache: DataFrame, name: str, now: str = NOW) -> DataFrame:
    fresh = F.col("expires_at") > F.lit(now).cast("timestamp_ntz")
    return cache.agg(F.count("*").alias("total"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"), *[F.count_if(F.col("status") == x).alias(x) for x in ("verified", "unreachable", "unknown", "skipped")]).select(F.lit(name).alias("cache"), "*")


def verification_stats(s: Store) -> DataFrame:
    mail = s.identifiers.where("kind = 'email'").join(s.domain_cache.select("domain", "status", "provider"), "domain")
    m = mail.agg(F.countDistinct(F.when(F.col("status") == "verified", F.col("lead_key"))).alias("mailbox_verified"), F.countDistinct(F.when(F.col("status") == "unreachable", F.col("lead_key"))).alias("mailbox_unreachable"), F.countDistinct(F.when(F.col("provider").isin(fixed.MANAGED_PROVIDERS) & ~F.col("free"), F.col("lead_key"))).alias("managed_mail"))
    w = s.identifiers.where("kind = 'website'").join(s.url_cache.where("is_live").select(F.col("url").alias("value")), "value", "left_semi").agg(F.countDistinct("lead_key").alias("website_live"))
    return m.withColumn("_", F.lit(1)).join(w.withColumn("_", F.lit(1)), "_").drop("_")


def review_stats(s: Store) -> DataFrame:
    c = lambda x: F.count_if(F.col("status") == x)
    out = s.candidates.groupBy("method").agg(c("pending").alias("pending"), c("confirmed_duplicate").alias("confirmed"), c("rejected_distinct").alias("rejected"), F.avg("confidence").alias("mean_confidence"))
    return out.withColumn("confirm_rate", F.bround(F.try_divide(F.col("confirmed").cast("double"), F.col("confirmed") + F.col("rejected")), 4))


# Profiles of any table.


def as_text(df: DataFrame, column: str):
    """A value as text: fractions with six decimals, so that engines agree; the others as they are written."""
    c = F.col(f"`{column}`")
    return c.cast("decimal(38,6)").cast("string") if df.schema[column].dataType.typeName() in ("double", "float") else c.cast("string")


def profile_columns(df: DataFrame) -> DataFrame:
    """column, type, non_null, filled (%), distinct, max_length, sample of each column.

    Values are counted by (column, value) first, partially aggregated on either side of the shuffle, so
    no task holds a column's distinct values; ``sample`` is the smallest value as text. A table
    without rows gives zeros and nulls.
    """
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    each = F.array(*[F.struct(F.lit(i).alias("i"), as_text(df, name).alias("value")) for i, (name, _) in enumerate(fields)])
    by_value = df.select(F.explode(each).alias("x")).groupBy("x.i", "x.value").agg(F.count("*").alias("n"))
    has = F.col("value").isNotNull()
    found = by_value.groupBy("i").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("non_null"), F.count("value").alias("distinct"), F.max(F.length("value")).cast("long").alias("max_length"), F.min("value").alias("sample"))
    names = df.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(fields)], "i int, column string, type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return names.join(found, "i", "left").select("column", "type", zero("non_null").alias("non_null"), F.bround(100 * F.col("non_null") / F.col("rows"), 2).alias("filled"), zero("distinct").alias("distinct"), "max_length", "sample")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    # nulls count 0: a condition on the column itself would be pushed below whatever it is derived by, and repeat that
    n = df.groupBy(column).agg(F.count(column).alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def quantiles(df: DataFrame, column: str, below: float, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """min, p<percent> ..., max, share_below: exact quantiles, interpolated between the two nearest values.

    Values are counted, dealt by range and counted on from one range to the next: the only window
    over everything has one row for each range. A table without values gives one row of nulls.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    dealt = materialize(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "quantiles")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(whole), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    placed = dealt.join(before, "part").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    rank = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("x")))
    ends = [c for i, p in enumerate(at) for c in (value(F.floor(rank(p))).alias(f"lo{i}"), value(F.ceil(rank(p))).alias(f"hi{i}"))]
    out = placed.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.max("total").alias("total"), F.sum(F.when(F.col("x") < below, F.col("n")).otherwise(0)).alias("less"), *ends)

    def between(i: int, p: float):
        low, high, r = F.col(f"lo{i}"), F.col(f"hi{i}"), rank(p)
        return F.when(low == high, low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)

    return out.select("min", *[between(i, p).alias(f"p{round(p * 100)}") for i, p in enumerate(at)], "max", (F.col("less") / F.col("total")).alias("share_below"))


def cluster_sizes(rows: DataFrame) -> DataFrame:
    """n_rows, leads: how many leads have how many rows."""
    return rows.groupBy("lead_key").agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("leads"))


def duplicate_signals(df: DataFrame, columns: list[str]) -> DataFrame:
    """signal, groups, rows of every column, and "any": the rows that share a value of at least one."""
    each = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("string").alias("value")) for c in columns])
    tall = df.select("row_id", F.explode(each).alias("s")).select("row_id", "s.*").where("value is not null")
    shared = tall.groupBy("signal", "value").agg(F.count("*").alias("n")).where("n > 1")
    by = shared.groupBy("signal").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))
    rows = tall.join(shared.select("signal", "value"), ["signal", "value"], "left_semi").select("row_id").distinct()
    return by.union(rows.agg(F.lit("any").alias("signal"), F.lit(None).cast("long").alias("groups"), F.count("*").alias("rows")))


def overlap(df: DataFrame, column: str, by: str) -> DataFrame:
    """left, right, shared: distinct values of ``column`` that two groups of ``by`` have in common."""
    one = df.where(F.col(column).isNotNull()).select(F.col(by), F.col(column)).distinct()
    a, b = one.alias("a"), one.alias("b")
    return a.join(b, (F.col(f"a.{column}") == F.col(f"b.{column}")) & (F.col(f"a.{by}") < F.col(f"b.{by}"))).groupBy(F.col(f"a.{by}").alias("left"), F.col(f"b.{by}").alias("right")).agg(F.count("*").alias("shared"))


def agreement(left: DataFrame, right: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """field, n, share: of rows matched on a key, how many agree in each field (null equals null)."""
    j = left.alias("a").join(right.alias("b"), on)
    own = [F.struct(F.lit(f).alias("field"), F.count("*").alias("n"), F.avg(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).cast("double")).alias("share")) for f in fields]
    return j.agg(F.array(*own).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.groupBy(filled.alias("filled")).agg(F.count("*").alias("n"))


def regex_shares(df: DataFrame, tests: dict[str, tuple[str, str]]) -> DataFrame:
    own = [F.struct(F.lit(name).alias("test"), F.avg(F.coalesce(F.col(c).rlike(p), F.lit(False)).cast("double")).alias("share")) for name, (c, p) in tests.items()]
    return df.agg(F.array(*own).alias("a")).select(F.explode("a").alias("x")).select("x.*")


#: Types that a text may be read as, the first that fits; empty and null ones are "null".
VALUE_TYPES = [("boolean", r"(?i)^(true|false|yes|no)$"), ("int", r"^[+-]?\d{1,18}$"), ("decimal", r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), ("date", r"^\d{4}-\d{2}-\d{2}$")]


def value_type(c: F.Column) -> F.Column:
    """null, boolean, int, decimal, date (one of the calendar) or text, of a text without the white space around it."""
    t = F.trim(c.cast("string"))
    out = F.lit("text")
    for name, pattern in reversed(VALUE_TYPES):
        fits = t.rlike(pattern) & t.try_cast("date").isNotNull() if name == "date" else t.rlike(pattern)
        out = F.when(fits, name).otherwise(out)
    return F.when(t.isNull() | (t == ""), "null").otherwise(out)


def merged_type(types: F.Column) -> F.Column:
    """The least type of a list that holds all its values: int and decimal are decimal, other mixtures text, nulls hold in any."""
    own = F.array_except(types, F.array(F.lit("null")))
    return F.when(F.size(own) == 0, "null").when(F.size(own) == 1, own[0]).when(F.size(F.array_except(own, F.array(F.lit("int"), F.lit("decimal")))) == 0, "decimal").otherwise("text")


def type_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, type, n, share, merged: how many values of each text column are of which type, and the type that holds them all.

    One pass over the rows: each is a few pairs (column, type), counted before they are shuffled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value_type(F.col(f"`{c}`")).alias("type")) for c in columns])).alias("x")
    n = df.select(each).groupBy("x.column", "x.type").agg(F.count("*").alias("n"))
    whole = n.groupBy(F.col("column").alias("of")).agg(F.sum("n").alias("all"), merged_type(F.array_sort(F.collect_set("type"))).alias("merged"))
    return n.join(whole, F.col("column") == F.col("of")).select("column", "type", "n", F.bround(100 * F.col("n") / F.col("all"), 4).alias("share"), "merged")

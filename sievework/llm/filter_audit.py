"""How filters interact: every order of five text filters, replayed over the documents' flags.

Each document's flags (which filters it fails) are crossed with a broadcast table of the 120 orders;
the first filter of an order that the document fails removes it. The row is exploded into the
order's five steps and counted by part, order and step. Counts are combined within each task before
the shuffle, so what moves is one row of sums for each group and task, however hot a part is.

A later copy of a text is told by SHA-256 digest and length: each digest's smallest doc_id is found
by an aggregation that combines before it shuffles, and joined back by doc_id, never by digest, so a
text that a third of all rows share stays spread.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import WORD, table
from sievework.scratch import materialize

LETTERS = "ABCDE"
#: A: least words. B: least percentage of distinct words. C: most percentage of capitals. D: characters that fail.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D; a null text is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    return [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * LEAST_DISTINCT,
        F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        text.rlike(SYMBOLS),
    ]


def document_flags(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (bit i: fails filter i of ``LETTERS``), good and toxic of each row of ``docs``.

    ``docs`` needs doc_id, text and the column ``part`` (null: empty string), ``labels`` doc_id,
    quality and toxic. A document without label is neither good nor toxic, one with several is what
    any of them says. Equal doc_ids are no smaller than each other, so repeated rows all pass E or all
    fail it. A row without doc_id has no label, is never a later copy and makes no other row one.
    Other columns are ignored, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    digest = F.concat(F.unhex(F.sha2(text, 256)), F.encode(F.octet_length(text).cast("string"), "UTF-8"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), mask.cast("int").alias("mask"))
    own = materialize(own, "audit-flags")
    first = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first")).withColumnRenamed("digest", "of")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    named, nameless = own.where("doc_id is not null"), own.where("doc_id is null")
    flagged = named.join(first, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    later = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    flagged = flagged.select("part", F.col("mask").bitwiseOR(later).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return flagged.unionByName(nameless.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def filter_orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """filter_order and bits (each step's flag) of every order of the filters: n! rows."""
    rows = [("".join(o), [1 << letters.index(x) for x in o]) for o in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replay(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, filter_order and step: what the step's filter does there, in documents.

    ``flags`` is what ``document_flags`` gives. kept pass this step and all before it, removed pass
    those before it only, redundant fail this filter but were removed before, unique_fails fail this
    filter and no other; good_lost and toxic_lost are removed here and marked so. shapley is what the
    step's filter removes at any step, summed over all orders. An empty table gives no rows.
    """
    steps = len(letters)
    orders = F.broadcast(filter_orders(flags.sparkSession, letters))  # 120 rows for five filters
    fails = [F.col("mask").bitwiseAND(F.col("bits")[i]) != 0 for i in range(steps)]
    first = F.lit(steps + 1)
    for i in reversed(range(steps)):
        first = F.when(fails[i], i + 1).otherwise(first)
    crossed = flags.crossJoin(orders).select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), "bits")
    each = crossed.select("part", "filter_order", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    step, removed = F.col("at") + 1, F.col("first") == F.col("at") + 1
    n = lambda c: F.count(F.when(c, 1))
    counted = each.groupBy("part", "filter_order", step.alias("step")).agg(
        n(F.col("first") > F.col("at") + 1).alias("kept"),
        n(removed).alias("removed"),
        n((F.col("first") <= F.col("at")) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        n(F.col("mask") == F.col("bit")).alias("unique_fails"),
        n(removed & F.col("good")).alias("good_lost"),
        n(removed & F.col("toxic")).alias("toxic_lost"),
    )
    counted = materialize(counted.withColumn("letter", F.expr("substring(filter_order, step, 1)")), "audit-counts")
    worth = counted.groupBy(F.col("part").alias("p"), F.col("letter").alias("l")).agg(F.sum("removed").alias("shapley"))
    return counted.join(worth, (F.col("part") == F.col("p")) & (F.col("letter") == F.col("l"))).drop("p", "l", "letter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
m AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    len(words) < 100 AS fa, 100 * len(list_distinct(words)) < 80 * len(words) AS fb, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS fc,
    regexp_matches(x, '[#$%&*|]') AS fd, coalesce(w.doc_id > least, false) AS fe FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
g AS (SELECT part, good, toxic, CAST(fa AS INTEGER) + 2 * CAST(fb AS INTEGER) + 4 * CAST(fc AS INTEGER) + 8 * CAST(fd AS INTEGER) + 16 * CAST(fe AS INTEGER) AS mask, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT g.*, filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
c AS (SELECT part, filter_order, step, substring(filter_order, step, 1) AS letter,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good), 0) AS good_lost, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic), 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""

"""Containment search on an index of trigrams: postings in a table, intersected by block, then verified.

The index has a row for each trigram and block of keys: the keys of the block whose texts hold the
trigram, sorted. It is written by bucket of the trigram and sorted by it, so a search reads the
partitions and row groups of its own trigrams only. A block spans ``BLOCK`` keys, which bounds a row
however common its trigram is, and blocks are intersected row by row, the rarest trigram first.

What is found is a superset: keys whose texts hold every trigram, or once held them. Verification
against the texts makes it exact. So texts that change need no deletes: their new postings are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a block, and partitions of the index.
BLOCK, BUCKETS = 1 << 16, 64
SIZE = 3


def _bucket(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(BUCKETS))


def postings(texts: DataFrame) -> DataFrame:
    """gram, block, n, keys of ``texts`` (key long, text), by the trigrams in lower case; repeated rows count once, null keys, null texts and shorter ones are left out."""
    low = texts.where("key is not null").select(F.col("key").cast("long").alias("key"), F.lower("text").alias("text")).where(F.length("text") >= SIZE)
    each = low.select("key", "text", F.explode(F.sequence(F.lit(1), F.length("text") - (SIZE - 1))).alias("i")).select("key", F.substr("text", "i", F.lit(SIZE)).alias("gram"))
    block = F.floor(F.col("key") / BLOCK).cast("long")
    # sets of at most BLOCK keys, begun where the texts are: making (gram, key) distinct before would shuffle each of them
    out = each.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_set((F.col("key") - block * BLOCK).cast("int"))).alias("keys"))
    return out.select("gram", "block", F.size("keys").alias("n"), "keys", _bucket(F.col("gram")).alias("bucket"))


def add_texts(texts: DataFrame, path: str) -> None:
    """Make the index at ``path``, or add the postings of new and changed ``texts`` (key, text) to it."""
    rows = postings(texts).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram", "block")
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def compact(texts: DataFrame, path: str, new_path: str) -> None:
    """Write the index of ``texts``, all as they stand, to ``new_path``: without stale postings and with a row for each trigram and block."""
    if path == new_path:
        raise ValueError("an index is compacted to another path, so that searches can go on")
    add_texts(texts, new_path)


def _rows(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    buckets = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "gram string").select(_bucket(F.col("gram"))).collect()})
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(words))


def find_keys(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """(key) of all texts that may hold ``text``; None if it is shorter than a trigram and the index cannot tell.

    Only the numbers of postings of the text's own trigrams reach the driver, to order them.
    """
    low = text.lower()
    words = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    if not words:
        return None
    rows = _rows(spark, path, words)
    sizes = {r[0]: r[1] for r in rows.groupBy("gram").agg(F.sum("n")).collect()}
    if len(sizes) < len(words):
        return spark.createDataFrame([], "key long")
    out = None
    for w in sorted(words, key=lambda w: (sizes[w], w)):
        # rows of later additions stand beside the first one of their block
        own = rows.where(F.col("gram") == w).groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("own"))
        if out is None:
            out = own.withColumnRenamed("own", "keys")
        else:
            out = out.join(own, "block").select("block", F.array_intersect("keys", "own").alias("keys")).where(F.size("keys") > 0)
    return out.select("block", F.explode("keys").alias("at")).select((F.col("block") * BLOCK + F.col("at")).alias("key"))


def contains(column: str, text: str) -> Column:
    """Case-insensitive containment; % and _ stand for themselves."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def search(texts: DataFrame, path: str, text: str) -> DataFrame:
    """(key) of the ``texts`` (key, text) that hold ``text``, each once; a text shorter than a trigram is looked for in all of them."""
    found = find_keys(texts.sparkSession, path, text)
    read = texts if found is None else texts.join(found, "key", "left_semi")
    return read.where(contains("text", text)).select("key").distinct()

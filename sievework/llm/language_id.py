"""Language ID by Bayesian evidence fusion.

For each language l the posterior of a row is proportional to

    p(text | l) * p(declared | l) * p(suffix | l) * p(l | host)

* text: byte trigrams, naive Bayes, trained on a bounded sample of labelled documents; its weight is
  that of ``TEXT_WEIGHT`` trigrams at most, since trigrams of a text are not independent.
* declared (markup language) and suffix (last label of the address): tables estimated over all rows
  by one grouped aggregation each, from the rows' posteriors given their text alone.
* host: a prior smoothed over three levels, all rows, then the registrable domain, then the host,
  again from grouped sums of the texts' posteriors.

A row's own posterior is taken out of every sum that it is judged by. The four tables have a row for
each distinct declared value, suffix, domain and host. They are joined, never collected; the model
alone is collected, ``BUCKETS`` numbers for each language.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from sievework.llm.common import arrow_map, spare, table
from sievework.scratch import materialize

#: Expected documents of each language that the text model is trained on.
TRAIN_DOCS = 1000
#: More languages than that are an error, never left out: the model would not fit a task.
MOST_LANGUAGES = 1000
BUCKETS, SMOOTHING = 1 << 15, 0.5
TEXT_WEIGHT = 60
#: Pseudo-rows of each level's parent in the host prior, and of uniform evidence in the tables.
HOST_WEIGHT, TABLE_WEIGHT = 5.0, 1.0
#: Below this posterior, or without a letter, a row is rejected.
LEAST_POSTERIOR = 0.5


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the text in lower case, everything but letters as one space."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32)
    b = np.concatenate([[32], b[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32) if len(b) else np.array([32, 32], np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


class TextModel:
    """Log-probabilities of trigram buckets by language; a few hundred KB, so it goes with each task."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.table = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32).copy()

    def score(self, text: str | None) -> tuple[list[float], int]:
        """(tempered log-likelihood of each language less the largest, trigrams of letters)."""
        t = trigrams(text)
        if not len(t) or not any(c.isalpha() for c in (text or "")):
            return [0.0] * len(self.languages), 0
        s = self.table[t].sum(0, dtype=np.float64) * min(1.0, TEXT_WEIGHT / len(t))
        return [round(float(x), 9) for x in s - s.max()], len(t)


def train(labelled: DataFrame, text: str = "text", language: str = "lang") -> TextModel | None:
    """Count trigrams of about ``TRAIN_DOCS`` documents of each language, chosen by a hash of the text.

    Rows without text or language are not used. Counts are summed and packed on the executors, one
    row of ``BUCKETS`` numbers for each language reaches the driver. Without any usable row there is
    no model (None); more than ``MOST_LANGUAGES`` languages raise a ValueError.
    """
    named = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(language).cast("string").alias("language"))
    sizes = sorted((r[0], r[1]) for r in named.groupBy("language").count().limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for name, n in sizes for x in (name, min(1.0, TRAIN_DOCS / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = named.where(draw < F.try_element_at(share, F.col("language")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, name in zip(b.column("text").to_pylist(), b.column("language").to_pylist()):
                sums.setdefault(name, np.zeros(BUCKETS, np.int64)).__iadd__(np.bincount(trigrams(t), minlength=BUCKETS))
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], ["language", "bucket", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for at, n in zip(b.column("buckets").to_pylist(), b.column("counts").to_pylist()):
                whole = np.zeros(BUCKETS, "<i8")
                whole[at] = n
                packed.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("language"), pa.array(packed, pa.binary())], ["language", "counts"])

    summed = arrow_map(sample, count, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("language").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).select("language", F.col("c.bucket").alias("buckets"), F.col("c.n").alias("counts"))
    rows = dict(map(tuple, arrow_map(lists, pack, "language string, counts binary").collect()))
    none = np.zeros(BUCKETS)
    names = [n for n, _ in sizes]
    return TextModel(names, np.stack([np.frombuffer(rows[n], "<i8") if n in rows else none for n in names]).astype(float))


#: What identify() reads, besides the columns that it carries along, and what it adds.
EVIDENCE = ["declared", "suffix", "host", "domain"]
ADDED = ["language", "posterior", "rejected", "n_trigrams"]


def _score(model: TextModel, entities: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.score(html.unescape(t) if entities and t else t) for t in b.column("text").to_pylist()]
            soft = []
            for logs, n in found:
                e = np.exp(logs)
                soft.append((e / e.sum() if n else np.zeros(len(e))).tolist())
            lists = pa.list_(pa.float64())
            own = [pa.array([s for s, _ in found], lists), pa.array(soft, lists), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("carried"), *(b.column(c) for c in EVIDENCE), *own], ["carried", *EVIDENCE, "text_ll", "p", "n_trigrams"])

    return run


def _fuse(languages: list[str], total: np.ndarray):
    """Joined evidence (the grouped sums of each row's declared value, suffix, domain and host) to posteriors."""
    size = len(languages)
    base = (total + 1.0 / size) / (total.sum() + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            grid = lambda c: np.array([[0.0] * size if x is None else x for x in b.column(c).to_pylist()])  # noqa: B023,E731
            p, n = grid("p"), b.column("n_trigrams").to_numpy()
            less = lambda c: np.maximum(grid(c) - p, 0.0)  # noqa: B023,E731
            log = grid("text_ll")
            for key in ("declared", "suffix"):
                log = log + np.log((less(f"{key}_s") + TABLE_WEIGHT / size) / (np.maximum(total - p, 0.0) + TABLE_WEIGHT))
            prior = np.broadcast_to(base, p.shape)
            for key in ("domain", "host"):
                sums = np.where(np.array(b.column(f"{key}_s").is_valid())[:, None], less(f"{key}_s"), 0.0)
                prior = (sums + HOST_WEIGHT * prior) / (sums.sum(1, keepdims=True) + HOST_WEIGHT)
            log = log + np.log(prior)
            e = np.exp(log - log.max(1, keepdims=True))
            post = e / e.sum(1, keepdims=True)
            best, top = post.argmax(1), post.max(1)
            rejected = (n == 0) | (top < LEAST_POSTERIOR)
            names = ["und" if no else languages[i] for i, no in zip(best, rejected)]
            own = [pa.array(names, pa.string()), pa.array(top), pa.array(rejected), b.column("n_trigrams")]
            yield pa.RecordBatch.from_arrays([b.column("carried"), *(b.column(c) for c in EVIDENCE), *own], ["carried", *EVIDENCE, *ADDED])

    return run


def identify(rows: DataFrame, model: TextModel | None, entities: bool = False) -> DataFrame:
    """Adds language, posterior, rejected, n_trigrams to rows (key columns, text, declared, suffix, host, domain).

    Other columns are carried along, whatever their names and types; one that is called like an added
    column gives way to it. With ``entities`` character references of the text stand for their
    characters. Nulls: a text without letters gives no text evidence, a null declared value or suffix
    is a value of its own, a null host or domain falls back to the level above. "und" is the language
    of rejected rows; ties go to the first language by name. Repeated rows all stay; an empty table
    gives no rows. Without a model nothing is told: every row is "und" with a null posterior and not
    rejected.
    """
    rest = [c for c in rows.columns if c not in ("text", *EVIDENCE, *ADDED)]
    if model is None:
        none = {"language": F.lit("und"), "posterior": F.lit(None).cast("double"), "rejected": F.lit(False), "n_trigrams": F.lit(0).cast("long")}
        return rows.select(*[F.col(f"`{c}`") for c in rest], *[v.alias(k) for k, v in none.items()], "declared", "suffix", "host")
    size = len(model.languages)
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("carried")
    own = rows.select(carried, *[F.col(c).cast("string").alias(c) for c in ("text", *EVIDENCE)])
    strings = [StructField(c, StringType()) for c in EVIDENCE]
    doubles = ArrayType(DoubleType())
    schema = StructType([own.schema["carried"], *strings, StructField("text_ll", doubles), StructField("p", doubles), StructField("n_trigrams", LongType())])
    scored = materialize(arrow_map(own, _score(model, entities), schema), "lid-scores")
    sums = F.array(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(size)])
    total = np.array(scored.agg(sums).first()[0])
    out = scored
    for key in EVIDENCE:
        group = scored.groupBy(F.col(key).alias("of")).agg(sums.alias(f"{key}_s"))
        if key in ("declared", "suffix"):
            out = out.join(group, F.col(key).eqNullSafe(F.col("of"))).drop("of")
        else:
            out = out.join(group.where("of is not null"), F.col(key) == F.col("of"), "left").drop("of")
    added = [StructField("language", StringType()), StructField("posterior", DoubleType()), StructField("rejected", BooleanType()), StructField("n_trigrams", LongType())]
    told = arrow_map(out, _fuse(model.languages, total), StructType([own.schema["carried"], *strings, *added]))
    return told.select(*[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(rest)], *ADDED, "declared", "suffix", "host")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text (with its character references), declared, suffix, host and domain of web pages (page_id, url, html)."""
    page, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(F.col("page_id"), bare.alias("text"), declared.alias("declared"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), host.alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))


def document_evidence(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, text, declared (their lang) and host (their source); they have no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id"), *keep, F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"))


def without_unsettled(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) without the rows that identify() rejects; equal rows share their fate."""
    key, gone, of = spare("key", docs), spare("gone", docs), spare("of", docs)
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    keyed = docs.withColumn(key, text)
    found = identify(document_evidence(keyed, key), train(docs))
    out = found.where("rejected").select(F.col("doc_id").alias(of), F.col(key).alias(gone)).distinct()
    left = keyed.join(out, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(gone)), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(page_evidence(table(spark, sf_dir, "pages")), train(table(spark, sf_dir, "documents")), entities=True)

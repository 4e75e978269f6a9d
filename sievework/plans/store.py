"""The ingest plan: source rows to resolved, verified and scored tables, each written once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.functions.normalize import normalize_rows
from sievework.operators import quality, resolve, review, rules, verify
from sievework.scratch import materialize
from sievework.sources import batches

#: The time at which caches are judged; a parameter, never the clock.
NOW = "2026-01-15 00:00:00"


#: Bytes of a method above which the JVM does not compile but interprets it.
HUGE_METHOD = 8000


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def plain_constraints(spark: SparkSession) -> AbstractContextManager[None]:
    """Plan without inferring constraints: over the normalisers' many derived columns that takes minutes and finds nothing."""
    return _held(spark, "spark.sql.constraintPropagation.enabled", "false")


def compiled_methods(spark: SparkSession) -> AbstractContextManager[None]:
    """Fuse a stage's operators only where the method they make is one that the JVM compiles; that of many derived columns is interpreted for each row."""
    return _held(spark, "spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))


def even_reads(spark: SparkSession) -> AbstractContextManager[None]:
    """Read a written table by at least three tasks for each core: a few more tasks than cores, as Spark packs small files, take twice the time of one."""
    return _held(spark, "spark.sql.files.minPartitionNum", str(3 * spark.sparkContext.defaultParallelism))


@dataclass
class Store:
    rows: DataFrame
    issues: DataFrame
    leads: DataFrame
    identifiers: DataFrame
    observations: DataFrame
    queries: DataFrame
    companies: DataFrame
    candidates: DataFrame
    decisions: DataFrame
    domain_cache: DataFrame
    url_cache: DataFrame
    signals: DataFrame
    scores: DataFrame
    gazetteer: DataFrame
    merges: DataFrame
    labels: DataFrame


def _digit(c: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.col(c)), 1, 1), 16, 10).cast("int")


def dns_records(domains: DataFrame) -> DataFrame:
    """Recorded answers for mail domains, by the first digit of each one's MD5 (0 does not exist, 1 no answer, 2 no MX)."""
    mx = lambda host: F.array(F.struct(F.lit(10).alias("preference"), host.alias("exchange")))
    none = F.array().cast("array<struct<preference:int,exchange:string>>")
    d = _digit("domain")
    answer = F.when(d == 0, "nxdomain").otherwise("ok")
    hosts = F.when(d <= 2, none).when(d <= 7, mx(F.lit("ASPMX.L.google.com."))).when(d <= 10, mx(F.lit("x.mail.protection.outlook.com"))).when(d <= 12, mx(F.concat(F.lit("mail."), F.col("domain")))).otherwise(mx(F.lit("mx.other.test")))
    return domains.where(d != 1).select("domain", answer.alias("answer"), hosts.alias("mx"))


def http_responses(urls: DataFrame) -> DataFrame:
    """Recorded answers of websites, by the first digit of each url's MD5 (0 parked, 1 no connection, 2 server error, 3 not asked)."""
    d = _digit("url")
    html = F.when(d == 0, "<title>Soon</title> This domain is for sale").otherwise("<title>Shop</title> open")
    code = F.when(d == 1, None).when(d == 2, 503).otherwise(200).cast("int")
    return urls.where(d != 3).select("url", F.when(d == 1, "connect").cast("string").alias("error"), code.alias("code"), html.alias("html"))


def _checked(cache: DataFrame, key: str) -> DataFrame:
    """checked_at from the second digit of the key's MD5, in days of January, and when that expires."""
    day = F.conv(F.substring(F.md5(F.col(key)), 2, 1), 16, 10).cast("int")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=day)
    return cache.withColumn("checked_at", at).withColumn("expires_at", verify.expires(F.col("checked_at"), F.col("status")))


def mail_domains(identifiers: DataFrame) -> DataFrame:
    return identifiers.where("kind = 'email'").groupBy("domain").agg(F.count("*").alias("n"))


def owned_urls(identifiers: DataFrame) -> DataFrame:
    return identifiers.where("kind = 'website' and owned").select(F.col("value").alias("url")).distinct()


def ingest(spark: SparkSession, sf_dir: str, recorded: bool = True) -> Store:
    """All tables of ``sf_dir``; with the ``recorded`` log of decisions, or with none, for a store that has its own."""
    gaz = batches.gazetteer(spark, sf_dir)
    with plain_constraints(spark), compiled_methods(spark), even_reads(spark):
        normalized = materialize(rules.add_rule_codes(normalize_rows(batches.source_rows(spark, sf_dir), gaz, batches.taxonomy(spark), materialize)), "normalized")
    rows = resolve.resolve(normalized)
    issues = materialize(rules.issues(rows).join(rows.select("row_id", "lead_key"), "row_id"), "issues")
    identifiers = materialize(resolve.merge_identifiers(rows), "identifiers")
    leads = materialize(resolve.merge_leads(rows), "leads")
    domains = materialize(_checked(verify.verify_domains(mail_domains(identifiers).select("domain"), dns_records(mail_domains(identifiers))).drop("mx_hosts"), "domain"), "domains")
    urls = owned_urls(identifiers)
    sites = materialize(_checked(verify.verify_urls(urls, http_responses(urls)), "url"), "urls")
    signals = materialize(verify.signals(identifiers, domains, sites), "signals")
    scores = quality.add_scores(quality.add_factors(quality.lead_facts(leads, identifiers, signals, issues)))
    keep = ["lead_key", "score", "base", "penalty_total", "penalties", "factors_evaluated", "weight_available", "rubric_version", *[f"f_{n}" for n in fixed.WEIGHTS]]
    pairs = materialize(resolve.candidates(rows), "candidates")
    scores = materialize(scores.select(*keep), "scores")
    log = decisions(pairs) if recorded else decisions(pairs).limit(0)
    folded = materialize(review.fold_decisions(log, survivors(pairs, leads, scores, identifiers)), "folded")
    return Store(
        rows=rows, issues=issues, leads=leads, identifiers=identifiers, observations=resolve.observations(rows), queries=resolve.source_queries(rows), companies=materialize(resolve.companies(leads, identifiers), "companies"),
        candidates=materialize(review.with_status(pairs, folded), "reviewed"), decisions=log, domain_cache=domains, url_cache=sites, signals=signals, scores=scores, gazetteer=gaz, merges=review.pointers(folded), labels=resolve.weak_labels(rows),
    )


def decisions(pairs: DataFrame) -> DataFrame:
    """A recorded log: of candidates whose keys' sum leaves 0 by five a confirmation that names no survivor, 1 a rejection, in the order of the pairs."""
    turn = (F.col("lead_a") + F.col("lead_b")) % 5
    seq = (F.col("lead_a") * 1_000_000_000 + F.col("lead_b")) * 2 + (F.col("method") == "shared_website").cast("long")
    reviewer = F.concat(F.lit("r"), ((F.col("lead_a") + F.col("lead_b")) % 3).cast("string"))
    return pairs.where(turn <= 1).select(seq.alias("seq"), "lead_a", "lead_b", "method", F.when(turn == 0, "confirmed_duplicate").otherwise("rejected_distinct").alias("decision"), reviewer.alias("reviewer"), F.lit(None).cast("long").alias("survivor"))


def survivors(pairs: DataFrame, leads: DataFrame, scores: DataFrame, identifiers: DataFrame) -> DataFrame:
    """lead_a, lead_b, survivor of each pair, by the score at one decimal, the number of identifiers and age."""
    n = identifiers.groupBy("lead_key").agg(F.count("*").alias("n_identifiers"))
    facts = leads.select("lead_key").join(scores.select("lead_key", F.bround("score", 1).alias("score")), "lead_key").join(n, "lead_key")
    return review.choose_survivor(pairs.select("lead_a", "lead_b").distinct(), facts)


#: The tables that an ingest reads.
INPUTS = ["customer", "supplier", "part", "nation", "region"]
_STORES: dict[tuple[str, str], tuple[tuple, Store]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Size, number of files and time of the last change of each input."""
    out = []
    for name in INPUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = fs.getContentSummary(path)
        out.append((whole.getLength(), whole.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The tables of ``sf_dir``, ingested once in a session and again when its files change."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = _state(spark, sf_dir)
    if _STORES.get(key, (None, None))[0] != state:
        with compiled_methods(spark), even_reads(spark):
            _STORES[key] = state, ingest(spark, sf_dir)
    return _STORES[key][1]

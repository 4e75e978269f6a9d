"""The store as versioned tables: upserts by natural key, run records, reports. Saving twice changes nothing but the runs.

What follows from the log of decisions (the status of candidates, the merges) is never upserted but
folded again from the whole stored log, so a decision that was taken back leaves nothing behind, and
decisions that a reviewer stored hold for every later ingest.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.operators import resolve, review
from sievework.operators.upsert import Table, elect_primary, insert_new, replace_for, upsert
from sievework.plans import stats
from sievework.plans.store import Store, ingest, survivors
from sievework.scratch import materialize

#: Natural keys, and columns whose old value stays.
KEYS = {"rows": ["row_id"], "leads": ["lead_key"], "identifiers": ["lead_key", "kind", "value"], "observations": ["lead_key", "batch"], "companies": ["domain"], "domain_cache": ["domain"], "url_cache": ["url"], "scores": ["lead_key", "rubric_version"], "candidates": ["lead_a", "lead_b", "method"], "gazetteer": ["key"], "signals": ["lead_key"], "labels": ["lead_key", "dimension", "label_source"]}
KEEP = {"leads": ("first_batch",)}
#: Tables that ``review`` makes of the others.
REVIEWED = ("candidates", "decisions", "merges")
FILL = {"companies": ("name", "website")}
RUNS = "run_id string, source string, source_sha256 string, status string, rubric_version string, started_at timestamp_ntz, finished_at timestamp_ntz, stats string"


def rekeyed(s: Store, stored: DataFrame) -> Store:
    """``s`` with the keys of the ``stored`` leads that its leads match by identity key.

    Of several stored leads the first in the order of ``match_stored`` is taken; the others stay as
    they are, for review.
    """
    found = materialize(resolve.match_stored(s.identifiers, stored).where("lead_key <> stored_key").select("lead_key", "stored_key"), "matched")

    def renamed(df: DataFrame, key: str) -> DataFrame:
        own = found.select(F.col("lead_key").alias("_k"), F.col("stored_key").alias("_s"))
        out = df.join(own, F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("_s", key))
        return out.select(*df.columns)

    new = {}
    for f in fields(s):
        df = getattr(s, f.name)
        for key in ("lead_key", "merged_into", "lead_a", "lead_b", "survivor"):
            df = renamed(df, key) if key in df.columns else df
        if "lead_a" in df.columns:  # a pair keeps its smaller key first, and is none if both became one lead
            df = df.where("lead_a <> lead_b").withColumn("_a", F.least("lead_a", "lead_b")).withColumn("lead_b", F.greatest("lead_a", "lead_b")).withColumn("lead_a", F.col("_a")).drop("_a")
        new[f.name] = df
    return Store(**new)


def save(s: Store, path: str) -> dict[str, DataFrame]:
    """Upsert every table under ``path``; issues of re-ingested leads are replaced, queries and decisions only added to.

    A lead that has an identity key of a stored one is that lead, whatever number its rows give it. It
    has one primary identifier of each kind, that of this save where it has one.
    """
    spark = s.rows.sparkSession
    stored = Table(spark, f"{path}/identifiers").read()
    if stored is not None:
        s = rekeyed(s, stored)
    out = {}
    for f in fields(s):
        if f.name in REVIEWED:
            continue
        new, t = getattr(s, f.name), Table(spark, f"{path}/{f.name}")
        old = t.read()
        if old is not None:
            if f.name == "issues":
                new = replace_for(old, new, "lead_key", s.leads)
            elif f.name == "queries":
                new = insert_new(old, new, ["lead_key", "query"])
            else:
                fresh, new = new, upsert(old, new, KEYS[f.name], KEEP.get(f.name, ()), FILL.get(f.name, ()))
                new = elect_primary(new, fresh) if f.name == "identifiers" else new
        out[f.name] = t.write(new)
    chosen = survivors(s.candidates, s.leads, s.scores, s.identifiers)
    return out | save_reviews(spark, path, s.decisions, chosen, s.candidates)


def save_reviews(spark: SparkSession, path: str, decisions: DataFrame, chosen: DataFrame, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Add ``decisions`` to the stored log and fold it again: candidates with their status, decisions, merges.

    A decision whose seq is stored already changes nothing. A confirmation that names no survivor gets
    that of ``chosen`` (lead_a, lead_b, survivor) for good, so later scores do not turn a merge round.
    New ``candidates`` replace the evidence of stored ones; all others stay.
    """
    tables = {n: Table(spark, f"{path}/{n}") for n in REVIEWED}
    log, pairs = tables["decisions"].read(), tables["candidates"].read()
    named = decisions.join(chosen.select("lead_a", "lead_b", F.col("survivor").alias("_chosen")), ["lead_a", "lead_b"], "left")
    confirmed = F.col("decision") == review.DECISIONS[0]
    named = named.withColumn("survivor", F.when(confirmed, F.coalesce("survivor", "_chosen"))).select(*decisions.columns)
    log = tables["decisions"].write(named.dropDuplicates(["seq"]) if log is None else insert_new(log, named, ["seq"]))
    folded = materialize(review.fold_decisions(log), "folded")
    fresh = None if candidates is None else candidates.drop("status", "reviewer")
    if pairs is not None:
        bare = pairs.drop("status", "reviewer")
        fresh = bare if fresh is None else upsert(bare, fresh, KEYS["candidates"])
    if fresh is None:
        raise FileNotFoundError(f"no candidates at {path}")
    return {"decisions": log, "candidates": tables["candidates"].write(review.with_status(fresh, folded)), "merges": tables["merges"].write(review.pointers(folded))}


def decide(spark: SparkSession, path: str, decisions: DataFrame) -> dict[str, DataFrame]:
    """Record a reviewer's decisions (seq, lead_a, lead_b, method, decision, reviewer, survivor) in the store at ``path``."""
    s = load(spark, path)
    return save_reviews(spark, path, decisions, survivors(s.candidates, s.leads, s.scores, s.identifiers))


def reingest(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    """Ingest ``sf_dir`` into the store at ``path`` without any decision of its own: those stored there are the log."""
    return save(ingest(spark, sf_dir, recorded=False), path)


def load(spark: SparkSession, path: str) -> Store:
    found = {f.name: Table(spark, f"{path}/{f.name}").read() for f in fields(Store)}
    if missing := [k for k, v in found.items() if v is None]:
        raise FileNotFoundError(f"no store at {path}: {missing}")
    return Store(**found)


def report(s: Store) -> dict:
    """Counters of an ingest, small by nature: rows by batch, issues by code and severity, candidates by method, scores."""
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    r = stats.reconcile(s).first()
    q = s.scores.agg(F.avg("score"), F.percentile("score", F.lit(0.5))).first()
    return r.asDict() | {"rows_by_batch": count(s.rows, "batch"), "issues_by_code": count(s.issues, "code"), "issues_by_severity": count(s.issues, "severity"), "candidates_by_method": count(s.candidates, "method"), "companies": s.companies.count(), "quality_mean": round(q[0] or 0, 2), "quality_median": q[1], "reconciles": r.rows_read == r.leads_total + r.rows_merged}


def record_run(spark: SparkSession, path: str, run_id: str, source: str, sha256: str, started_at, finished_at, status: str, stats_doc: dict) -> DataFrame:
    """Append a run; a run_id stands once, its last record."""
    row = spark.createDataFrame([Row(run_id, source, sha256, status, fixed.RUBRIC_VERSION, started_at, finished_at, json.dumps(stats_doc, sort_keys=True))], RUNS)
    t = Table(spark, f"{path}/runs")
    old = t.read()
    return t.write(row if old is None else upsert(old, row, ["run_id"]))


def last_reconciliation(runs: DataFrame) -> DataFrame:
    """rows_read, leads_total, rows_merged of the last succeeded run; no row without one."""
    last = runs.where("status = 'SUCCEEDED'").agg(F.max_by("stats", "started_at").alias("s")).where("s is not null")
    return last.select(*[F.get_json_object("s", f"$.{k}").cast("long").alias(k) for k in ("rows_read", "leads_total", "rows_merged")])

import datetime as dt
from dataclasses import fields

from pyspark.sql import functions as F

from sievework.operators import quality
from sievework.plans import sink, stats
from sievework.plans.store import Store, store

SF = "/root/testdata/sf0.001"


def test_saving_twice_changes_nothing(spark, tmp_path):
    s, path = store(spark, SF), str(tmp_path / "store")
    first = {k: sorted(map(str, d.collect())) for k, d in sink.save(s, path).items()}
    second = {k: sorted(map(str, d.collect())) for k, d in sink.save(s, path).items()}
    assert first == second
    assert stats.reconcile(sink.load(spark, path)).first() == stats.reconcile(s).first()


def test_leads_that_come_again_under_other_numbers_are_the_stored_ones(spark, tmp_path):
    s, path = store(spark, SF), str(tmp_path / "store")
    sink.save(s, path)
    moved = {}
    for f in fields(s):
        df = getattr(s, f.name)
        for key in ("lead_key", "merged_into", "lead_a", "lead_b"):
            df = df.withColumn(key, F.col(key) + 500_000_000) if key in df.columns else df
        moved[f.name] = df
    again = sink.save(Store(**moved), path)
    keyed = {r.lead_key for r in s.identifiers.where(F.col("kind").isin("email", "phone", "facebook")).collect()}
    assert {r.lead_key for r in again["leads"].collect() if r.lead_key < 500_000_000} == {r.lead_key for r in s.leads.collect()}
    assert again["leads"].count() == 2 * s.leads.count() - len(keyed)
    assert again["identifiers"].where("lead_key < 500000000").count() == s.identifiers.count()


def test_runs_and_report(spark, tmp_path):
    path, doc = str(tmp_path), sink.report(store(spark, SF))
    assert doc["reconciles"] and sum(doc["rows_by_batch"].values()) == doc["rows_read"] == 182
    at = lambda d: dt.datetime(2026, 1, d)
    sink.record_run(spark, path, "a", "w.xlsx", "0", at(1), at(1), "SUCCEEDED", doc)
    sink.record_run(spark, path, "b", "w.xlsx", "0", at(2), None, "RUNNING", {})
    runs = sink.record_run(spark, path, "c", "w.xlsx", "0", at(3), at(3), "SUCCEEDED", doc | {"rows_read": 183})
    assert runs.count() == 3 and sink.last_reconciliation(runs).first().rows_read == 183
    assert sink.last_reconciliation(runs.where("run_id = 'b'")).count() == 0


def edited(s, **tables):
    return Store(**{f.name: tables.get(f.name, getattr(s, f.name)) for f in fields(s)})


def test_other_addresses_leave_one_primary_and_one_score(spark, tmp_path):
    """A second save in which every lead has another e-mail, and a third with the first ones again."""
    s, path = store(spark, SF), str(tmp_path / "store")
    sink.save(s, path)
    other = edited(s, identifiers=s.identifiers.withColumn("value", F.when(F.col("kind") == "email", F.concat(F.lit("new."), "value")).otherwise(F.col("value"))))
    for again, new in ((other, True), (s, False)):
        sink.save(again, path)
        now = sink.load(spark, path)
        flags = now.identifiers.groupBy("lead_key", "kind").agg(F.count_if("is_primary").alias("n"), F.max_by("value", "is_primary").alias("value"))
        assert flags.where("n <> 1").count() == 0
        assert all(r.value.startswith("new.") == new for r in flags.where("kind = 'email'").collect())
        facts = quality.lead_facts(now.leads, now.identifiers, now.signals, now.issues)
        assert facts.count() == facts.select("lead_key").distinct().count() == s.leads.count()


def test_decisions_taken_back_and_stored_ones(spark, tmp_path):
    """An undone merge is gone from the store, and a later ingest keeps what reviewers stored."""
    s, path = store(spark, SF), str(tmp_path / "store")
    sink.save(s, path)
    merged = {r.lead_key for r in sink.load(spark, path).merges.collect()}
    assert merged == {r.lead_key for r in s.merges.collect()} and merged
    held = s.decisions.where("decision = 'confirmed_duplicate'")
    undo = lambda df: df.select((F.col("seq") + 10**18).alias("seq"), "lead_a", "lead_b", "method", F.lit("pending").alias("decision"), F.lit("x").alias("reviewer"), F.lit(None).cast("long").alias("survivor"))
    out = sink.decide(spark, path, undo(held))
    assert out["merges"].count() == 0 and sink.load(spark, path).candidates.where("status = 'confirmed_duplicate'").count() == 0
    one = s.candidates.orderBy("lead_a", "lead_b").limit(1).select(F.lit(3 * 10**18).alias("seq"), "lead_a", "lead_b", "method", F.lit("confirmed_duplicate").alias("decision"), F.lit("x").alias("reviewer"), F.col("lead_b").alias("survivor"))
    pair = one.first()
    sink.decide(spark, path, one)
    again = sink.reingest(spark, SF, path)
    assert [tuple(r) for r in again["merges"].collect()] == [(pair.lead_a, pair.lead_b)]
    assert again["decisions"].count() == s.decisions.count() + held.count() + 1


def test_issues_that_are_mended_go(spark, tmp_path):
    s, path = store(spark, SF), str(tmp_path / "store")
    sink.save(s, path)
    lead = s.issues.first().lead_key
    sink.save(edited(s, issues=s.issues.where(F.col("lead_key") != lead)), path)
    now = sink.load(spark, path).issues
    assert now.where(F.col("lead_key") == lead).count() == 0 and now.count() == s.issues.where(F.col("lead_key") != lead).count()


def test_the_last_of_new_rows_counts(spark):
    from sievework.operators.upsert import upsert

    kind = "k int, at int, note map<string,string>"
    out = upsert(spark.createDataFrame([(1, 0, {"a": "old"})], kind), spark.createDataFrame([(1, 2, {"a": "a"}), (1, 1, {"a": "z"}), (2, 5, {"b": "x"}), (2, 5, {"b": "y"})], kind), ["k"], order=("at",))
    assert {r.k: (r.at, r.note) for r in out.collect()} == {1: (2, {"a": "a"}), 2: (5, {"b": "y"})}

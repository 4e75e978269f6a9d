"""The invariants of the store, and metamorphic properties of its operators."""

import collections

import pytest
from pyspark.sql import functions as F

from sievework.operators import quality, resolve, review, upsert, verify
from sievework.plans import serve, stats
from sievework.plans.store import store
from sievework.scratch import materialize
from sievework.sources import policy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    return store(spark, SF)


def test_reconciliation_and_nothing_dropped(spark, s):
    r = stats.reconcile(s).first()
    assert (r.rows_read, r.leads_total, r.rows_merged) == (182, 156, 26) and s.leads.count() == 156


def test_clusters_against_union_find(spark, s):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in resolve.identity_keys(s.rows).collect():
        parent[find(r.row_id)] = find(r.key)
    want = collections.defaultdict(set)
    for r in s.rows.select("row_id").collect():
        want[find(r.row_id)].add(r.row_id)
    got = {r.row_id: r.lead_key for r in s.rows.select("row_id", "lead_key").collect()}
    assert all({got[x] for x in group} == {min(group)} for group in want.values())


def test_order_of_rows_does_not_matter(spark, s):
    again = resolve.merge_leads(s.rows.repartition(7, "row_no"))
    assert sorted(map(str, again.collect())) == sorted(map(str, s.leads.collect()))


def test_resemblance_is_not_identity(spark, s):
    lead_of = {r.lead_key for r in s.leads.collect()}
    pairs = s.candidates.collect()
    assert pairs and all(p.lead_a in lead_of and p.lead_b in lead_of and p.lead_a != p.lead_b for p in pairs)


def test_lower_threshold_gives_no_fewer_pairs(spark, s):
    strict, loose = (set(map(tuple, resolve.fuzzy_name_pairs(s.rows, t).select("lead_a", "lead_b").collect())) for t in (92, 60))
    assert strict <= loose and len(loose) > len(strict)


def test_unknown_is_neutral(spark, s):
    facts = quality.lead_facts(s.leads, s.identifiers, s.signals, s.issues)
    unknown = facts.withColumn("mailbox_status", F.lit("unknown")).withColumn("website_status", F.lit("unknown"))
    none = facts.withColumn("mailbox_status", F.lit(None).cast("string")).withColumn("website_status", F.lit(None).cast("string"))
    a, b = ({r.lead_key: r.score for r in quality.add_scores(quality.add_factors(x)).collect()} for x in (unknown, none))
    assert a == b


def test_scores_are_explained(spark, s):
    sums = quality.explain(s.scores).groupBy("lead_key").agg(F.sum("contribution").alias("c"), F.sum(F.when(F.col("measured"), F.col("weight"))).alias("w"))
    for r in sums.join(s.scores, "lead_key").collect():
        assert 0 <= r.score <= 100 and r.c / r.w * 100 == pytest.approx(r.base, abs=0.05)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, first int")
    new = spark.createDataFrame([(2, None, 99), (3, "c", 30), (None, "m", 1)], "k int, v string, first int")
    one = upsert.upsert(old, new, ["k"], keep=("first",), fill=("v",))
    assert sorted(map(tuple, one.collect()), key=str) == sorted([(1, "a", 10), (2, "b", 20), (3, "c", 30), (None, "m", 0)], key=str)
    assert sorted(map(str, upsert.upsert(one, new, ["k"], keep=("first",), fill=("v",)).collect())) == sorted(map(str, one.collect()))
    assert upsert.insert_new(old, new.where("k is not null"), ["k"]).count() == 4 and upsert.replace_for(old, new.where("k = 2"), "k").count() == 3


def test_upsert_takes_one_row_of_each_new_key(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (2, "b"), (2, None)], "k int, v string")
    assert sorted(map(tuple, upsert.upsert(old, new, ["k"]).collect())) == [(1, "y"), (2, "b")]
    assert upsert.insert_new(old, new, ["k"]).where("k = 2").count() == 1 and upsert.upsert(old.select("k"), new.select("k"), ["k"]).count() == 2


def test_rubric_of_ones_own(spark, s):
    facts = quality.add_factors(quality.lead_facts(s.leads, s.identifiers, s.signals, s.issues))
    doc = {"version": "7", "factors": {"identity_present": {"weight": 1}}, "penalties": {"thin_record": {"value": 40}}, "max_total_penalty": 25}
    rubric = quality.Rubric.of(policy.rubric(doc))
    out = quality.add_scores(facts, rubric).collect()
    assert {r.rubric_version for r in out} == {"7"} and {r.factors_evaluated for r in out} == {1}
    assert {r.score for r in out} <= {0.0, 75.0, 100.0} and 75.0 in {r.score for r in out}


def test_store_outlives_other_scratch_tables(spark, s):
    from sievework.scratch import owned, release

    before = s.leads.count()
    with owned("someone"):
        materialize(spark.range(3), "theirs")
    release(spark, "someone")
    assert s.leads.count() == before == store(spark, SF).leads.count()


def test_store_is_ingested_again_when_its_files_change(spark, tmp_path, monkeypatch):
    import shutil

    from sievework.plans import store as module

    made = []
    monkeypatch.setattr(module, "ingest", lambda spark, sf: made.append(sf) or len(made))
    for name in module.INPUTS:
        shutil.copyfile(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    assert module.store(spark, str(tmp_path)) == module.store(spark, str(tmp_path)) == 1
    shutil.copyfile("/root/testdata/sf0.01/part.parquet", tmp_path / "part.parquet")
    assert module.store(spark, str(tmp_path)) == 2


def test_merged_leads_follow_the_chosen_survivor(spark, s):
    folded = spark.createDataFrame([(1, 2, "m", "confirmed_duplicate", 1, 2), (2, 3, "m", "confirmed_duplicate", 2, 3), (5, 6, "m", "rejected_distinct", None, None)], "lead_a long, lead_b long, method string, status string, applied_loser long, applied_target long")
    assert sorted(map(tuple, review.pointers(folded).collect())) == [(1, 3), (2, 3)]
    gone = {r.lead_key: r.merged_into for r in s.merges.collect()}
    assert gone and not set(gone) & {r.lead_key for r in serve.active(s).collect()} and not set(gone) & set(gone.values())
    confirmed = {(r.lead_a, r.lead_b) for r in s.candidates.where("status = 'confirmed_duplicate'").collect()}
    assert confirmed and all(a in gone or b in gone for a, b in confirmed)


def test_page_envelope(spark, s):
    out = serve.page_envelope(s.leads.orderBy("lead_key"), 2, 100)
    assert (out["total"], out["page"], out["page_size"], out["page_count"], out["items"].count()) == (156, 2, 100, 2, 56)


def test_table_versions(spark, tmp_path):
    t = upsert.Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    first = t.write(spark.range(3).toDF("x"))
    second = t.write(t.read().where("x > 0"))
    assert (first.count(), second.count(), t.read().count()) == (3, 2, 2)


def fold(spark, *rows):
    return {(r.lead_a, r.lead_b): r for r in review.fold_decisions(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, lead_a long, lead_b long, decision string, reviewer string, survivor long")).collect()}


def test_review(spark):
    yes, no, undo = review.DECISIONS
    out = fold(spark, (1, 2, yes, "r", 1), (2, 3, yes, "r", 2), (7, 8, no, "r", None), (10, 11, yes, "r", 10), (10, 11, undo, "r", None), (20, 21, yes, "r", 20), (20, 21, yes, "r", 21))
    assert (out[1, 2].applied_loser, out[1, 2].applied_target) == (2, 1) and (out[2, 3].applied_loser, out[2, 3].applied_target) == (3, 1)
    assert out[7, 8].status == no and out[10, 11].status == undo and out[20, 21].applied_target == 21
    out = fold(spark, (1, 2, yes, "r", 1), (1, 3, yes, "r", 1), (2, 3, yes, "r", 2))
    assert out[2, 3].status == yes and out[2, 3].applied_target == 1
    rows = [(0, 1, 2, yes, "r", None), (1, 4, 5, yes, "r", None), (2, 4, 5, no, "q", None)]
    log = spark.createDataFrame(rows, "seq long, lead_a long, lead_b long, decision string, reviewer string, survivor long")
    alone = {(r.lead_a, r.lead_b): r for r in review.fold_decisions(log).collect()}
    assert alone[1, 2].status == "pending" and alone[1, 2].conflict and alone[4, 5].status == no
    chosen = spark.createDataFrame([(1, 2, 2), (4, 5, 4)], "lead_a long, lead_b long, survivor long")
    assert {(r.lead_a, r.lead_b): r.applied_loser for r in review.fold_decisions(log, chosen).collect()} == {(1, 2): 1, (4, 5): None}
    two = [(0, 1, 2, "host", yes, "r", 1), (1, 1, 2, "name", yes, "r", 1), (2, 1, 2, "host", no, "r", None)]
    out = {r.method: r for r in review.fold_decisions(spark.createDataFrame(two, "seq long, lead_a long, lead_b long, method string, decision string, reviewer string, survivor long")).collect()}
    assert out["host"].status == no and (out["name"].status, out["name"].applied_loser) == (yes, 2)
    assert [tuple(r) for r in review.pointers(spark.createDataFrame([tuple(r) for r in out.values()], "lead_a long, lead_b long, method string, status string, reviewer string, applied_loser long, applied_target long, conflict string")).collect()] == [(2, 1)]
    for bad in ({"decision": "maybe", "reviewer": "r"}, {"decision": no, "reviewer": ""}, {"decision": no, "reviewer": "r", "survivor": 1}, {"decision": yes, "reviewer": "r", "note": "x" * 2001}):
        with pytest.raises(review.DecisionError):
            review.check_decision(**bad)


def test_filters_plans_and_pages(spark, s):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan(serve.filter_leads(s, serve.Filters(has=("email",)))) and "LeftAnti" in plan(serve.filter_leads(s, serve.Filters(missing=("email",))))
    pages = [[r.lead_key for r in serve.leads_page(s, serve.Filters(), "-quality", n, 40).collect()] for n in (1, 2, 3, 4, 5)]
    flat = [x for p in pages for x in p]
    assert len(flat) == len(set(flat)) == serve.active(s).count()
    assert serve.page_count(0, 25) == 0 and serve.page_count(26, 25) == 2
    assert serve.filter_leads(s, serve.Filters(q="%")).count() == 0
    for call in (lambda: serve.leads_page(s, serve.Filters(), "nope"), lambda: serve.companies_page(s, sort="nope"), lambda: serve.page(s.leads, 0)):
        with pytest.raises(serve.InvalidRequestError):
            call()


def test_unmeasured_option(spark, s):
    plain = serve.filter_leads(s, serve.Filters(mailbox_status="unknown")).count()
    assert serve.filter_leads(s, serve.Filters(mailbox_status="unknown", include_unmeasured=True)).count() >= plain


def test_verification(spark):
    d = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("d.com",), ("e.com",), ("f.com",)], "domain string")
    mx = "array<struct<preference:int,exchange:string>>"
    rec = spark.createDataFrame([("a.com", "ok", [(20, "z.google.com"), (10, "ASPMX.L.GOOGLE.COM.")]), ("b.com", "nxdomain", []), ("c.com", "ok", []), ("d.com", "ok", [(1, "mail.d.com")]), ("e.com", "ok", [(1, "notgoogle.com")])], f"domain string, answer string, mx {mx}")
    out = {r.domain: (r.status, r.provider) for r in verify.verify_domains(d, rec).collect()}
    assert out == {"a.com": ("verified", "google"), "b.com": ("unreachable", "none"), "c.com": ("unreachable", "none"), "d.com": ("verified", "self_hosted"), "e.com": ("verified", "other"), "f.com": ("unknown", "none")}
    urls = ["https://a/", "ftp://a/", "https://a:99/", "https://p/", "https://dead/", "https://err/", "https://x/", "https://in/"]
    resp = spark.createDataFrame([("https://a/", None, 200, "<title> Hi\n you </title>"), ("https://p/", None, 200, "Welcome to NGINX"), ("https://dead/", "connect", None, None), ("https://err/", None, 503, ""), ("https://in/", "private", None, None)], "url string, error string, code int, html string")
    got = {r.url: (r.status, r.is_live, r.is_parked) for r in verify.verify_urls(spark.createDataFrame([(u,) for u in urls], "url string"), resp).collect()}
    assert got == {"https://a/": ("verified", True, False), "ftp://a/": ("skipped", False, False), "https://a:99/": ("skipped", False, False), "https://p/": ("verified", False, True), "https://dead/": ("unreachable", False, False), "https://err/": ("unknown", False, False), "https://x/": ("unknown", False, False), "https://in/": ("skipped", False, False)}
    ips = {"8.8.8.8": True, "10.0.0.1": False, "127.0.0.1": False, "::1": False, "169.254.1.1": False, "224.0.0.1": False, "nope": False, "2001:4860:4860::8888": True}
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", verify.is_public_ip("ip")).collect()} == ips


def test_components_of_chains_and_hubs(spark):
    from sievework.operators.components import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(500, 500), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 300)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert materialize(spark.range(0), "none").count() == 0


def test_normalisers_run_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    from sievework.plans import store as plan

    key, seen = "spark.sql.codegen.hugeMethodLimit", {}
    before = spark.conf.get(key)

    def written(df, name):
        seen[name] = int(spark.conf.get(key))
        if name == "normalized":
            raise StopIteration
        return df

    monkeypatch.setattr(plan, "materialize", written)
    with pytest.raises(StopIteration):
        plan.ingest(spark, SF)
    assert set(seen) == {"normalized-names", "normalized-contacts", "normalized"} and max(seen.values()) <= 8000
    assert spark.conf.get(key) == before


def test_whole_ingest_runs_in_compiled_methods(spark, monkeypatch):
    from sievework.plans import store as plan

    keys = "spark.sql.codegen.hugeMethodLimit", "spark.sql.files.minPartitionNum"
    before = [spark.conf.get(k, None) for k in keys]
    monkeypatch.setattr(plan, "_STORES", {})
    monkeypatch.setattr(plan, "ingest", lambda spark, sf: [int(spark.conf.get(k)) for k in keys])
    limit, reads = plan.store(spark, SF)
    assert limit <= 8000 and reads >= 3 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(k, None) for k in keys] == before

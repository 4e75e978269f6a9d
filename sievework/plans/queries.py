"""One query for each operator, over the tables' derived source rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.functions import normalize as nz
from sievework.functions import text as tx
from sievework.functions.similarity import token_set_ratio
from sievework.operators import quality, resolve, review, suffixes, trigrams, upsert, verify
from sievework.operators.close import close_matches
from sievework.operators.paging import Key, deep_page
from sievework.operators.redirects import follow_redirects, host_of
from sievework.plans import serve, sink, stats
from sievework.plans.serve import Filters
from sievework.plans.store import NOW, mail_domains, owned_urls, store, survivors
from sievework.scratch import new_dir
from sievework.sources import batches, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def simple(name: str, f: Callable[[object], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(store(spark, sf_dir))


def source(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(batches.source_rows(spark, sf_dir))


# Sources.
source("scan_union_batches", lambda r: r.groupBy("batch", "batch_seq").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row")))
source("row_hash", lambda r: r.select("row_id", batches.row_hash(r, ["name", "email", "phone", "website", "facebook", "city", "followers"]).alias("row_sha256")))


@query("remap_defaults")
def remap_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = batches.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" S.No"), F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("Source"))
    out = batches.remap(raw, batches.Batch("Day_3", 3, {"S.No": "serial", "Name": "name", "Source": "source"}, {"source": "Meta Ads"}))
    return out.select("serial", "name", "source", "batch", F.col("batch_seq").cast("int").alias("batch_seq"), "source_inferred")


@query("dim_categories")
def dim_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.taxonomy(spark).groupBy("slug").agg(F.count("*").alias("aliases"))


@query("dim_locations")
def dim_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.gazetteer(spark, sf_dir).where("slug is not null").select("slug", "name", "state", "match")


@query("clean_cells")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as cells of a sheet: padded, with no-break spaces, blank, or in place of a name what a sheet shows for no number."""
    k, name = F.col("p_partkey"), F.col("p_name")
    cell = F.element_at(F.array(name, F.concat(F.lit("  "), name, F.lit("\t")), F.concat(F.lit("\u00a0"), name, F.lit(" \u00a0")), F.lit(" NaN "), F.lit("-inf"), F.lit(" \u00a0 "), F.lit("")), (k % 7 + 1).cast("int"))
    return batches.table(spark, sf_dir, "part").select("p_partkey", tx.clean(cell).alias("cell"))


@query("lookup_keys")
def lookup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup key and slug of parts' names with accents, signs, hyphens and repeated spaces put in."""
    name = F.concat(F.lit("  \u00c9"), F.col("p_name"), F.lit(" & \u00c7\u00f4.  #"), F.col("p_partkey").cast("string"), F.lit("-\u00d1/"))
    return batches.table(spark, sf_dir, "part").select("p_partkey", tx.key(name).alias("key"), tx.slug(name).alias("slug"))


# Normalisers.
source("norm_email", lambda r: nz.add_email(r).select("row_id", "email_value", "email_typo", "email_confidence"))
source("email_classify", lambda r: nz.add_email(r).select("row_id", "email_domain", "email_free", "email_role", "email_disposable"))
source("norm_phone", lambda r: nz.add_phone(r).select("row_id", "phone_value", "phone_region", "phone_national", "phone_type", "phone_mobile", "phone_confidence"))
source("norm_url", lambda r: nz.add_url(r).select("row_id", "website_value", "website_host", "website_confidence"))
source("url_classify", lambda r: nz.add_url(r).select("row_id", "website_class", "website_owned"))
source("url_handle", lambda r: nz.add_url(r, "facebook", "facebook").select("row_id", "facebook_handle", "facebook_numeric"))
source("norm_followers", lambda r: nz.add_followers(r).select("row_id", "followers_value", "followers_exact", "followers_confidence"))
source("norm_name", lambda r: nz.add_name(r).select("row_id", "name_display", "name_value", "name_placeholder", "name_confidence"))
source("entity_kind", lambda r: nz.add_name(r).select("row_id", "name_kind"))
QUERIES["norm_city"] = lambda spark, d: nz.add_city(batches.source_rows(spark, d), batches.gazetteer(spark, d)).select("row_id", "location_slug", "location_state", "location_match", "location_confidence")
QUERIES["norm_category"] = lambda spark, d: nz.add_category(batches.source_rows(spark, d), batches.taxonomy(spark)).select("row_id", "category_slug", "category_confidence")
simple("normalize_records", lambda s: s.rows.select("row_id", F.explode("field_codes").alias("i")).select("row_id", "i.field", "i.code"))


@query("email_lookalike")
def email_lookalike(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nz.add_email(batches.source_rows(spark, sf_dir)).where("email_domain is not null").groupBy("email_domain").agg(F.count("*").alias("n"))
    return d.select("email_domain", "n", nz.lookalike_of(F.col("email_domain")).alias("resembles"))


@query("url_strip_tracking")
def url_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    return batches.table(spark, sf_dir, "pages").select("page_id", q.alias("query"), nz.strip_tracking(q).alias("kept"))


@query("registrable_domain")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1))
    return batches.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), nz.registrable_domain(host).alias("domain"))


def suffix_rules(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """The fixed rules and, so that all kinds of them meet ``hosts``, one for each domain of these: by its last label ``*.``, an exception or plain."""
    labels = F.split("host", r"\.")
    tail = hosts.where(F.size(labels) >= 3).select(F.array_join(F.slice(labels, -2, 2), ".").alias("two"), F.array_join(F.slice(labels, -3, 3), ".").alias("three"))
    wild = tail.where(F.col("two").endswith(".net")).select(F.concat(F.lit("*."), "two").alias("rule"))
    but = tail.where(F.col("two").endswith(".net") & (F.length("three") % 2 == 0)).select(F.concat(F.lit("!"), "three").alias("rule"))
    plain = tail.where(F.col("two").endswith(".org") & (F.length("three") % 2 == 0)).select(F.col("three").alias("rule"))
    return suffixes.rules_of(spark, fixed.SUFFIX_RULES).union(suffixes.parse_rules(wild.union(but).union(plain).distinct()))


@query("registrable_rules")
def registrable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffix and registrable domain of each page, by a table of plain, wildcard and exception rules."""
    pages = batches.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/?#:]*)", 1)).alias("host"))
    return suffixes.add_domains(pages, "host", suffix_rules(spark, pages.select("host").distinct()))


@query("phone_regions")
def phone_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all regions in five ways of writing, from the customers' keys; some too short, some outside of all ranges."""
    n = len(fixed.PHONE_RULES)
    example = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in fixed.PHONE_RULES]), (F.col("c_custkey") % n + 1).cast("int"))
    k = F.col("c_custkey")
    cut = F.when(k % 19 == 0, F.substring(example(7), 1, 3)).when(k % 17 == 0, F.concat(F.lit("0"), F.substr(example(7), F.lit(2)))).otherwise(F.concat(F.expr("left(n, length(n) - 2)"), F.lpad((k % 100).cast("string"), 2, "0")))
    c = batches.table(spark, sf_dir, "customer").select("c_custkey").withColumn("n", example(7)).withColumn("n", cut).withColumn("c", example(0)).withColumn("t", example(6))
    ways = [F.concat(F.lit("+"), "c", F.lit(" "), "n"), F.concat(F.lit("00"), "c", F.lit("-"), "n"), F.concat(F.lit("+"), "c", "n", F.lit(" ext. 12")), F.concat(F.lit("+"), "c", F.lit(" ("), "t", F.lit(")"), "n"), F.concat(F.lit("+"), "c", F.lit("."), "n", F.lit("x5"))]
    rows = c.select("c_custkey", F.element_at(F.array(*ways), (k % 5 + 1).cast("int")).alias("phone"))
    return nz.add_phone(rows).select("c_custkey", "phone", "phone_value", "phone_region", "phone_national", "phone_type", "phone_mobile", "phone_confidence")


# Rules and resolution.
simple("validate_issues", lambda s: s.issues.join(s.rows.select("row_id").distinct(), "row_id").where(F.col("code").isin("no_name", "no_contact_channel", "email_domain_website_mismatch", "thin_record", "zero_followers", "unverifiable_identity")).select("row_id", "field", "code", "severity"))
simple("issues_by_code", lambda s: s.issues.groupBy("code", "severity").agg(F.count("*").alias("n")))
simple("identity_keys", lambda s: resolve.identity_keys(s.rows))
simple("dedup_clusters", lambda s: resolve.matched_by(s.rows))
simple("dedup_representative", lambda s: s.rows.select("row_id", "lead_key"))
simple("reconcile", stats.reconcile)
simple("pairs_shared_host", lambda s: resolve.shared_host_pairs(s.rows))
simple("pairs_fuzzy_name", lambda s: resolve.fuzzy_name_pairs(s.rows))
simple("merge_leads", lambda s: s.leads)
simple("merge_identifiers", lambda s: s.identifiers.select("lead_key", "kind", "value", "is_primary", "confidence"))
simple("follower_observations", lambda s: s.observations)
simple("source_queries", lambda s: s.queries)
simple("weak_labels", lambda s: s.labels)
simple("latest_followers", lambda s: s.leads.select("lead_key", "latest_followers"))
simple("companies", lambda s: s.companies)
simple("companies_multi_branch", lambda s: s.companies.where("multi_branch").select("domain", "branches"))


@query("token_set_ratio")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = batches.table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return p.join(p.withColumnRenamed("a", "b"), (F.split_part("a", F.lit(" "), F.lit(1)) == F.split_part("b", F.lit(" "), F.lit(1))) & (F.col("a") < F.col("b"))).select("a", "b", F.bround(token_set_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# Scores.
simple("quality_factors", lambda s: s.scores.select("lead_key", *[F.bround(f"f_{n}", 9).alias(n) for n in fixed.WEIGHTS]))
simple("quality_score", lambda s: s.scores.select("lead_key", F.bround("base", 6).alias("base"), "penalty_total", "factors_evaluated", "weight_available", F.bround("score", 1).alias("score_1")))
simple("quality_explain", lambda s: quality.explain(s.scores))
simple("quality_reasons", lambda s: quality.explain_reasons(quality.add_factors(quality.lead_facts(s.leads, s.identifiers, s.signals, s.issues))))
simple("quality_penalties", lambda s: quality.explain_penalties(quality.add_scores(quality.add_factors(quality.lead_facts(s.leads, s.identifiers, s.signals, s.issues)))))


@query("rescore")
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without any verification: unmeasured factors leave both sides of the mean."""
    s = store(spark, sf_dir)
    none = s.signals.select("lead_key", *[F.lit(None).cast(t).alias(c) for c, t in s.signals.dtypes if c != "lead_key"])
    out = quality.add_scores(quality.add_factors(quality.lead_facts(s.leads, s.identifiers, none, s.issues)))
    return out.groupBy("factors_evaluated").agg(F.count("*").alias("n"), F.bround(F.avg("base"), 6).alias("mean_base"))


# Verification.
simple("domains_with_counts", lambda s: mail_domains(s.identifiers))
simple("owned_urls", lambda s: owned_urls(s.identifiers))
simple("verify_domains", lambda s: s.domain_cache.select("domain", "status", "has_mx"))
simple("mail_provider", lambda s: s.domain_cache.select("domain", "provider"))
simple("verify_urls", lambda s: s.url_cache.select("url", "host", "status", "status_code", "is_parked", "is_live"))
simple("verify_pending", lambda s: verify.pending(mail_domains(s.identifiers), s.domain_cache, "domain", F.lit(NOW).cast("timestamp_ntz")))
simple("verify_pending_first", lambda s: verify.pending(mail_domains(s.identifiers), s.domain_cache, "domain", F.lit(NOW).cast("timestamp_ntz"), limit=25))
simple("signals", lambda s: s.signals)


@query("follow_redirects")
def redirects_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url followed over answers derived from the pages: three of five redirect to another page, hosts have addresses by their length."""
    pages = batches.table(spark, sf_dir, "pages").where("url is not null").groupBy(F.regexp_replace("url", "#.*$", "").alias("url")).agg(F.min("page_id").alias("id"), F.min_by("html", "page_id").alias("html"))
    n, host = pages.agg(F.count("*").alias("n_pages")), host_of(F.col("url"))
    to = pages.select(F.col("id").alias("to_id"), F.col("url").alias("location"))
    own = pages.crossJoin(F.broadcast(n)).withColumn("goes", F.when(F.col("id") % 5 < 3, (F.col("id") * 3 + 1) % F.col("n_pages")))
    hops = own.join(to, F.col("goes") == F.col("to_id"), "left").where("id % 29 <> 0")
    error = F.when(F.col("id") % 23 == 0, "connect").when(F.col("id") % 31 == 0, "read")
    code = F.when(error.isNotNull(), None).when(F.col("goes").isNotNull(), F.lit(301) + F.col("id") % 2).when(F.col("id") % 7 == 0, 503).otherwise(200)
    hops = hops.select("url", code.cast("int").alias("code"), "location", error.alias("error"), "html")
    ip = F.when(F.length(host) % 13 == 0, "10.0.0.7").otherwise(F.concat(F.lit("93.184.216."), (F.length(host) % 250).cast("string")))
    addresses = pages.select(host.alias("host"), ip.alias("ip")).where(F.length("host") % 11 != 0).distinct()
    out = follow_redirects(pages.select("url"), hops, addresses)
    return out.select("url", "status", "status_code", "final_url", F.col("redirect_count").cast("long").alias("redirect_count"), F.array_join("redirect_chain", " ").alias("chain"), "error")


QUERIES["html_title"] = lambda spark, d: batches.table(spark, d, "pages").select("page_id", verify.html_title(F.col("html")).alias("title"))
QUERIES["html_parked"] = lambda spark, d: batches.table(spark, d, "pages").select("page_id", verify.looks_parked(F.col("html")).alias("parked"))


@query("verify_report")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    fresh = F.col("expires_at") > F.lit(NOW).cast("timestamp_ntz")
    return mail_domains(s.identifiers).join(s.domain_cache, "domain", "left").agg(F.sum("n").alias("addresses"), F.count("*").alias("domains"), (F.sum("n") - F.count("*")).alias("saved"), F.count_if(F.coalesce(fresh, F.lit(False))).alias("cache_hits"))


@query("is_public_ip")
def public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k % 224).cast("string"), (k % 256).cast("string"), (k % 7).cast("string"), F.lit("1"))
    return batches.table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip"), verify.is_public_ip(ip).alias("public"))


# Serving: filters give lead keys.
def leads_where(name: str, **conditions) -> None:
    simple(name, lambda s: serve.filter_leads(s, Filters(**conditions)).select("lead_key"))


leads_where("leads_active")
leads_where("filter_search", q="clinic")
leads_where("filter_dims", category=("technology", "real_estate"), state=("ASIA", "EUROPE"), location=("china", "japan", "asia", "france", "europe"))
leads_where("filter_entity_kind", entity_kind=("business",), placeholder_name=False)
leads_where("filter_owned_website", owned_website=True)
leads_where("filter_multi_branch", multi_branch=True)
leads_where("filter_company", company="biz3.test", include_merged=True)
leads_where("filter_has_channels", has=("email", "website"))
leads_where("filter_missing_channel", missing=("email",))
leads_where("filter_followers", min_followers=100, max_followers=50_000)
leads_where("filter_quality", min_quality=40.0, max_quality=75.0)
leads_where("filter_mailbox_status", mailbox_status="unreachable")
leads_where("filter_website_status", website_status="verified")
leads_where("filter_mail_provider", mail_provider="google")
leads_where("filter_location", location=("asia", "china", "france"), include_merged=True)
leads_where("filter_issue_code", issue_code="thin_record")
simple("leads_count", lambda s: serve.filter_leads(s, Filters(has=("phone",))).agg(F.count("*").alias("n")))
simple("leads_page", lambda s: serve.leads_page(s, Filters(), "-followers", 2, 25).select("lead_key", "display_name", "latest_followers"))
simple("leads_deep_page", lambda s: serve.leads_page(s, Filters(), "-followers", 31, 25, deep=200).select("lead_key", "display_name", "latest_followers"))
QUERIES["deep_page"] = lambda spark, d: deep_page(batches.table(spark, d, "lineitem"), [Key("l_quantity", True), Key("l_orderkey"), Key("l_linenumber")], 10_000, 5, most=5000).select("l_quantity", "l_orderkey", "l_linenumber")


@query("search_index")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active leads that hold each of four texts, by an index of which a part was added later."""
    s, path = store(spark, sf_dir), new_dir(spark, "trigrams")
    late = s.leads.where("first_batch > 1").select(F.col("lead_key").alias("key"))
    texts = serve.search_texts(s)
    trigrams.add_texts(texts.join(late, "key", "left_anti"), path)
    trigrams.add_texts(texts.join(late, "key", "left_semi"), path)
    out = None
    for q in ("clinic", "BIZ12", "@yahoo.com", "_"):
        found = serve.filter_leads(s, Filters(q=q), path).select(F.lit(q).alias("q"), "lead_key")
        out = found if out is None else out.union(found)
    return out


simple("lead_summary", lambda s: serve.lead_summary(s, serve.active(s)).select("lead_key", "display_name", "entity_kind", "channels", "primary_email", "primary_phone", "primary_website", "followers", "observations", "changed", "issue_count", "mailbox_status", "website_status"))
simple("followers_rollup", serve.followers_rollup)
simple("verification_tristate", serve.tristate)


@query("lead_detail")
def lead_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead with all its children, as text."""
    d = serve.lead_detail(store(spark, sf_dir), 10000008)
    text = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    join = lambda *p: F.concat_ws("|", *p)
    return d.select(
        "lead_key", "display_name", "entity_kind", "category_slug", "location_slug", "company_domain", "channels", "primary_email", "primary_phone", "primary_website", "followers", "issue_count", "mailbox_status", "website_status", "candidate_count",
        text("identifiers", lambda x: join(x.kind, x.value, x.is_primary.cast("string"))), text("metrics", lambda x: join(x.batch_seq.cast("string"), x.value.cast("string"))), text("queries", lambda x: x.query),
        text("issues", lambda x: join(x.field, x.code)), text("siblings", lambda x: join(x.normalized_name, x.key.cast("string"))),
    )


simple("provenance", lambda s: resolve.provenance(s.rows, batches.RAW))
simple("companies_page", lambda s: serve.companies_page(s, min_branches=2, size=50).select("domain", "name", "branch_count", "locations"))
simple("company_detail", lambda s: serve.company_detail(s, "biz6.test").select("company_domain", F.array_join(F.transform("branches", lambda x: x.cast("string")), ",").alias("branches")))
QUERIES["category_counts"] = lambda spark, d: serve.dim_counts(store(spark, d), "category_slug", batches.taxonomy(spark), "slug")
QUERIES["location_counts"] = lambda spark, d: serve.dim_counts(store(spark, d), "location_slug", batches.gazetteer(spark, d).where("slug is not null"), "slug")
simple("review_queue", lambda s: serve.review_queue(s, sort="-confidence", size=50).select("lead_a", "lead_b", "method", "confidence"))
simple("pair_comparison", serve.pair_comparison)
simple("companies_search", lambda s: serve.companies_page(s, q="BIZ1", sort="domain", number=2, size=10).select("domain", "name", "branch_count"))


@query("review_queue_filters")
def review_queue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by method, by a range of confidence, by status and by a lead on either side, each in an order of its own."""
    s, Q = store(spark, sf_dir), serve.QueueFilters
    asked = {
        "method": (Q(status=None, methods=("fuzzy_name",)), "-confidence"), "confidence": (Q(status=None, min_confidence=0.4, max_confidence=0.95), "method"),
        "status": (Q(status="rejected_distinct"), "confidence"), "lead": (Q(status=None, lead=10000008), "-method"),
    }
    out = None
    for name, (f, sort) in asked.items():
        one = serve.review_queue(s, f, sort, size=200).select(F.lit(name).alias("asked"), "lead_a", "lead_b", "method", "confidence")
        out = one if out is None else out.union(one)
    return out



# Statistics.
simple("identifiers_by_kind", lambda s: s.identifiers.groupBy("kind").agg(F.count("*").alias("n")))
simple("leads_by_entity_kind", lambda s: serve.active(s).groupBy("entity_kind").agg(F.count("*").alias("n")))


@query("labels_by_source")
def labels_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of leads and of documents, by where they come from."""
    docs = batches.table(spark, sf_dir, "labels").select(F.explode(F.array(*[F.struct(F.lit(f"document_{c}").alias("label_source"), F.col(c).alias("label")) for c in ("quality", "toxic")])).alias("x")).select("x.*").where("label is not null")
    return store(spark, sf_dir).labels.select("label_source").union(docs.select("label_source")).groupBy("label_source").agg(F.count("*").alias("n"))


simple("corpus_stats", stats.corpus_stats)
simple("quality_stats", lambda s: stats.quality_stats(s).select("n", F.bround("mean", 1).alias("mean"), F.bround("p10", 1).alias("p10"), F.bround("p50", 1).alias("p50"), F.bround("p90", 1).alias("p90")))
simple("quality_histogram", stats.quality_histogram)
simple("quality_deciles", stats.quality_deciles)
simple("factors_coverage", lambda s: stats.active_scores(s).groupBy("factors_evaluated").agg(F.count("*").alias("n")))
simple("verification_coverage", lambda s: stats.coverage(s.domain_cache, "domains").union(stats.coverage(s.url_cache, "urls")))
simple("verification_stats", stats.verification_stats)
simple("review_stats", lambda s: stats.review_stats(s).withColumn("mean_confidence", F.bround("mean_confidence", 6)))
simple("reviewers", lambda s: s.candidates.where("reviewer is not null").groupBy("reviewer").agg(F.count("*").alias("n")))
simple("ingest_report", lambda s: s.rows.groupBy("batch").agg(F.count("*").alias("rows_read")).select(F.lit("rows").alias("counter"), F.col("batch").alias("name"), F.col("rows_read").alias("n")).union(s.candidates.groupBy("method").agg(F.count("*").alias("n")).select(F.lit("candidates"), "method", "n")).union(s.issues.groupBy("severity").agg(F.count("*").alias("n")).select(F.lit("issues"), "severity", "n")))



@query("source_records")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two files by the files' content, saved twice: the second time changes nothing."""
    path = new_dir(spark, "records")
    for _ in range(2):
        files.add_records(files.records(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("customer", "supplier")}), path)
    out = upsert.Table(spark, path).read()
    return out.select("source_sheet", "row_no", F.get_json_object("raw", "$.c_custkey").cast("long").alias("customer"), F.get_json_object("raw", "$.s_suppkey").cast("long").alias("supplier"), (F.length("file_sha256") == 64).alias("by_content"))


# State: batch 3 over batches 1 and 2.
def _first(s, table: str) -> tuple[DataFrame, DataFrame]:
    rows = s.rows.where("batch_seq < 3"), s.rows.where("batch_seq = 3")
    return tuple(getattr(resolve, table)(r) for r in rows)


@query("upsert_companies")
def upsert_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    old = s.leads.where("first_batch < 3 and company_domain is not null").groupBy(F.col("company_domain").alias("domain")).agg(F.min("lead_key").alias("lead"), F.lit("old").alias("seen"))
    new = s.leads.where("last_batch = 3 and company_domain is not null").groupBy(F.col("company_domain").alias("domain")).agg(F.when(F.min("lead_key") % 2 == 0, F.min("lead_key")).alias("lead"), F.lit("new").alias("seen"))
    return upsert.upsert(old, new, ["domain"], fill=("lead",))


simple("upsert_observations", lambda s: upsert.upsert(*_first(s, "observations"), ["lead_key", "batch"]))


@query("upsert_identifiers")
def upsert_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of batches 1 and 2, then of 3: one primary of each kind, that of batch 3 where it has the kind."""
    old, new = (x.select("lead_key", "kind", "value", "is_primary", "confidence") for x in _first(store(spark, sf_dir), "merge_identifiers"))
    return upsert.elect_primary(upsert.upsert(old, new, ["lead_key", "kind", "value"]), new)


@query("saved_merges")
def saved_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of a store that was saved, of which every third confirmation was taken back, and that was read again."""
    s, path = store(spark, sf_dir), new_dir(spark, "reviewed")
    chosen = survivors(s.candidates, s.leads, s.scores, s.identifiers)
    sink.save_reviews(spark, path, s.decisions, chosen, s.candidates)
    undo = s.decisions.where("decision = 'confirmed_duplicate' and (lead_a + lead_b) % 15 = 0")
    undo = undo.select((F.col("seq") + 1_000_000_000_000_000_000).alias("seq"), "lead_a", "lead_b", "method", F.lit("pending").alias("decision"), F.lit("second").alias("reviewer"), "survivor")
    sink.save_reviews(spark, path, undo, chosen)
    return upsert.Table(spark, f"{path}/merges").read().join(upsert.Table(spark, f"{path}/decisions").read().agg(F.count("*").alias("stored_decisions")))


simple("upsert_queries", lambda s: upsert.insert_new(*_first(s, "source_queries"), ["lead_key", "query"]))
simple("upsert_issues", lambda s: upsert.replace_for(*[s.issues.join(s.rows.where(c).select("row_id"), "row_id", "left_semi").select("lead_key", "code").distinct() for c in ("batch_seq < 3", "batch_seq = 3")], "lead_key"))


@query("choose_survivor")
def choose_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return survivors(s.candidates, s.leads, s.scores, s.identifiers)


simple("merged_leads", serve.merged_leads)


@query("reingest_match")
def reingest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of batch 3 by itself against leads of batches 1 and 2, as stored before it came."""
    rows = store(spark, sf_dir).rows.drop("lead_key")
    old, new = (resolve.merge_identifiers(resolve.resolve(rows.where(c))) for c in ("batch_seq < 3", "batch_seq = 3"))
    return resolve.match_stored(new, old)


@query("filter_rubric_version")
def filter_rubric_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads by their score of another rubric, stored beside the current one."""
    s = store(spark, sf_dir)
    other = quality.Rubric(version="0.9", weights={"contact_reachable": 3.0, "owned_website": 2.0, "identity_present": 1.0}, penalties={"thin_record": 20.0}, most_penalty=10.0)
    more = quality.add_scores(quality.add_factors(quality.lead_facts(s.leads, s.identifiers, s.signals, s.issues), other), other).select(*s.scores.columns)
    return serve.filter_leads(replace(s, scores=s.scores.union(more)), Filters(min_quality=55.0, rubric_version="0.9", include_merged=True)).select("lead_key")


@query("merge_root")
def merge_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of customers, each pointing to its number less its lowest set bit, down to 0 or 16 hops."""
    c = batches.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_key")).where("lead_key > 0")
    return review.merge_root(c.withColumn("merged_into", F.col("lead_key") - F.col("lead_key").bitwiseAND(-F.col("lead_key"))))


@query("review_fold")
def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded decisions, and after them a rejection of every third confirmed pair."""
    s = store(spark, sf_dir)
    again = s.decisions.where("decision = 'confirmed_duplicate' and (lead_a + lead_b) % 15 = 0").withColumn("seq", F.col("seq") + 1_000_000_000_000_000_000).withColumn("decision", F.lit("rejected_distinct")).withColumn("reviewer", F.lit("second"))
    return review.fold_decisions(s.decisions.union(again), survivors(s.candidates, s.leads, s.scores, s.identifiers))


# Profiles.
QUERIES["profile_columns"] = lambda spark, d: stats.profile_columns(batches.table(spark, d, "orders"))
QUERIES["profile_topk"] = lambda spark, d: stats.top_values(batches.table(spark, d, "lineitem"), "l_partkey", 20)
source("profile_types", lambda r: stats.type_histogram(r.withColumn("serial", F.col("k").cast("string")), ["serial", "name", "email", "followers", "city", "matched_query", "relevance"]))
QUERIES["profile_close_matches"] = lambda spark, d: close_matches(nz.add_email(batches.source_rows(spark, d)).select("email_domain"), spark.createDataFrame([(m,) for m in fixed.MAJORS], "domain string"), 0.85)
QUERIES["close_names"] = lambda spark, d: close_matches(batches.table(spark, d, "customer").select("c_name"), batches.table(spark, d, "supplier").select("s_name"), 0.6, most=3)
source("profile_duplicates", lambda r: stats.duplicate_groups(nz.add_phone(r), "phone_value"))
QUERIES["profile_quantiles"] = lambda spark, d: stats.quantiles(batches.table(spark, d, "lineitem"), "l_extendedprice", 1000.0).withColumn("share_below", F.bround("share_below", 9))
source("profile_signals", lambda r: stats.duplicate_signals(nz.add_url(nz.add_phone(nz.add_email(r))), ["phone_value", "email_value", "website_value"]))
simple("cluster_sizes", lambda s: stats.cluster_sizes(s.rows))
source("profile_overlap", lambda r: stats.overlap(nz.add_email(r), "email_value", "batch"))
source("profile_agreement", lambda r: stats.agreement(r.where("batch_seq = 1").select("k", "name", "email", "followers"), r.where("batch_seq = 3").select("k", "name", "email", "followers"), "k", ["name", "email", "followers"]))
source("profile_crosstab", lambda r: stats.crosstab(r.where("fb_category is not null"), "batch", "fb_category"))
source("profile_completeness", lambda r: stats.completeness(r, ["email", "website", "fb_category", "niche", "followers", "matched_query"]))
source("profile_regex_shares", lambda r: stats.regex_shares(r, {"business": ("name", "(?i)clinic|ltd"), "numeric_facebook": ("facebook", r"/\d{8,}$")}))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with their scores, best first."""
    s = store(spark, sf_dir)
    return serve.order(serve.active(s).join(s.scores.select("lead_key", "score", "factors_evaluated"), "lead_key"), "-quality", serve.SORTS, ("lead_key",)).select("lead_key", "display_name", "entity_kind", "category_slug", "company_domain", "score", "factors_evaluated")


QUERIES["flagship"] = lambda spark, d: flagship(spark, d).select("lead_key", "display_name", "entity_kind", "category_slug", "company_domain", "factors_evaluated")

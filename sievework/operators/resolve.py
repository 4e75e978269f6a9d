"""Entity resolution: identity keys, clusters, merging, companies, pairs that merely resemble each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.functions.similarity import token_set_ratio
from sievework.operators.components import SMALL, connected_components
from sievework.operators.skew import heavy_of, lookup, tasks
from sievework.scratch import materialize
from sievework.sources.batches import row_text

#: Kinds that make two rows one lead, and all kinds of identifiers.
IDENTITY = ["email", "phone", "facebook"]
KINDS = ["email", "phone", "whatsapp", "website", "facebook", "instagram", "youtube", "linkedin"]


def identity_keys(rows: DataFrame) -> DataFrame:
    """row_id, kind, key ("kind:value"); null values give none."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.col(f"{k}_value")).alias("key")) for k in IDENTITY if f"{k}_value" in rows.columns])
    return rows.select("row_id", F.explode(each).alias("i")).select("row_id", "i.kind", "i.key").where("key is not null")


def cluster_rows(rows: DataFrame) -> DataFrame:
    """row_id, lead_key: rows connected by shared keys; a lead's key is its smallest row_id.

    A key ties each of its rows to the smallest one, so a key that many rows share costs one edge a
    row, and the first row of each key is a partially aggregated minimum. Rows of a key that is hot are
    spread when they look that up.
    """
    return add_lead_keys(rows.select("row_id", *[f"{k}_value" for k in IDENTITY if f"{k}_value" in rows.columns])).select("row_id", "lead_key")


def add_lead_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``lead_key`` of ``cluster_rows``."""
    keys = identity_keys(rows).select("row_id", "key")
    first = keys.groupBy("key").agg(F.min("row_id").alias("v"), F.count("*").alias("n"))
    heavy = heavy_of(first, "key", "n", tasks(rows))
    edges = lookup(keys, first.where("n > 1").select(F.col("key").alias("of"), "v"), "key", "of", heavy=heavy).where("row_id <> v").select(F.col("row_id").alias("u"), "v")
    found = connected_components(edges, small=SMALL)
    return rows.join(found, F.col("row_id") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "row_id").alias("lead_key"))


def matched_by(rows: DataFrame) -> DataFrame:
    """lead_key, n_rows, matched_by (kinds of all keys of a lead of several rows), shared_by (kinds of keys that rows share)."""
    keys = identity_keys(rows).join(rows.select("row_id", "lead_key"), "row_id")
    shared = keys.groupBy("lead_key", "kind", "key").agg((F.countDistinct("row_id") > 1).alias("s"))
    kinds = shared.groupBy("lead_key").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("all_kinds"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("s"), F.col("kind")))), ",").alias("shared_by"))
    sizes = rows.groupBy("lead_key").agg(F.count("*").alias("n_rows"))
    one = F.col("n_rows") == 1
    return sizes.join(kinds, "lead_key", "left").select("lead_key", "n_rows", F.when(one, "").otherwise(F.coalesce("all_kinds", F.lit(""))).alias("matched_by"), F.when(one, "").otherwise(F.coalesce("shared_by", F.lit(""))).alias("shared_by"))


def merge_leads(rows: DataFrame) -> DataFrame:
    """One row for each lead of rows with lead_key; the first best row wins, in the order of row_id."""
    first = -F.col("row_id")
    best = F.struct((~F.col("name_placeholder")).cast("int"), "name_confidence", F.length("name_display"), first)
    place = F.when(F.col("location_slug").isNotNull(), F.struct("location_confidence", first))
    real = F.col("category_slug") != fixed.UNCLASSIFIED
    category = F.when(F.col("category_slug").isNotNull(), F.struct(real.cast("int"), F.when(real, F.col("category_confidence")).otherwise(0.0), first))
    name, where, what = (f"max_by(struct({cols}), _k{i})" for i, cols in enumerate(["display_name, normalized_name, name_kind", "location_slug, location_name, location_state, location_confidence", "category_slug, category_confidence"]))
    seen = rows.withColumn("_k0", best).withColumn("_k1", place).withColumn("_k2", category)
    out = seen.groupBy("lead_key").agg(
        F.count("*").alias("n_rows"), F.expr(name).alias("n"), F.expr(f"{where} filter (where _k1 is not null)").alias("l"), F.expr(f"{what} filter (where _k2 is not null)").alias("c"),
        F.bool_and("name_placeholder").alias("is_placeholder"), F.expr("min_by(company_domain, row_id) filter (where company_domain is not null)").alias("company_domain"),
        F.expr("max_by(followers_value, struct(batch_seq, -row_no)) filter (where followers_value is not null)").alias("latest_followers"),
        F.min("batch_seq").alias("first_batch"), F.max("batch_seq").alias("last_batch"), F.bool_or("source_inferred").alias("source_inferred"), F.min("relevance").alias("relevance"),
    )
    return out.select("lead_key", "n_rows", F.col("n.display_name"), F.col("n.normalized_name"), F.col("n.name_kind").alias("entity_kind"), "is_placeholder", "l.location_slug", "l.location_name", "l.location_state", "l.location_confidence", "c.category_slug", "c.category_confidence", "company_domain", "latest_followers", "first_batch", "last_batch", "source_inferred", "relevance")


def merge_identifiers(rows: DataFrame) -> DataFrame:
    """lead_key, kind, value, is_primary, confidence, domain, free, role, owned, numeric: each (kind, value) once, its first row's.

    The first value of a kind is its primary. Minima by struct do both without ordering a lead's rows in a window.
    """
    def one(k: str):
        has = lambda c, d: F.col(c) if c in rows.columns else F.lit(d)
        return F.struct(F.lit(k).alias("kind"), F.col(f"{k}_value").alias("value"), F.col(f"{k}_confidence").alias("confidence"), (F.col("email_domain") if k == "email" else has(f"{k}_domain", None)).cast("string").alias("domain"), (F.col("email_free") if k == "email" else F.lit(False)).alias("free"), (F.col("email_role") if k == "email" else F.lit(False)).alias("role"), has(f"{k}_owned", False).alias("owned"), has(f"{k}_numeric", False).alias("numeric"))

    each = F.array(*[one(k) for k in KINDS if f"{k}_value" in rows.columns])
    tall = rows.select("lead_key", "row_id", F.explode(each).alias("i")).select("lead_key", "row_id", "i.*").where("value is not null")
    once = tall.groupBy("lead_key", "kind", "value").agg(F.min_by(F.struct("confidence", "domain", "free", "role", "owned", "numeric"), "row_id").alias("a"), F.min("row_id").alias("row_id"))
    primary = once.groupBy("lead_key", "kind").agg(F.min(F.struct("row_id", "value")).alias("p")).select("lead_key", "kind", F.col("p.value").alias("pv"))
    return once.join(primary, ["lead_key", "kind"]).select("lead_key", "kind", "value", (F.col("value") == F.col("pv")).alias("is_primary"), "a.*")


def observations(rows: DataFrame) -> DataFrame:
    """lead_key, batch, batch_seq, value: one for each lead and batch, of the highest row_no that has a value."""
    own = rows.where("followers_value is not null")
    return own.groupBy("lead_key", "batch", "batch_seq").agg(F.max_by("followers_value", "row_no").alias("value"))


def source_queries(rows: DataFrame) -> DataFrame:
    return rows.where("matched_query is not null").groupBy("lead_key", F.col("matched_query").alias("query")).agg(F.bool_and("source_inferred").alias("inferred"))


def weak_labels(rows: DataFrame) -> DataFrame:
    """lead_key, dimension, label, label_source: the relevance that a lead's first labelled row was shipped with, as weak supervision."""
    own = rows.where("relevance is not null").groupBy("lead_key").agg(F.min_by("relevance", "row_id").alias("label"))
    return own.select("lead_key", F.lit("relevance").alias("dimension"), "label", F.lit("weak_relevance").alias("label_source"))


def provenance(rows: DataFrame, raw: list[str]) -> DataFrame:
    """lead_key, row_id, source_file, source_sheet, row_no, row_sha256, raw: where each row of a lead came from, with its unread values as key=value lines."""
    out = rows if "source_file" in rows.columns else rows.withColumn("source_file", F.lit(None).cast("string"))
    lines = row_text(out, raw)
    return out.select("lead_key", "row_id", "source_file", F.col("batch").alias("source_sheet"), "row_no", F.sha2(lines, 256).alias("row_sha256"), lines.alias("raw"))


def match_stored(identifiers: DataFrame, stored: DataFrame) -> DataFrame:
    """lead_key, stored_key, matches: new leads whose identity keys stored leads have, from both sides' identifiers.

    Of several stored leads that one has the first key in the order email, phone, facebook, primary
    before other, value; ``matches`` counts them all, so that a lead of more than one can be reviewed.
    """
    place = F.create_map(*[F.lit(x) for i, k in enumerate(IDENTITY) for x in (k, i)])
    own = identifiers.where(F.col("kind").isin(IDENTITY)).select("lead_key", "kind", "value", F.struct(place[F.col("kind")].alias("k"), (~F.col("is_primary")).alias("p"), F.col("value").alias("v")).alias("at"))
    there = stored.where(F.col("kind").isin(IDENTITY)).groupBy("kind", "value").agg(F.min("lead_key").alias("stored_key"))
    hit = own.join(there, ["kind", "value"])
    return hit.groupBy("lead_key", "stored_key").agg(F.min("at").alias("at")).groupBy("lead_key").agg(F.min_by("stored_key", "at").alias("stored_key"), F.count("*").alias("matches"))


def companies(leads: DataFrame, identifiers: DataFrame) -> DataFrame:
    """domain, name, website, branches, multi_branch. Names: a lone lead's, else the common first words, else the domain's."""
    words = F.split(F.regexp_replace(F.trim("display_name"), r"\s+", " "), " ")
    own = leads.where("company_domain is not null").select("company_domain", "lead_key", "display_name", words.alias("w"))
    # the common prefix of two word lists is associative; positions at which all agree are counted on partial aggregates
    at = own.select("company_domain", "lead_key", F.posexplode("w").alias("pos", "word"))
    sizes = own.groupBy("company_domain").agg(F.count("*").alias("branches"), F.min(F.size("w")).alias("shortest"), F.min_by("display_name", "lead_key").alias("first_name"), F.min_by("w", "lead_key").alias("first_words"))
    same = at.groupBy("company_domain", "pos").agg((F.min(F.lower("word")) == F.max(F.lower("word"))).alias("same"))
    stop = same.where("not same").groupBy("company_domain").agg(F.min("pos").alias("stop"))
    out = sizes.join(stop, "company_domain", "left").withColumn("n", F.least("shortest", F.coalesce("stop", F.col("shortest"))))
    prefix = F.array_join(F.slice("first_words", F.lit(1), F.greatest(F.col("n"), F.lit(0))), " ")
    label = F.initcap(F.trim(F.replace(F.split_part("company_domain", F.lit("."), F.lit(1)), F.lit("-"), F.lit(" "))))
    name = F.when(F.col("branches") == 1, F.col("first_name")).when(F.col("n") > 0, prefix).otherwise(label)
    site = identifiers.where("kind = 'website' and owned").groupBy(F.col("domain").alias("company_domain")).agg(F.min_by("value", F.struct("lead_key", "value")).alias("website"))
    return out.join(site, "company_domain", "left").select(F.col("company_domain").alias("domain"), name.alias("name"), "website", "branches", (F.col("branches") > 1).alias("multi_branch"))


def _pairs(groups: DataFrame, key: str, most: int) -> DataFrame:
    """All pairs within groups of 2 to ``most`` leads; larger groups say nothing and give none, which bounds every group."""
    sizes = groups.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    own = groups.join(sizes, key)
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.lead_key") < F.col("b.lead_key")))


def shared_host_pairs(rows: DataFrame) -> DataFrame:
    """lead_a, lead_b, confidence, host, n_sharing: different leads of one owned website; a pair of several hosts keeps its first."""
    hosts = rows.where("website_owned").groupBy("lead_key", F.col("website_host").alias("host")).agg(F.min("row_id").alias("row_id"))
    pairs = _pairs(hosts, "host", fixed.HOST_GROUP).select(F.col("a.lead_key").alias("lead_a"), F.col("b.lead_key").alias("lead_b"), F.struct(F.least("a.row_id", "b.row_id").alias("r"), F.col("a.host").alias("host"), F.col("a.n").alias("n")).alias("s"))
    return pairs.groupBy("lead_a", "lead_b").agg(F.min("s").alias("s")).select("lead_a", "lead_b", F.lit(0.4).cast("double").alias("confidence"), F.col("s.host").alias("host"), F.col("s.n").alias("n_sharing"))


def fuzzy_name_pairs(rows: DataFrame, least: float = fixed.NAME_RATIO) -> DataFrame:
    """lead_a, lead_b, confidence: leads whose representatives' names share a first word of 3 letters or more and resemble each other."""
    reps = rows.where("row_id = lead_key").select("lead_key", "normalized_name", F.split_part("normalized_name", F.lit(" "), F.lit(1)).alias("block")).where("length(block) >= 3")
    pairs = _pairs(reps, "block", fixed.BLOCK_GROUP).select(F.col("a.lead_key").alias("lead_a"), F.col("b.lead_key").alias("lead_b"), token_set_ratio(F.col("a.normalized_name"), F.col("b.normalized_name")).alias("score"))
    return pairs.where(F.col("score") >= least).select("lead_a", "lead_b", F.bround(F.col("score") / 100, 3).alias("confidence"))


def candidates(rows: DataFrame) -> DataFrame:
    """lead_a, lead_b, method, confidence of both kinds of pairs."""
    host = shared_host_pairs(rows).select("lead_a", "lead_b", F.lit("shared_website").alias("method"), "confidence")
    return host.union(fuzzy_name_pairs(rows).select("lead_a", "lead_b", F.lit("fuzzy_name").alias("method"), "confidence"))


def resolve(rows: DataFrame) -> DataFrame:
    """Normalised rows with their lead_key, written once."""
    return materialize(add_lead_keys(rows), "rows")



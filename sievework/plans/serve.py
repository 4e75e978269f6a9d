"""Serving queries: lead filters, sorts, pages, summaries, companies, review queue."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.operators import trigrams
from sievework.operators.paging import Key, deep_page
from sievework.plans.store import Store


class InvalidRequestError(ValueError):
    """An unknown sort key or an impossible page."""


@dataclass(frozen=True)
class Filters:
    """All conditions hold together; an empty one says nothing."""

    include_merged: bool = False
    q: str | None = None
    category: tuple[str, ...] = ()
    location: tuple[str, ...] = ()
    state: tuple[str, ...] = ()
    entity_kind: tuple[str, ...] = ()
    placeholder_name: bool | None = None
    company: str | None = None
    owned_website: bool | None = None
    multi_branch: bool | None = None
    has: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    min_followers: int | None = None
    max_followers: int | None = None
    min_quality: float | None = None
    max_quality: float | None = None
    mailbox_status: str | None = None
    website_status: str | None = None
    mail_provider: str | None = None
    issue_code: str | None = None
    rubric_version: str | None = None
    include_unmeasured: bool = False


def like(c, text: str):
    """Case-insensitive containment; % and _ in the text stand for themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def search_texts(s: Store) -> DataFrame:
    """key, text: everything of a lead that a search looks into."""
    names = [s.leads.select(F.col("lead_key").alias("key"), F.col(c).alias("text")) for c in ("display_name", "normalized_name")]
    return names[0].union(names[1]).union(s.identifiers.select("lead_key", "value"))


def merged_leads(s: Store) -> DataFrame:
    """lead_key, merged_into of the leads that applied confirmations took into the survivor that was chosen, at the end of its chain."""
    return s.merges


def active(s: Store) -> DataFrame:
    return s.leads.join(merged_leads(s), "lead_key", "left_anti")


def current_scores(s: Store, version: str | None = None) -> DataFrame:
    """Scores of one rubric, the current one by default; a store keeps those of every rubric it was scored by."""
    return s.scores.where(F.col("rubric_version") == (version or fixed.RUBRIC_VERSION))


def filter_leads(s: Store, f: Filters, index: str | None = None) -> DataFrame:
    """Leads that meet all conditions. With the path of a trigram ``index`` of ``search_texts`` a search reads that first."""
    out = s.leads if f.include_merged else active(s)
    ids = s.identifiers
    semi = lambda df: out.join(df.select("lead_key"), "lead_key", "left_semi")
    if f.q and index:
        out = semi(trigrams.search(search_texts(s), index, f.q).withColumnRenamed("key", "lead_key"))
    elif f.q:
        hit = ids.where(like(F.col("value"), f.q)).select("lead_key").union(s.leads.where(like(F.col("display_name"), f.q) | like(F.col("normalized_name"), f.q)).select("lead_key"))
        out = semi(hit)
    for column, values in (("category_slug", f.category), ("location_slug", f.location), ("location_state", f.state), ("entity_kind", f.entity_kind)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if f.placeholder_name is not None:
        out = out.where(F.col("is_placeholder") == f.placeholder_name)
    if f.company:
        out = out.where(F.col("company_domain") == f.company)
    if f.owned_website is not None:
        out = out.where(F.col("company_domain").isNotNull() if f.owned_website else F.col("company_domain").isNull())
    if f.multi_branch is not None:
        n = active(s).where("company_domain is not null").groupBy("company_domain").agg(F.count("*").alias("_n"))
        out = out.join(n.where("_n > 1" if f.multi_branch else "_n = 1").select("company_domain"), "company_domain", "left_semi")
    for kind in f.has:
        out = semi(ids.where(F.col("kind") == kind))
    for kind in f.missing:
        out = out.join(ids.where(F.col("kind") == kind).select("lead_key"), "lead_key", "left_anti")
    if f.min_followers is not None:
        out = out.where(F.col("latest_followers") >= f.min_followers)
    if f.max_followers is not None:
        out = out.where(F.col("latest_followers") <= f.max_followers)
    if f.min_quality is not None or f.max_quality is not None:
        good = current_scores(s, f.rubric_version)
        good = good if f.min_quality is None else good.where(F.col("score") >= f.min_quality)
        out = semi(good if f.max_quality is None else good.where(F.col("score") <= f.max_quality))
    mail = ids.where("kind = 'email'")
    if f.mailbox_status:
        hit = mail.join(s.domain_cache.where(F.col("status") == f.mailbox_status).select("domain"), "domain", "left_semi").select("lead_key")
        if f.include_unmeasured and f.mailbox_status == "unknown":
            hit = hit.union(mail.join(s.domain_cache.select("domain"), "domain", "left_anti").select("lead_key"))
        out = semi(hit)
    if f.mail_provider:
        out = semi(mail.join(s.domain_cache.where(F.col("provider") == f.mail_provider).select("domain"), "domain", "left_semi"))
    if f.website_status:
        out = semi(ids.where("kind = 'website'").join(s.url_cache.where(F.col("status") == f.website_status).select(F.col("url").alias("value")), "value", "left_semi"))
    if f.issue_code:
        out = semi(s.issues.where(F.col("code") == f.issue_code))
    return out


SORTS = {"quality": "score", "followers": "latest_followers", "name": "normalized_name", "created": "first_batch", "updated": "last_batch"}
COMPANY_SORTS = {"branches": "branch_count", "domain": "domain", "quality": "mean_score"}
QUEUE_SORTS = {"confidence": "confidence", "method": "method"}


def order(df: DataFrame, sort: str, keys: dict[str, str], tie: tuple[str, ...]) -> DataFrame:
    name, down = sort.removeprefix("-"), sort.startswith("-")
    if name not in keys:
        raise InvalidRequestError(f"cannot sort by {name!r}; one of {sorted(keys)}")
    c = F.col(keys[name])
    return df.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last(), *tie)


def page(df: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    if number < 1 or size < 1:
        raise InvalidRequestError("pages and sizes start at 1")
    size = min(size, 200)
    return df.offset((number - 1) * size).limit(size)


#: Pages that begin behind so many rows are found by their rank.
DEEP = 10_000


def page_count(total: int, size: int) -> int:
    return ceil(total / min(size, 200))


def page_envelope(items: DataFrame, number: int = 1, size: int = 25) -> dict:
    """What a page is served in: its rows, the exact count of all, and where it stands; one count over the filtered rows."""
    total = items.count()
    return {"items": page(items, number, size), "total": total, "page": number, "page_size": min(size, 200), "page_count": page_count(total, size)}


def leads_page(s: Store, f: Filters, sort: str = "-quality", number: int = 1, size: int = 25, deep: int = DEEP) -> DataFrame:
    """A page of leads; behind the first ``deep`` rows by ranges of the sort key, so that no offset grows with its number."""
    scored = filter_leads(s, f).join(current_scores(s).select("lead_key", "score"), "lead_key", "left")
    name = sort.removeprefix("-")
    if name in SORTS and number > 1 and (number - 1) * min(size, 200) >= deep:
        return deep_page(scored, [Key(SORTS[name], sort.startswith("-")), Key("lead_key")], number, min(size, 200), max(deep, 1))
    return page(order(scored, sort, SORTS, ("lead_key",)), number, size)


def followers_rollup(s: Store) -> DataFrame:
    return s.observations.groupBy("lead_key").agg(F.max_by("value", "batch_seq").alias("value"), F.count("*").alias("observations"), (F.countDistinct("value") > 1).alias("changed"))


def tristate(s: Store) -> DataFrame:
    """lead_key, mailbox_status, website_status: null with nothing to check, unknown if unmeasured; flags false where they do not apply."""
    mail = s.identifiers.where("kind = 'email'").select("lead_key").distinct().withColumn("has_mail", F.lit(True))
    out = s.leads.join(mail, "lead_key", "left").join(s.signals, "lead_key", "left")
    site = F.col("company_domain").isNotNull()
    return out.select("lead_key", F.when(F.col("has_mail"), F.coalesce("mailbox_status", F.lit("unknown"))).alias("mailbox_status"), F.when(site, F.coalesce("website_status", F.lit("unknown"))).alias("website_status"), F.coalesce(site & F.col("website_live"), F.lit(False)).alias("is_live"), F.coalesce(site & F.col("website_parked"), F.lit(False)).alias("is_parked"))


def lead_summary(s: Store, leads: DataFrame) -> DataFrame:
    """What a list shows of each lead; children are aggregated by lead before they are joined."""
    ids = s.identifiers.groupBy("lead_key").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("channels"), *[F.min(F.when((F.col("kind") == k) & F.col("is_primary"), F.col("value"))).alias(f"primary_{k}") for k in ("email", "phone", "website")])
    issues = s.issues.groupBy("lead_key").agg(F.count("*").alias("issue_count"))
    out = leads.select("lead_key", "display_name", "entity_kind", "category_slug", "location_slug", "company_domain")
    for child in (ids, followers_rollup(s).withColumnRenamed("value", "followers"), issues, current_scores(s).select("lead_key", "score"), tristate(s), merged_leads(s)):
        out = out.join(child, "lead_key", "left")
    return out.withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def lead_detail(s: Store, lead_key: int) -> DataFrame:
    """One row: the lead with its identifiers, observations, queries, issues, siblings and candidates as nested lists."""
    own = lambda df: df.where(F.col("lead_key") == lead_key)
    lead = lead_summary(s, own(s.leads))
    nest = lambda df, name, *c: own(df).groupBy("lead_key").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    siblings = s.leads.alias("x").join(own(s.leads).select(F.col("company_domain").alias("d"), F.col("lead_key").alias("k")), F.col("company_domain") == F.col("d")).where("x.lead_key <> k").groupBy(F.col("k").alias("lead_key")).agg(F.array_sort(F.collect_list(F.struct("normalized_name", F.col("x.lead_key").alias("key")))).alias("siblings"))
    pairs = s.candidates.where((F.col("lead_a") == lead_key) | (F.col("lead_b") == lead_key)).groupBy(F.lit(lead_key).cast("long").alias("lead_key")).agg(F.count("*").alias("candidate_count"))
    for child in (nest(s.identifiers, "identifiers", "kind", "value", "is_primary"), nest(s.observations, "metrics", "batch_seq", "value"), nest(s.queries, "queries", "query"), nest(s.issues, "issues", "field", "code"), siblings, pairs):
        lead = lead.join(child, "lead_key", "left")
    return lead


def companies_page(s: Store, q: str | None = None, min_branches: int = 1, sort: str = "-branches", number: int = 1, size: int = 25) -> DataFrame:
    own = active(s).where("company_domain is not null").join(current_scores(s).select("lead_key", "score"), "lead_key", "left")
    agg = own.groupBy(F.col("company_domain").alias("domain")).agg(F.count("*").alias("branch_count"), F.array_join(F.array_sort(F.collect_set("location_name")), ",").alias("locations"), F.bround(F.avg("score"), 2).alias("mean_score"))
    out = s.companies.select("domain", "name").join(agg, "domain", "left").withColumn("branch_count", F.coalesce("branch_count", F.lit(0)))
    if q:
        out = out.where(like(F.col("domain"), q) | like(F.col("name"), q))
    if min_branches > 1:
        out = out.where(F.col("branch_count") >= min_branches)
    return page(order(out, sort, COMPANY_SORTS, ("domain",)), number, size)


def company_detail(s: Store, domain: str) -> DataFrame:
    own = s.leads.where(F.col("company_domain") == domain).join(current_scores(s).select("lead_key", "score"), "lead_key", "left")
    return own.groupBy("company_domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("display_name", "lead_key"))), lambda x: x.lead_key).alias("branches"), F.avg("score").alias("mean_score"))


def dim_counts(s: Store, column: str, dim: DataFrame, key: str) -> DataFrame:
    """``key``, active, total for every row of a dimension, with the leads that have none counted 0."""
    gone = merged_leads(s).select("lead_key", F.lit(True).alias("gone"))
    n = s.leads.join(gone, "lead_key", "left").where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count_if(F.col("gone").isNull()).alias("active"), F.count("*").alias("total"))
    return dim.select(key).distinct().join(n, key, "left").select(key, F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("total", F.lit(0)).alias("total"))


@dataclass(frozen=True)
class QueueFilters:
    status: str | None = "pending"
    methods: tuple[str, ...] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None
    lead: int | None = None


def review_queue(s: Store, f: QueueFilters = QueueFilters(), sort: str = "-confidence", number: int = 1, size: int = 25) -> DataFrame:
    out = s.candidates
    if f.status:
        out = out.where(F.col("status") == f.status)
    if f.methods:
        out = out.where(F.col("method").isin(*f.methods))
    if f.min_confidence is not None:
        out = out.where(F.col("confidence") >= f.min_confidence)
    if f.max_confidence is not None:
        out = out.where(F.col("confidence") <= f.max_confidence)
    if f.lead is not None:
        out = out.where((F.col("lead_a") == f.lead) | (F.col("lead_b") == f.lead))
    return page(order(out, sort, QUEUE_SORTS, ("lead_a", "lead_b", "method")), number, size)


COMPARED = ["display_name", "entity_kind", "category_slug", "location_slug", "company_domain", "email", "phone", "website", "score"]


def pair_comparison(s: Store) -> DataFrame:
    """lead_a, lead_b, method, field, value_a, value_b, agrees (null unless both are there) of every candidate."""
    primary = s.identifiers.where("is_primary").groupBy("lead_key").agg(*[F.min(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("email", "phone", "website")])
    facts = s.leads.join(primary, "lead_key", "left").join(current_scores(s).select("lead_key", F.format_string("%.1f", F.bround("score", 1)).alias("score")), "lead_key", "left")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in COMPARED])
    tall = facts.select("lead_key", each.alias("fields"))
    side = lambda p: tall.select(F.col("lead_key").alias(f"lead_{p}"), F.col("fields").alias(f"f{p}"))
    both = s.candidates.select("lead_a", "lead_b", "method").join(side("a"), "lead_a").join(side("b"), "lead_b")
    one = both.select("lead_a", "lead_b", "method", F.explode(F.arrays_zip("fa", "fb")).alias("z"))
    a, b = F.col("z.fa.value"), F.col("z.fb.value")
    return one.select("lead_a", "lead_b", "method", F.col("z.fa.field").alias("field"), a.alias("value_a"), b.alias("value_b"), F.when(a.isNotNull() & b.isNotNull(), F.lower(a) == F.lower(b)).alias("agrees"))

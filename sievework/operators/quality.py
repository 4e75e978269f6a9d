"""Data-quality scores: factors in [0, 1] or unmeasured, a weighted mean over the measured, capped penalties."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed


@dataclass(frozen=True)
class Rubric:
    """What a score depends on; its version is stamped on every score."""

    version: str = fixed.RUBRIC_VERSION
    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.WEIGHTS))
    penalties: dict[str, float] = field(default_factory=lambda: dict(fixed.PENALTIES))
    most_penalty: float = fixed.MOST_PENALTY
    followers_reference: float = fixed.FOLLOWERS_REFERENCE
    channel_kinds: tuple[str, ...] = tuple(fixed.CHANNEL_KINDS)
    managed_providers: tuple[str, ...] = tuple(fixed.MANAGED_PROVIDERS)

    @classmethod
    def of(cls, loaded: dict[str, Any]) -> Rubric:
        """From what ``policy.rubric`` read."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in loaded.items()})


RUBRIC = Rubric()


def lead_facts(leads: DataFrame, identifiers: DataFrame, signals: DataFrame, issues: DataFrame) -> DataFrame:
    """Everything a score needs, one row for each lead; children are aggregated before they are joined."""
    kinds = identifiers.groupBy("lead_key").agg(F.collect_set("kind").alias("kinds"))
    mail = identifiers.where("kind = 'email' and is_primary").select("lead_key", F.col("value").alias("email"), "free", "role")
    face = identifiers.where("kind = 'facebook' and is_primary").select("lead_key", "numeric")
    codes = issues.groupBy("lead_key").agg(F.collect_set("code").alias("codes"))
    out = leads
    for child in (kinds, mail, face, codes, signals):
        out = out.join(child, "lead_key", "left")
    return out


def add_factors(facts: DataFrame, rubric: Rubric = RUBRIC) -> DataFrame:
    """One column f_<factor> for each factor; null where it has not been measured."""
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    free, role = F.coalesce("free", F.lit(False)), F.coalesce("role", F.lit(False))
    contact = F.when(~has("email") & ~has("phone"), 0.0).when(~has("email"), 0.5).when(~free & ~role, 1.0).when(~free, 0.8).when(~role, 0.6).otherwise(0.45)
    measured = lambda c: F.col(c).isin("verified", "unreachable")
    mailbox = F.when(has("email") & measured("mailbox_status"), F.when(F.col("mailbox_status") != "verified", 0.0).when(F.col("mail_provider").isin(list(rubric.managed_providers)), 1.0).otherwise(0.85))
    website = F.when(F.col("company_domain").isNotNull() & measured("website_status"), F.when(F.col("website_parked"), 0.0).when(F.col("website_live"), 1.0).otherwise(0.0))
    followers = F.col("latest_followers").cast("double")
    audience = F.when(followers > 0, F.least(F.lit(1.0), F.log1p(followers) / F.log1p(F.lit(float(rubric.followers_reference))))).otherwise(0.0)
    breadth = sum((has(k).cast("int") for k in rubric.channel_kinds[1:]), has(rubric.channel_kinds[0]).cast("int")) / len(rubric.channel_kinds)
    factors = {
        "identity_present": F.when(F.col("is_placeholder"), 0.0).otherwise(1.0), "contact_reachable": contact, "mailbox_verified": mailbox, "owned_website": F.when(F.col("company_domain").isNotNull(), 1.0).otherwise(0.0), "website_live": website,
        "channel_breadth": breadth, "audience_evidence": audience, "location_resolved": F.coalesce("location_confidence", F.lit(0.0)), "category_known": F.when(F.coalesce("category_slug", F.lit(fixed.UNCLASSIFIED)) != fixed.UNCLASSIFIED, 1.0).otherwise(0.0),
        "identity_verifiable": F.when(F.coalesce("numeric", F.lit(False)), 0.0).otherwise(1.0), "provenance_observed": F.when(F.coalesce("source_inferred", F.lit(False)), 0.0).otherwise(1.0),
    }
    return facts.select("*", *[c.cast("double").alias(f"f_{n}") for n, c in factors.items()])


def penalties(facts: DataFrame):
    """The names of the penalties a lead with factors incurs, each once."""
    by_code = F.create_map(*[F.lit(x) for kv in fixed.PENALTY_OF_CODE.items() for x in kv])
    from_codes = F.transform(F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c.isin(list(fixed.PENALTY_OF_CODE))), lambda c: F.element_at(by_code, c))
    dead = F.array(F.when(F.col("f_mailbox_verified") == 0.0, F.lit("mailbox_domain_dead")), F.when(F.col("f_website_live") == 0.0, F.lit("website_dead")))
    return F.array_sort(F.array_distinct(F.concat(from_codes, F.filter(dead, lambda x: x.isNotNull()))))


def add_scores(factored: DataFrame, rubric: Rubric = RUBRIC) -> DataFrame:
    """base, penalties, penalty_total, score, factors_evaluated, weight_available, rubric_version."""
    weights = rubric.weights
    amounts = F.create_map(*[F.lit(x) for k, v in (rubric.penalties or {"": 0.0}).items() for x in (k, float(v))])
    earned = sum((F.coalesce(F.col(f"f_{n}"), F.lit(0.0)) * F.lit(float(w)) for n, w in weights.items()), F.lit(0.0))
    available = sum((F.when(F.col(f"f_{n}").isNotNull(), F.lit(float(w))).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    count = sum((F.col(f"f_{n}").isNotNull().cast("int") for n in weights), F.lit(0))
    out = factored.withColumn("penalties", penalties(factored)).withColumn("weight_available", available).withColumn("factors_evaluated", count)
    out = out.withColumn("base", F.when(F.col("weight_available") > 0, earned / F.col("weight_available") * 100).otherwise(0.0))
    out = out.withColumn("penalty_total", F.aggregate("penalties", F.lit(0.0), lambda s, p: s + F.coalesce(F.try_element_at(amounts, p), F.lit(0.0))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("base") - F.least("penalty_total", F.lit(float(rubric.most_penalty)))))
    return out.withColumn("score", F.bround(score, 2)).withColumn("rubric_version", F.lit(rubric.version))


def explain(scored: DataFrame, weights: dict[str, float] = fixed.WEIGHTS) -> DataFrame:
    """lead_key, factor, value, weight, contribution, measured: a score's factors as rows."""
    each = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"f_{n}").alias("value"), F.lit(float(w)).alias("weight")) for n, w in weights.items()])
    one = scored.select("lead_key", F.explode(each).alias("f")).select("lead_key", "f.*")
    return one.select("lead_key", "factor", F.bround("value", 4).alias("value"), "weight", F.coalesce(F.bround(F.col("value") * F.col("weight"), 3), F.lit(0.0)).alias("contribution"), F.col("value").isNotNull().alias("measured"))


def explain_reasons(factored: DataFrame) -> DataFrame:
    """lead_key, factor, measured, reason: in words why each factor of leads with facts and factors is what it is."""
    f = lambda n: F.col(f"f_{n}")
    domain, followers = F.col("company_domain"), F.col("latest_followers")
    contact = F.when(f("contact_reachable") == 0, "no e-mail or phone")
    for value, text in ((0.5, "phone only"), (1.0, "own domain, a person's"), (0.8, "own domain, a role's"), (0.6, "free provider, a person's")):
        contact = contact.when(f("contact_reachable") == value, text)
    unmeasured = lambda n, there, text: F.when(f(n).isNull(), F.when(there.isNull(), text).otherwise("not measured"))
    reasons = {
        "identity_present": F.when(f("identity_present") == 1, "named").otherwise("placeholder name"),
        "contact_reachable": contact.otherwise("free provider, a role's"),
        "mailbox_verified": unmeasured("mailbox_verified", F.col("email"), "no e-mail").when(f("mailbox_verified") == 0, "takes no mail").when(f("mailbox_verified") == 1, F.concat(F.lit("takes mail, managed by "), "mail_provider")).otherwise("takes mail"),
        "owned_website": F.coalesce(F.concat(F.lit("owns "), domain), F.lit("no domain of its own")),
        "website_live": unmeasured("website_live", domain, "no website").when(f("website_live") == 1, "answers").when(F.col("website_parked"), "parked").otherwise("does not answer"),
        "channel_breadth": F.concat(F.round(f("channel_breadth") * len(fixed.CHANNEL_KINDS)).cast("int").cast("string"), F.lit(f" of {len(fixed.CHANNEL_KINDS)} channels")),
        "audience_evidence": F.when(followers.isNull(), "no count").when(followers <= 0, "no followers").otherwise(F.concat(followers.cast("string"), F.lit(" followers"))),
        "location_resolved": F.coalesce(F.concat(F.lit("in "), "location_name"), F.lit("not resolved")),
        "category_known": F.when(f("category_known") == 1, F.concat(F.lit("is "), "category_slug")).otherwise("no category"),
        "identity_verifiable": F.when(f("identity_verifiable") == 1, "named page").otherwise("numbered page"),
        "provenance_observed": F.when(f("provenance_observed") == 1, "source observed").otherwise("source inferred"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("factor"), f(n).isNotNull().alias("measured"), r.alias("reason")) for n, r in reasons.items()])
    return factored.select("lead_key", F.explode(each).alias("x")).select("lead_key", "x.*")


def explain_penalties(scored: DataFrame, rubric: Rubric = RUBRIC) -> DataFrame:
    """lead_key, penalty, amount, triggered_by: each penalty of leads with facts and scores, and the first code or the finding behind it."""
    amounts = F.create_map(*[F.lit(x) for k, v in (rubric.penalties or {"": 0.0}).items() for x in (k, float(v))])
    by_code = F.create_map(*[F.lit(x) for kv in fixed.PENALTY_OF_CODE.items() for x in kv])
    one = scored.select("lead_key", "codes", F.coalesce("website_parked", F.lit(False)).alias("parked"), F.explode("penalties").alias("penalty"))
    first = F.get(F.filter(F.array_sort(F.coalesce("codes", F.array().cast("array<string>"))), lambda c: F.try_element_at(by_code, c) == F.col("penalty")), F.lit(0))
    found = F.when(F.col("penalty") == "mailbox_domain_dead", "mx_absent").when(F.col("penalty") == "website_dead", F.when(F.col("parked"), "website_parked").otherwise("website_down")).otherwise(first)
    return one.select("lead_key", "penalty", F.try_element_at(amounts, F.col("penalty")).alias("amount"), found.alias("triggered_by"))

"""Reachability of mail domains and websites from recorded answers, with caches that expire by status."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed


def mail_provider(hosts: Column, domain: Column) -> Column:
    """Who runs the mailboxes, by the first suffix in order that any MX host has."""
    low = F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), r"\.$", ""))
    within = lambda h, s: (h == s) | h.endswith(F.concat(F.lit("."), s))
    own = F.forall(low, lambda h: within(h, domain))
    out = F.when(own, "self_hosted").otherwise("other")

    def any_within(suffix: str) -> Column:
        return F.exists(low, lambda h: within(h, F.lit(suffix)))

    for suffix, name in reversed(fixed.MX_SUFFIXES):
        out = F.when(any_within(suffix), name).otherwise(out)
    return F.when(F.size(hosts) == 0, "none").otherwise(out)


def expires(checked_at: Column, status: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for kv in fixed.TTL_HOURS.items() for x in kv])
    return checked_at + F.make_dt_interval(hours=F.element_at(hours, status))


def verify_domains(domains: DataFrame, records: DataFrame) -> DataFrame:
    """domain, status, has_mx, provider, mx_hosts for ``domains`` (domain), from ``records`` (domain, answer, mx).

    answer is "ok" or "nxdomain"; a domain without a record has had no answer. mx is an array of
    (preference, exchange); the hosts stand by preference, then name.
    """
    out = domains.join(records, "domain", "left")
    hosts = F.transform(F.array_sort(F.coalesce("mx", F.array().cast("array<struct<preference:int,exchange:string>>"))), lambda m: m.exchange)
    out = out.withColumn("mx_hosts", hosts)
    status = F.when(F.col("answer").isNull(), "unknown").when(F.col("answer") == "nxdomain", "unreachable").when(F.size("mx_hosts") == 0, "unreachable").otherwise("verified")
    return out.select("domain", status.alias("status"), (F.size("mx_hosts") > 0).alias("has_mx"), mail_provider(F.col("mx_hosts"), F.col("domain")).alias("provider"), "mx_hosts")


def html_title(html: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(F.substring(t, 1, 200), F.lit(""))


def looks_parked(html: Column) -> Column:
    """Whether the title or the first 4000 characters hold a phrase of registrars' pages."""
    text = F.lower(F.concat_ws(" ", html_title(html), F.substring(html, 1, 4000)))
    out = F.lit(False)
    for m in fixed.PARKED_MARKERS:
        out = out | F.contains(text, F.lit(m))
    return F.coalesce(out, F.lit(False))


def verify_urls(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """url, host, status, status_code, is_parked, is_live for ``urls`` (url), from ``responses`` (url, error, code, html).

    error: null, or "connect", "redirects", "private", "other". A url that is not http(s), or of
    another port, is not checked; one without a response is unknown.
    """
    out = urls.join(responses, "url", "left")
    port = F.regexp_extract("url", r"^[a-z]+://[^/?#]*:(\d+)", 1)
    skipped = ~F.col("url").rlike("(?i)^https?://") | ((port != "") & ~port.isin([str(p) for p in fixed.WEB_PORTS])) | (F.col("error") == "private")
    unknown = (F.col("code").isNull() & F.col("error").isNull()) | (F.col("error") == "other") | (F.col("code") >= 500)
    status = F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(F.col("error").isin("connect", "redirects"), "unreachable").when(unknown, "unknown").otherwise("verified")
    out = out.withColumn("status", status).withColumn("is_parked", (F.col("status") == "verified") & looks_parked(F.col("html")))
    live = (F.col("status") == "verified") & F.coalesce(F.col("code").between(200, 399), F.lit(False)) & ~F.col("is_parked")
    return out.select("url", F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1).alias("host"), "status", F.col("code").alias("status_code"), "is_parked", live.alias("is_live"))


def pending(targets: DataFrame, cache: DataFrame, key: str, now: Column, force: bool = False, limit: int | None = None) -> DataFrame:
    """Targets (key, n) without a fresh cache row; of them the ``limit`` that most rows name, ties by key."""
    fresh = cache.where(F.col("expires_at") > now).select(key)
    out = targets if force else targets.join(fresh, key, "left_anti")
    return out if limit is None else out.orderBy(F.desc("n"), key).limit(limit)


def signals(identifiers: DataFrame, domain_cache: DataFrame, url_cache: DataFrame) -> DataFrame:
    """lead_key, mailbox_status, mail_provider, website_status, website_parked, website_live of the primary email and owned website."""
    mail = identifiers.where("kind = 'email' and is_primary").select("lead_key", "domain")
    mail = mail.join(domain_cache.select("domain", F.col("status").alias("mailbox_status"), F.col("provider").alias("mail_provider")), "domain", "left").drop("domain")
    site = identifiers.where("kind = 'website' and is_primary and owned").select("lead_key", F.col("value").alias("url"))
    site = site.join(url_cache.select("url", F.col("status").alias("website_status"), F.col("is_parked").alias("website_parked"), F.col("is_live").alias("website_live")), "url", "left").drop("url")
    return mail.join(site, "lead_key", "full_outer")


def is_public_ip(ip: Column) -> Column:
    """Whether an address can be reached from the internet; text that is no address, or null, cannot.

    IPv4 is a number tested against the closed networks. Of IPv6 the global range 2000::/3 is open,
    less 2001::/23, documentation (2001:db8::/32, 3fff::/20) and 2002::/16.
    """
    ip = F.col(ip) if isinstance(ip, str) else ip
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = [F.regexp_extract(ip, rf"^{octet}\.{octet}\.{octet}\.{octet}$", i).try_cast("long") for i in range(1, 5)]
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    closed = F.lit(False)
    for network in map(ipaddress.ip_network, fixed.CLOSED_NETWORKS):
        closed = closed | number.between(int(network[0]), int(network[-1]))
    low = F.lower(ip)
    groups = F.size(F.filter(F.split(low, ":"), lambda g: g != ""))
    whole = low.rlike(r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$") | (low.rlike(r"^(?!.*::.*::)[0-9a-f]{1,4}(::?[0-9a-f]{1,4})*(::)?$") & F.contains(low, F.lit("::")) & (groups <= 7))
    group = lambda k: F.coalesce(F.conv(F.nullif(F.split_part(low, F.lit(":"), F.lit(k)), F.lit("")), 16, 10).cast("long"), F.lit(0))
    one, two = group(1), group(2)
    special = ((one == 0x2001) & ((two < 0x200) | (two == 0xDB8))) | (one == 0x2002) | ((one == 0x3FFF) & (two < 0x1000))
    return F.coalesce(F.when(number.isNotNull(), ~closed).when(whole, one.between(0x2000, 0x3FFF) & ~special), F.lit(False))

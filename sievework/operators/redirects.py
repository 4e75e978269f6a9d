"""Redirects over recorded answers: a bounded, iterated join, with the address of every hop tested before it is asked.

Each round joins the urls that are still on their way with the addresses of their hosts and with what
was recorded of them; those that end leave, so a round is as large as what still redirects. Many urls
redirect to the same few (a login page), which makes hot keys, so lookups are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.operators.skew import lookup
from sievework.operators.verify import html_title, is_public_ip, looks_parked
from sievework.scratch import materialize

#: Redirects that are followed at most, and the codes of answers that redirect if they name a place.
MOST_REDIRECTS, REDIRECT_CODES = 5, (301, 302, 303, 307, 308)
_CHAIN = ["url", "now", "chain"]
_ENDED = ["url", "chain", "now", "status", "code", "error", "html"]


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; empty if it has none."""
    authority = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*$", ""))


def resolved(base: Column, place: Column) -> Column:
    """Where a Location header of the answer of ``base`` leads: absolute, of the same scheme, host or folder; without a fragment."""
    place = F.regexp_replace(F.trim(place), r"#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![/:])/[^/]*$", "")
    bare = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(place.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), place).when(place.startswith("//"), F.concat(scheme, F.lit(":"), place)).when(place.startswith("/"), F.concat(origin(base), place))
        .when(place.startswith("?"), F.concat(bare, place)).when(place == "", bare).otherwise(F.concat(folder, F.lit("/"), place))
    )


def follow_redirects(urls: DataFrame, hops: DataFrame, addresses: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """url, status, status_code, final_url, redirect_count, redirect_chain, error, title, is_parked, is_live of ``urls`` (url).

    ``hops`` (url, code, location, error, html) has one answer of each url that was asked, ``addresses``
    (host, ip) those that each host resolves to. Of every hop, the first included: a scheme that is not
    http(s), a port that is not one of the web's, or any address that is not public ends it as skipped;
    a host without address as unreachable; no recorded answer, a code from 500 or an error of another
    kind than "connect" as unknown. More than ``most`` redirects, and a url that comes again, are
    unreachable. Only urls that were answered in the end have a final_url and a chain. Null urls are
    left out, repeated ones are one. A fragment is never sent, so urls are asked, and named in chains,
    without theirs.
    """
    open_ = F.bool_and(is_public_ip("ip"))
    hosts = addresses.where("host is not null and ip is not null").groupBy(F.lower("host").alias("of_host")).agg(open_.alias("open"))
    asked = hops.where("url is not null").groupBy(F.regexp_replace("url", "#.*$", "").alias("of_url")).agg(F.max(F.struct("code", "location", "error", "html")).alias("hop"))
    now = urls.select("url").where("url is not null").distinct().select("url", F.regexp_replace("url", "#.*$", "").alias("now"), F.array().cast("array<string>").alias("chain"))
    ended = None
    for k in range(most + 1):
        port = F.regexp_extract("now", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)$|^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)[/?#]", 0)
        port = F.regexp_extract(port, r":(\d+)[/?#]?$", 1)
        own = lookup(now.withColumn("host", host_of(F.col("now"))), hosts, "host", "of_host", "left").drop("of_host")
        own = lookup(own, asked, "now", "of_url", "left").drop("of_url")
        own = own.select(*_CHAIN, "host", "open", F.col("hop.code").alias("code"), F.col("hop.location").alias("location"), F.col("hop.error").alias("error"), F.col("hop.html").alias("html"), port.alias("port"))
        barred = ~F.col("now").rlike("(?i)^https?://") | (F.col("host") == "") | ((F.col("port") != "") & ~F.col("port").isin([str(p) for p in fixed.WEB_PORTS]))
        moved = F.col("code").isin(*REDIRECT_CODES) & F.col("location").isNotNull() & F.col("error").isNull()
        following = resolved(F.col("now"), F.col("location"))
        again = F.array_contains(F.concat("chain", F.array("now")), following)
        # what ends a url here, in the order in which it would be noticed; null if it goes on
        reason = (
            F.when(barred, "not asked").when(F.col("open").isNull(), "no address").when(~F.col("open"), "private").when(F.col("code").isNull() & F.col("error").isNull(), "not recorded")
            .when(F.col("error") == "connect", "connect").when(F.col("error").isNotNull(), "other").when(moved & (again | F.lit(k == most)), "redirects").when(moved, None).otherwise("answered")
        )
        status = F.when(F.col("reason").isin("not asked", "private"), "skipped").when(F.col("reason").isin("no address", "connect", "redirects"), "unreachable").when(F.col("reason").isin("not recorded", "other") | (F.col("code") >= 500), "unknown").otherwise("verified")
        step = materialize(own.withColumn("next", following).withColumn("reason", reason), "redirects")
        done = step.where("reason is not null").withColumn("status", status).withColumn("error", F.when(F.col("reason") != "answered", F.col("reason"))).select(*_ENDED)
        ended = done if ended is None else ended.union(done)
        now = step.where("reason is null").select("url", F.col("next").alias("now"), F.concat("chain", F.array("now")).alias("chain"))
        if not now.limit(1).count():
            break
    ok = F.col("error").isNull()
    out = ended.withColumn("is_parked", ok & (F.col("status") == "verified") & looks_parked(F.col("html")))
    live = (F.col("status") == "verified") & F.coalesce(F.col("code").between(200, 399), F.lit(False)) & ~F.col("is_parked")
    return out.select(
        "url", "status", F.when(ok, F.col("code")).alias("status_code"), F.when(ok, F.col("now")).alias("final_url"), F.when(ok, F.size("chain")).otherwise(0).alias("redirect_count"),
        F.when(ok, F.col("chain")).otherwise(F.array().cast("array<string>")).alias("redirect_chain"), "error", F.when(ok, html_title(F.col("html"))).alias("title"), "is_parked", live.alias("is_live"),
    )

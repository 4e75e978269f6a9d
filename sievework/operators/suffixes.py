"""Registrable domains by public suffix rules: a table of rules, joined by every suffix of each host.

A rule is a suffix, ``*.suffix`` (any one label before it belongs to the public suffix too) or
``!suffix`` (an exception: the public suffix is what follows its first label). Of the rules that a host
ends with, an exception wins, else the longest; without any, the last label is the public suffix. The
registrable domain is the public suffix and one label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.skew import lookup, spare

RULES = "reversed string, kind string, labels int"


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def parse_rules(lines: DataFrame) -> DataFrame:
    """reversed (labels from the last to the first), kind (plain, wildcard, exception), labels (how many) of rules, one a row.

    The first column of ``lines`` holds them; comments after ``//``, white space and what follows it,
    empty lines and nulls are left out. A wildcard anywhere but in the first label is no rule; a rule
    that stands twice is one. Rules are in lower case, in Unicode or in Punycode as the hosts are.
    """
    rule = F.lower(F.regexp_extract(F.col(f"`{lines.columns[0]}`"), r"^\s*(?!//)(\S+)", 1))
    out = lines.select(F.regexp_replace(rule, r"^\.|\.$", "").alias("rule")).where("rule <> ''")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    out = out.select(kind.alias("kind"), F.split(F.regexp_replace("rule", r"^(!|\*\.)", ""), r"\.").alias("l")).where(~F.array_contains("l", "*") & ~F.array_contains("l", ""))
    return out.select(_reversed(F.col("l")).alias("reversed"), "kind", F.size("l").alias("labels")).distinct()


def read_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The rules of a public suffix list file in its published form; its private section only if asked for."""
    text = F.col("value") if private else F.regexp_replace("value", r"(?s)//\s*===BEGIN PRIVATE DOMAINS===.*?(//\s*===END PRIVATE DOMAINS===|\z)", "")
    return parse_rules(spark.read.text(path, wholetext=True).select(F.explode(F.split(text, r"\r?\n")).alias("line")))


def rules_of(spark: SparkSession, rules: list[str]) -> DataFrame:
    return parse_rules(spark.createDataFrame([(r,) for r in rules], "rule string"))


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, public_suffix, domain of each distinct host of ``hosts`` (its first column), as one row.

    domain is null for a host that is a public suffix itself. Hosts are taken in lower case without a
    dot at the end; null, empty and malformed ones (an empty label, an address of IPv4 or IPv6) have
    no suffix and no domain, and null itself is left out. The last labels of hosts are a few hot keys,
    so rules are looked up with those keys spread.
    """
    c = hosts.columns[0]
    own = hosts.select(F.col(f"`{c}`").alias("host")).where("host is not null").distinct()
    labels = F.split(F.regexp_replace(F.lower("host"), r"\.$", ""), r"\.")
    address = F.col("host").rlike(r"^\d+(\.\d+){3}$|[:\[\]]")
    own = own.withColumn("l", labels).withColumn("ok", ~address & ~F.array_contains("l", ""))
    each = own.where("ok").select("host", F.size("l").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: _reversed(F.slice("l", -k, k)))).alias("i", "suffix"))
    hit = lookup(each.where("n > 0").select("host", "n", "suffix"), rules.select("reversed", "kind", "labels"), "suffix", "reversed")
    # a wildcard reaches one label further, which the host must have
    depth = F.when(F.col("kind") == "plain", F.col("labels")).when((F.col("kind") == "wildcard") & (F.col("n") > F.col("labels")), F.col("labels") + 1)
    best = hit.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("kind") == "exception", F.col("labels") - 1)), F.max(depth)).alias("depth"))
    out = own.join(best.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").withColumn("depth", F.greatest(F.coalesce("depth", F.lit(1)), F.lit(1)))
    last = lambda k: F.array_join(F.slice("l", -k, k), ".")
    return out.select("host", F.when(F.col("ok"), last(F.col("depth"))).alias("public_suffix"), F.when(F.col("ok") & (F.size("l") > F.col("depth")), last(F.col("depth") + 1)).alias("domain"))


def add_domains(df: DataFrame, host: str, rules: DataFrame, domain: str = "domain", suffix: str = "public_suffix") -> DataFrame:
    """``df`` with the public suffix and the registrable domain of its column ``host``; every row stays.

    Each distinct host is worked out once. A host that many rows share is a hot key of the join back,
    and is spread.
    """
    h, s, d = spare("h", df), spare("s", df), spare("d", df)
    found = host_suffixes(df.select(host), rules).select(F.col("host").alias(h), F.col("public_suffix").alias(s), F.col("domain").alias(d))
    kept = [c for c in df.columns if c not in (domain, suffix)]
    out = lookup(df, found, host, h, "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(s).alias(suffix), F.col(d).alias(domain))

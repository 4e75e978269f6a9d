"""Policy files: rubric, gazetteer and taxonomy of the user's own, as YAML, checked when read."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sievework.functions import fixed


class PolicyError(ValueError):
    """A policy file contradicts itself or lacks what it must have."""


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise PolicyError("reading YAML needs PyYAML; pass a dict instead") from e
    return yaml.safe_load(Path(path).read_text())


def _fold(s: str) -> str:
    import re
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w\s-]", " ", bare).split())


def rubric(doc: dict[str, Any]) -> dict[str, Any]:
    """version, weights, penalties and limits; unknown channel kinds and empty factors are errors."""
    weights = {k: float(v["weight"]) for k, v in (doc.get("factors") or {}).items()}
    if not weights:
        raise PolicyError("a rubric needs factors")
    kinds = (doc.get("parameters") or {}).get("channel_kinds", fixed.CHANNEL_KINDS)
    if unknown := set(kinds) - {"email", "phone", "whatsapp", "website", "facebook", "instagram", "youtube", "linkedin"}:
        raise PolicyError(f"unknown channel kinds {sorted(unknown)}")
    return {"version": str(doc["version"]), "weights": weights, "penalties": {k: float(v["value"]) for k, v in (doc.get("penalties") or {}).items()}, "most_penalty": float(doc.get("max_total_penalty", fixed.MOST_PENALTY)), "channel_kinds": list(kinds), "followers_reference": float((doc.get("parameters") or {}).get("followers_reference", fixed.FOLLOWERS_REFERENCE)), "managed_providers": list((doc.get("parameters") or {}).get("managed_mail_providers") or fixed.MANAGED_PROVIDERS)}


def gazetteer(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """key, match, slug, name, state. A key of two places is an error, except that a city beats a state."""
    found: dict[str, tuple] = {}

    def add(text: str, match: str, slug: str | None, name: str | None, state: str | None) -> None:
        k = _fold(text)
        if k in found and found[k][2] != slug and "state" not in (match, found[k][1]):
            raise PolicyError(f"{text!r} stands for both {found[k][2]} and {slug}")
        if k not in found or found[k][1] == "state" and match != "state":
            found[k] = (k, match, slug, name, state)

    slugs = {}
    for c in doc.get("cities", []):
        slugs[c["slug"]] = c
        add(c["name"], "exact", c["slug"], c["name"], c.get("state"))
        for a in c.get("aliases", []):
            add(a, "alias", c["slug"], c["name"], c.get("state"))
    for x in doc.get("localities", []):
        if x["city"] not in slugs:
            raise PolicyError(f"locality {x['name']!r} has no city {x['city']!r}")
        c = slugs[x["city"]]
        add(x["name"], "locality", c["slug"], c["name"], c.get("state"))
    for s in doc.get("states", []):
        add(s["name"], "state", s["slug"], s["name"], s["name"])
    for kind, match in (("address_fragments", "fragment"), ("non_places", "non_place")):
        for t in doc.get(kind, []):
            found[_fold(t)] = (_fold(t), match, None, None, None)
    return spark.createDataFrame(list(found.values()), "key string, match string, slug string, name string, state string")


def taxonomy(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """alias, slug. Labels and slugs stand for themselves; an alias of two verticals is an error."""
    found: dict[str, str] = {}

    def add(text: str, slug: str) -> None:
        if found.setdefault(_fold(text), slug) != slug:
            raise PolicyError(f"{text!r} stands for both {found[_fold(text)]} and {slug}")

    slugs = {v["slug"] for v in doc["verticals"]}
    if fixed.UNCLASSIFIED not in slugs:
        raise PolicyError("a taxonomy needs the vertical 'unclassified'")
    for v in doc["verticals"]:
        add(v["label"], v["slug"])
        add(v["slug"], v["slug"])
    for slug, names in (doc.get("aliases") or {}).items():
        if slug not in slugs:
            raise PolicyError(f"aliases of an unknown vertical {slug!r}")
        for n in names:
            add(n, slug)
    return spark.createDataFrame(sorted(found.items()), "alias string, slug string")

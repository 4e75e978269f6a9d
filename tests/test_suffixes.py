import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.functions import fixed
from sievework.operators import suffixes

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "ac.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "kawasaki.jp", "github.io", "*.compute.example", "*.bd", "été.fr"]


def brute(host, rules):
    """(public suffix, domain) by the published algorithm, rule by rule."""
    h = host.lower()
    h = h[:-1] if h.endswith(".") else h
    labels = h.split(".")
    if "" in labels or ":" in h or "[" in h or "]" in h or (len(labels) == 4 and all(x.isascii() and x.isdigit() for x in labels)):
        return None, None
    hits = []
    for r in rules:
        parts = r.lstrip("!").split(".")
        tail = labels[-len(parts) :]
        if len(labels) >= len(parts) and all(p in ("*", x) for p, x in zip(parts, tail)):
            hits.append((r.startswith("!"), len(parts)))
    n = max((k - 1 for e, k in hits if e), default=None) or max((k for _, k in hits), default=1)
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :]) if len(labels) > n else None


def result(spark, hosts, rules):
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r.host: (r.public_suffix, r.domain) for r in suffixes.host_suffixes(df, suffixes.rules_of(spark, rules)).collect()}


HOSTS = [
    "a.com", "com", "x.a.com", "A.CO.UK", "co.uk", "uk", "ck", "foo.ck", "bar.foo.ck", "www.ck", "a.www.ck", "x.kawasaki.jp", "y.x.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "kawasaki.jp", "ac.jp", "b.ac.jp", "localhost", "unknown.tld", "a.b.unknown",
    "1.2.3.4", "[::1]", "a..com", ".com", "", "com.", "a.com.", "u.github.io", "github.io", "z.compute.example", "q.z.compute.example", "compute.example", "été.fr", "x.été.fr", "1.2.3.4.com",
]


def test_hosts(spark):
    got = result(spark, [*HOSTS, *HOSTS, None], RULES)
    assert got == {h: brute(h, RULES) for h in HOSTS}
    assert got["bar.foo.ck"] == ("foo.ck", "bar.foo.ck") and got["a.www.ck"] == ("ck", "www.ck") and got["co.uk"] == ("co.uk", None)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rules_against_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    label = lambda: r.choice("abc")
    rules = sorted({r.choice(["", "", "*.", "!"]) + ".".join(label() for _ in range(r.randint(1, 3))) for _ in range(25)} - {"!a", "!b", "!c"})
    hosts = sorted({".".join(label() for _ in range(r.randint(1, 5))) for _ in range(300)})
    assert result(spark, hosts, rules) == {h: brute(h, rules) for h in hosts}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ck", "www", "jp", "kawasaki", "city", "co", "uk"]), min_size=1, max_size=5))
def test_brute_force_obeys_the_rules(labels):
    suffix, domain = brute(".".join(labels), RULES)
    assert (domain is None) == (suffix == ".".join(labels)) and (domain is None or domain.endswith("." + suffix))


def test_rows_all_stay_and_names_may_clash(spark):
    df = spark.createDataFrame([("a.co.uk", 1, "x", 5)] * 2 + [(None, 2, "y", 6), ("co.uk", 3, "z", 7)], "host string, domain int, key string, salt int")
    out = suffixes.add_domains(df, "host", suffixes.rules_of(spark, RULES))
    assert out.columns == ["host", "key", "salt", "public_suffix", "domain"]
    assert sorted(map(str, out.select("key", "public_suffix", "domain").collect())) == sorted(map(str, spark.createDataFrame([("x", "co.uk", "a.co.uk")] * 2 + [("y", None, None), ("z", "co.uk", None)], "key string, public_suffix string, domain string").collect()))
    assert suffixes.add_domains(df.limit(0), "host", suffixes.rules_of(spark, RULES)).count() == 0


def test_rule_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n\ncom\nco.uk  // trailing\n*.ck\n!www.ck\nbad.*.x\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n// ===END PRIVATE DOMAINS===\n")
    rules = lambda private: {(r.reversed, r.kind, r.labels) for r in suffixes.read_rules(spark, str(tmp_path / "list.dat"), private).collect()}
    own = {("com", "plain", 1), ("uk.co", "plain", 2), ("ck", "wildcard", 1), ("ck.www", "exception", 2)}
    assert rules(False) == own and rules(True) == own | {("io.github", "plain", 2)}


def test_fixed_rules_are_rules(spark):
    assert suffixes.rules_of(spark, fixed.SUFFIX_RULES).count() == len(set(fixed.SUFFIX_RULES))

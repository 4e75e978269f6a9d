import re

import pytest

from sievework.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        level = (total - sum(stopped.values())) / sum(w[s] for s in rest) if rest else 0
        above = [s for s in rest if w[s] * level > cap * sizes[s] + 1e-9]
        if not above:
            return stopped | {s: w[s] * level for s in rest}
        stopped |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, "d": 5, None: 70}, {"a": 5}, {"x": 0, "y": 10}, {"a": 1, "b": 1, "c": 10_000}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), f"s{i % 5}" if i % 11 else None, 0) for i in range(600)] + [(None, None, "s1", 0), (7, "a\u0085b c", "s1", 0), (7, "a\u0085b c", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in out)
    assert sum(r.size for r in out) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_base_weights_tilt(spark):
    df = spark.createDataFrame([(i, "w w w w", "s", float(i % 3)) for i in range(300)], "doc_id long, text string, source string, q double")
    out = mixing.mix_sources(df, share=0.5, base="q").collect()
    rate = {i % 3: next(r.rate for r in out if r.doc_id == i) for i in range(3)}
    assert rate[0] == 0 and rate[2] == pytest.approx(2 * rate[1]) and sum(r.rate * r.size for r in out) == pytest.approx(600)


def test_unequal_bases_meet_the_targets(spark):
    """Bands of rates take what their rates add up to, so copies follow the bases."""
    rows = [(i, " ".join(["w"] * (1 + i % 5)), f"s{i % 2}", [0.1, 0.5, 0.9][i % 3]) for i in range(900)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), share=0.7, base="q").collect()
    for s in ("s0", "s1"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * 5 / 2
        for k in range(3):
            cell = [r for r in own if r.doc_id % 3 == k]
            assert abs(sum(r.taken for r in cell) - sum(r.rate * r.size for r in cell)) <= 5 / 2
    with pytest.raises(RuntimeError, match="off their targets"):
        mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), share=0.7, base="q", iterations=1)

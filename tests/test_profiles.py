import difflib
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.similarity import lcs_length
from sievework.operators import close
from sievework.plans import stats
from sievework.sources import files


def test_gestalt_is_the_librarys():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("abcé ") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert close.gestalt(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()), (a, b)


@pytest.mark.parametrize("cutoff,most", [(0.85, 1), (0.6, 3), (0.3, 2), (1.0, 1)])
def test_close_matches_against_brute_force(spark, cutoff, most):
    r = random.Random(7)
    words = ["".join(r.choice("abcd.") for _ in range(r.randint(1, 9))) for _ in range(120)]
    values, targets = [*words[:80], None, "", words[0]], [*words[60:], None, ""]
    want = set()
    for v in {x for x in values if x}:
        ratios = sorted(((-difflib.SequenceMatcher(None, v, t, autojunk=False).ratio(), t) for t in {x for x in targets if x}))
        want |= {(v, t, i + 1) for i, (q, t) in enumerate([x for x in ratios if -x[0] >= cutoff][:most])}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    got = {(x.value, x.target, x.place) for x in close.close_matches(frame(values), frame(targets), cutoff, most).collect()}
    assert got == want
    assert cutoff < 0.5 or {v for v, *_ in want} == {v for v in {x for x in values if x} if difflib.get_close_matches(v, [t for t in targets if t], 1, cutoff)}


def test_bounds_are_longest_common_subsequences():
    """one text against many at once, over several words of bits, lengths and scripts."""
    r = random.Random(5)
    texts = ["".join(r.choice("abc\0é\U0001f600") for _ in range(r.choice([1, 7, 61, 62, 63, 64, 130, 200]))) for _ in range(60)]
    there = close.Texts(texts)
    for t in [*texts[:20], "zz"]:
        assert there.lcs(t, 1e-9).tolist() == [lcs_length(t, x) for x in texts]


def test_close_matches_in_several_cells(spark, monkeypatch):
    """values that nearly all resemble each other, in cells of several blocks and chunks, are compared by blocks for few pairs only."""
    values, targets = [f"Customer#{i:09d}" for i in range(0, 9000, 90)], [f"Supplier#{i:09d}" for i in range(0, 4000, 9)]
    calls, plain = [], close.gestalt
    with monkeypatch.context() as m:
        m.setattr(close, "gestalt", lambda x, y: calls.append(x) or plain(x, y))
        whole = close.closest(values, targets, 0.6, 3)
    assert len(calls) < len(values) * len(targets) / 8
    want = {(v, t, i + 1) for v in values for i, (q, t) in enumerate([x for x in sorted((-plain(v, t), t) for t in targets) if -x[0] >= 0.6][:3])}
    assert {(v, t) for v, t, _ in whole} == {w[:2] for w in want}
    monkeypatch.setattr(close, "BLOCK", 40)
    monkeypatch.setattr(close, "CHUNK", 150)
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "text string")
    assert {(x.value, x.target, x.place) for x in close.close_matches(frame(values), frame(targets), 0.6, 3).collect()} == want


def test_pairs_are_bounded_once_for_what_values_start_with(monkeypatch):
    """most targets are given up for all values of one start, so texts that are bounded grow slower than the product."""
    values, targets = [f"Customer#{i:09d}" for i in range(400_000, 401_000)], [f"Supplier#{i:09d}" for i in range(0, 60_000, 2)]
    bounded, plain = [], np.bitwise_count
    with monkeypatch.context() as m:
        m.setattr(np, "bitwise_count", lambda x, *a, **k: bounded.append(x.size) or plain(x, *a, **k))
        found = close.closest(values, targets, 0.6, 3)
    assert sum(bounded) < len(values) * len(targets) / 8
    there = close.Texts(targets)
    for v in values[::250]:
        bound = there.lcs(v, 0.6) / 18
        want = sorted((-close.gestalt(v, targets[j]), targets[j]) for j in np.flatnonzero(bound >= 0.6))
        assert [(v, t, -q) for q, t in want if -q >= 0.6][:3] == [x for x in found if x[0] == v]


@pytest.mark.parametrize("kept", [0, 500, 1 << 24])
def test_closest_of_texts_of_many_lengths(monkeypatch, kept):
    """over one and several words of bits, rare characters and common starts, whatever rows are kept."""
    monkeypatch.setattr(close, "SLICE", 1)
    monkeypatch.setattr(close, "KEPT", kept)
    r = random.Random(kept)
    text = lambda: r.choice(["", "ab", "ab" * 20, "ba" * 33])[: r.randint(0, 70)] + "".join(r.choice("abcé\0\U0001f600") for _ in range(r.choice([1, 5, 30, 62, 300])))
    values, targets = ({text() for _ in range(n)} for n in (40, 70))
    got = {(v, t, round(q, 12)) for v, t, q in close.closest(list(values), list(targets), 0.4, 3)}
    want = set()
    for v in values:
        near = sorted((-difflib.SequenceMatcher(None, v, t, autojunk=False).ratio(), t) for t in targets)
        want |= {(v, t, round(-q, 12)) for q, t in near[:3] if -q >= 0.4}
    assert got == want


def test_types_of_texts(spark):
    rows = [("1", "1", "true", "2024-02-29", None), ("-7", "2.5", "NO", "2023-02-29", ""), (" 30 ", "1e3", "yes", "2024-01-01", " "), (None, ".5", "False", "", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    out = {(r.column, r.type): (r.n, r.share, r.merged) for r in stats.type_histogram(df, list("abcde")).collect()}
    assert out == {
        ("a", "int"): (3, 75.0, "int"), ("a", "null"): (1, 25.0, "int"), ("b", "int"): (1, 25.0, "decimal"), ("b", "decimal"): (3, 75.0, "decimal"), ("c", "boolean"): (4, 100.0, "boolean"),
        ("d", "date"): (2, 50.0, "text"), ("d", "text"): (1, 25.0, "text"), ("d", "null"): (1, 25.0, "text"), ("e", "null"): (4, 100.0, "null"),
    }
    assert stats.type_histogram(df.limit(0), ["a"]).count() == 0


def test_records_by_content(spark, tmp_path):
    """The same file under another name changes nothing, a changed one adds its rows."""
    write = lambda name, lo, hi: spark.range(lo, hi).select("id", F.concat(F.lit("n"), "id").alias("name")).coalesce(1).write.parquet(str(tmp_path / name))
    write("one", 0, 5)
    one = next((tmp_path / "one").glob("part-*"))
    (tmp_path / "copy").mkdir()
    shutil.copyfile(one, tmp_path / "copy" / "other.parquet")
    write("two", 0, 6)
    sheet = lambda name: files.records(spark, {"Day_1": str(tmp_path / name)})
    store = str(tmp_path / "records")
    assert files.add_records(sheet("one"), store).count() == 5
    assert files.add_records(sheet("one"), store).count() == 5 == files.add_records(sheet("copy"), store).count()
    out = files.add_records(sheet("two"), store)
    assert out.count() == 11 and out.select("file_sha256").distinct().count() == 2
    assert files.add_records(files.records(spark, {"Day_2": str(tmp_path / "one")}), store).count() == 16
    import hashlib

    assert hashlib.sha256(one.read_bytes()).hexdigest() in {r.sha256 for r in files.file_hashes(spark, str(tmp_path / "one")).collect()}


def test_duplicate_groups_of_a_column_that_is_derived_at_length(spark):
    """Planned without repeating the derivation; nulls are no group, nor is a table of nulls or without rows."""
    from sievework.functions.normalize import add_phone

    rows = spark.createDataFrame([("+91 98765 43210",), ("09876543210",), ("+1 650 253 0000",), (None,), (None,), ("x",)], "phone string")
    assert stats.duplicate_groups(add_phone(rows), "phone_value").first().asDict() == {"groups": 1, "rows": 2}
    for none in (rows.where("phone is null"), rows.limit(0)):
        assert stats.duplicate_groups(none, "phone").first().asDict() == {"groups": 0, "rows": 0}


def test_clean_and_keys_of_odd_cells(spark):
    from sievework.functions import text

    cells = [None, "", "  \t", " NaN", "-Infinity ", "  Ünï  Co. ", "nancy"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    out = {r.i: r for r in df.select("i", text.clean(F.col("c")).alias("t"), text.key(F.col("c")).alias("k"), text.slug(F.col("c")).alias("s")).collect()}
    assert [out[i].t for i in range(7)] == [None, None, None, None, None, "Ünï  Co.", "nancy"]
    assert (out[6].k, out[6].s, out[0].k, out[0].s, out[1].s) == ("nancy", "nancy", None, None, "")
    assert out[5].s == "uni-co"

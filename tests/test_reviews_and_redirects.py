import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import redirects, review
from sievework.streaming import reviews

LOG = "seq long, lead_a long, lead_b long, method string, decision string, reviewer string, survivor long"


def test_pairs_are_the_same_either_way_round(spark):
    log = [(1, 2, 1, "m", "confirmed_duplicate", "r", 1), (2, 1, 2, "m", "pending", "r", None), (3, 3, 1, "m", "confirmed_duplicate", "r", 3)]
    out = {(r.lead_a, r.lead_b): (r.status, r.applied_loser, r.applied_target) for r in review.fold_decisions(spark.createDataFrame(log, LOG)).collect()}
    assert out == {(1, 2): ("pending", None, None), (1, 3): ("confirmed_duplicate", 1, 3)}


def test_a_group_is_bounded():
    import pandas as pd

    before, review.MOST_DECISIONS = review.MOST_DECISIONS, 2
    try:
        with pytest.raises(ValueError, match="more than 2"):
            review._fold(pd.DataFrame([(i, 1, 2, "m", "pending", "r", None) for i in range(3)], columns=reviews.DECISION))
    finally:
        review.MOST_DECISIONS = before


def test_many_groups_are_folded_in_a_call(spark, monkeypatch):
    """groups follow one another in a task, none makes a frame or a call of its own; they are dealt over all tasks however few bytes they have."""
    monkeypatch.setattr(review, "_fold", None)
    log = spark.range(3000).selectExpr("id as seq", "id * 10 as lead_a", "id * 10 + 1 as lead_b", "'m' as method", "'confirmed_duplicate' as decision", "'r' as reviewer", "id * 10 + id % 2 as survivor")
    rows = review.fold_decisions(log.union(log.where("seq % 3 = 0").selectExpr("seq + 5000", "lead_b", "lead_a", "method", "'pending'", "'s'", "cast(null as long)")))
    out = {r.lead_a // 10: r for r in rows.withColumn("task", F.spark_partition_id()).collect()}
    assert len(out) == 3000 and len({r.task for r in out.values()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all((r.status, r.reviewer, r.applied_loser) == (("pending", "s", None) if i % 3 == 0 else ("confirmed_duplicate", "r", i * 10 + 1 - i % 2)) for i, r in out.items())


def test_stream_and_batch_fold_agree(spark, tmp_path):
    """Random logs, chains and undone merges among them, in files of any order, some of them twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(8)
    log = []
    for seq in range(60):
        a, b = r.sample(range(8), 2) if seq % 3 else r.sample(range(100, 104), 2)
        decision = r.choice(["confirmed_duplicate"] * 3 + ["rejected_distinct", "pending"])
        log.append((seq, a, b, r.choice("mn"), decision, f"r{seq % 4}", r.choice([a, b]) if decision == "confirmed_duplicate" else None))
    mixed = r.sample(log, len(log)) + r.sample(log, 10)
    for i in range(0, len(mixed), 14):
        spark.createDataFrame(mixed[i : i + 14], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pairs = spark.createDataFrame([x[1:3] for x in log], "lead_a long, lead_b long")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    told = []
    q = reviews.fold_stream(stream, reviews.candidate_groups(pairs)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, i: told.extend((i, *row) for row in df.collect())).trigger(processingTime="1 second").start()
    want = {(x.lead_a, x.lead_b, x.method): tuple(x) for x in review.fold_decisions(spark.createDataFrame(log, LOG)).collect()}
    import time

    last: dict = {}
    for _ in range(120):
        time.sleep(1)
        last = {tuple(x[1:4]): tuple(x[1:]) for x in sorted(told, key=lambda x: x[0])}
        if last == want or not q.isActive:
            break
    error = q.exception()
    q.stop()
    assert error is None and last == want


def test_redirects(spark):
    hop = lambda url, to=None, code=301, error=None, html="<title>T</title>": (url, None if error else code, to, error, html)
    hops = [
        hop("http://a/1", "/2"), hop("http://a/2", "3?x#f"), hop("http://a/3?x", None, 200), hop("http://loop/1", "//loop/2"), hop("http://loop/2", "http://loop/1"), hop("http://p/", "http://private/x"), hop("http://private/x", None, 200), hop("http://n/", "https://nowhere/"),
        hop("http://port/", "http://a:22/"), hop("http://mail/", "mailto:x@a"), hop("http://a:8080/ok", None, 404), hop("http://dead/", error="connect"), hop("http://slow/", error="read"), hop("http://a/5", None, 503), hop("http://a/no-place", None, 302), hop("http://mixed/", None, 200),
        *[hop(f"http://c/{i}", f"http://c/{i + 1}") for i in range(6)], hop("http://c/6", None, 200), hop("http://sale/", None, 200, html="<title>Buy this domain</title>"), hop("http://u@A/1", "http://a/3?x", 308),
    ]
    hosts = [(h, "93.184.216.34") for h in ("a", "loop", "p", "n", "port", "mail", "dead", "slow", "c", "sale", "mixed")] + [("private", "192.168.0.1"), ("mixed", "127.0.0.1"), (None, "1.1.1.1")]
    urls = [*[h[0] for h in hops], "ftp://a/", "http://unheard/", "http://a/never", "", None, "http://a/1", "http://a/2#top"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = redirects.follow_redirects(df, spark.createDataFrame(hops, "url string, code int, location string, error string, html string"), spark.createDataFrame(hosts, "host string, ip string")).collect()
    got = {r.url: (r.status, r.status_code, r.final_url, r.redirect_count, r.error) for r in rows}
    assert len(rows) == len(got) == len(set(urls) - {None})
    want = {
        "http://a/2#top": ("verified", 200, "http://a/3?x", 1, None), "http://a/1": ("verified", 200, "http://a/3?x", 2, None), "http://u@A/1": ("verified", 200, "http://a/3?x", 1, None), "http://loop/1": ("unreachable", None, None, 0, "redirects"), "http://p/": ("skipped", None, None, 0, "private"), "http://mixed/": ("skipped", None, None, 0, "private"),
        "http://n/": ("unreachable", None, None, 0, "no address"), "http://port/": ("skipped", None, None, 0, "not asked"), "http://mail/": ("skipped", None, None, 0, "not asked"), "http://a:8080/ok": ("verified", 404, "http://a:8080/ok", 0, None), "http://dead/": ("unreachable", None, None, 0, "connect"),
        "http://slow/": ("unknown", None, None, 0, "other"), "http://a/5": ("unknown", 503, "http://a/5", 0, None), "http://a/no-place": ("verified", 302, "http://a/no-place", 0, None), "http://c/0": ("unreachable", None, None, 0, "redirects"), "http://c/1": ("verified", 200, "http://c/6", 5, None),
        "ftp://a/": ("skipped", None, None, 0, "not asked"), "http://unheard/": ("unreachable", None, None, 0, "no address"), "http://a/never": ("unknown", None, None, 0, "not recorded"), "": ("skipped", None, None, 0, "not asked"),
    }
    assert {k: got[k] for k in want} == want
    by = {r.url: r for r in rows}
    assert by["http://a/1"].redirect_chain == ["http://a/1", "http://a/2"] and by["http://a/1"].title == "T" and by["http://a/1"].is_live
    assert by["http://sale/"].is_parked and not by["http://sale/"].is_live and not by["http://a:8080/ok"].is_live


@pytest.mark.parametrize("base,place,want", [("http://a/x/y?q", "z", "http://a/x/z"), ("http://a", "z", "http://a/z"), ("http://a/x/", "?p", "http://a/x/?p"), ("https://a/b", "//c/d", "https://c/d"), ("http://a/b#c", "", "http://a/b"), ("http://a/b", " HTTP://C/ ", "HTTP://C/")])
def test_places(spark, base, place, want):
    assert spark.range(1).select(redirects.resolved(F.lit(base), F.lit(place))).first()[0] == want

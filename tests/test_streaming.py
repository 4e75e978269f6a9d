from sievework.streaming import observations as so


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_events_in_windows(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    got = run(spark, so.windowed_counts(stream, "ts", "event_type", "value"), "w", "complete")
    assert sum(r.n for r in got) == spark.read.parquet(path).count()


def test_observations_once_and_last_decision(spark, tmp_path):
    rows = [("a", 1, "confirmed_duplicate", "r1"), ("a", 3, "pending", "r2"), ("a", 2, "rejected_distinct", "r1"), ("b", 1, "rejected_distinct", "r3"), ("b", 1, "rejected_distinct", "r3")]
    df = spark.createDataFrame(rows, "pair string, seq long, decision string, reviewer string").selectExpr("*", "timestamp '2026-01-01 00:00:00' as at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert len(run(spark, so.distinct_observations(stream(), ["pair", "seq"], "at"), "d", "append")) == 4
    got = {r.pair: (r.seq, r.decision) for r in run(spark, so.latest_decisions(stream().drop("at")), "l", "update")}
    assert got == {"a": (3, "pending"), "b": (1, "rejected_distinct")}

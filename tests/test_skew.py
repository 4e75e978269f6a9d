import pytest
from pyspark.sql import functions as F

from sievework.operators import skew
from sievework.operators.components import connected_components


def rows_by_stage(spark, work):
    """Shuffle records that the tasks of each stage read while ``work`` ran."""
    store = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    stages = lambda: {(s.stageId(), s.attemptId()) for s in map(lambda x: x, iter_java(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))}
    bus.waitUntilEmpty(30_000)
    before = stages()
    work()
    bus.waitUntilEmpty(30_000)
    out = []
    for stage, attempt in stages() - before:
        read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in iter_java(store.taskList(stage, attempt, 1000)) if t.taskMetrics().isDefined()]
        if sum(read):
            out.append(read)
    return out


def iter_java(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.fixture
def many_tasks(spark):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lookup_is_a_join(spark):
    rows = [(1, "a", 0)] * 3 + [(1, "b", 0)] * 50 + [(2, "a", 0), (3, "a", 0), (None, "a", 0)]
    df, table = spark.createDataFrame(rows, "k int, key string, salt int"), spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (9, "q")], "of int, at string")
    for how in ("inner", "left"):
        want = df.join(table, df.k == table.of, how)
        got = skew.lookup(df, table, "k", "of", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    same = skew.lookup(df, table.withColumnRenamed("of", "k"), "k")
    assert same.columns == ["k", "key", "salt", "at"] and same.count() == 107
    assert skew.lookup(df.limit(0), table, "k", "of").count() == 0


def test_heavy_keys_are_few(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in skew.heavy_keys(df, "k", 8).collect()] == [(0, 8)]
    assert skew.heavy_keys(df.where("k <> 0"), "k", 8).count() == 0


def test_half_of_all_rows_under_one_key_are_spread(spark, many_tasks):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id").repartition(8)
    table = df.groupBy("k").agg(F.min("id").alias("m")).withColumnRenamed("k", "of")
    read = rows_by_stage(spark, lambda: skew.lookup(df, table, "k", "of").write.format("noop").mode("overwrite").save())
    most = max(read, key=sum)
    assert sum(most) >= 60_000 and max(most) < 3 * sum(most) / 16, most


def test_a_hub_of_half_of_all_edges_is_spread(spark, many_tasks):
    """Edges of one hub and of many pairs: no task of any stage reads much more than its share."""
    edges = spark.range(30_000).selectExpr("if(id % 2 = 0, 0, id) as v", "id + 1000000 as u").repartition(8)
    found = []
    read = rows_by_stage(spark, lambda: found.append(connected_components(edges).groupBy("component").count().where("count > 2").collect()))
    assert [(r.component, r["count"]) for r in found[0]] == [(0, 15_001)]
    for tasks in read:
        if sum(tasks) > 20_000:
            assert max(tasks) < 4 * sum(tasks) / len(tasks), tasks


def test_small_graphs_in_one_task_are_the_same(spark):
    import random

    r = random.Random(3)
    edges = spark.createDataFrame([(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(None, 4), (5, 5)], "u long, v long").repartition(5)
    both = [sorted(map(tuple, connected_components(edges, small=n).collect())) for n in (0, 10_000)]
    assert both[0] == both[1] and len({c for _, c in both[0]}) > 5

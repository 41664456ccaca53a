"""Skew-safe positions equal row_number() and split a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators.ranking import next_within, rank_within


def _skewed(spark, n=3000):
    # one group holds a third of all rows
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 10007).alias("k"), F.col("id"))


def test_rank_within_equals_window_on_hot_group(spark):
    df = _skewed(spark)
    got = rank_within(df, ["g"], [F.col("k").desc(), "id"], num_partitions=8, max_group_rows=0)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(F.col("k").desc(), "id")))
    assert sorted(got.select("g", "id", "position").collect()) == sorted(want.select("g", "id", "position").collect())


def test_hot_group_spans_several_tasks(spark):
    df = _skewed(spark)
    parts = (df.repartitionByRange(8, "g", "k", "id").withColumn("p", F.spark_partition_id())
             .filter("g = 'hot'").select("p").distinct().count())
    assert parts >= 2


def test_global_rank_and_next(spark):
    df = _skewed(spark, 500)
    got = rank_within(df, [], ["k", "id"], num_partitions=4, max_group_rows=0)
    want = df.withColumn("position", F.row_number().over(Window.orderBy("k", "id")))
    assert sorted(got.select("id", "position").collect()) == sorted(want.select("id", "position").collect())
    nx = next_within(df, ["g"], ["k", "id"], ["id"], max_group_rows=0)
    want = df.withColumn("next_id", F.lead("id").over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(nx.select("id", "next_id").collect()) == sorted(want.select("id", "next_id").collect())


def test_small_groups_use_plain_window(spark):
    df = _skewed(spark, 300)
    got = rank_within(df, ["g"], ["k", "id"])
    assert "Window" in got._jdf.queryExecution().optimizedPlan().toString()
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted(got.select("id", "position").collect()) == sorted(want.select("id", "position").collect())


def test_pipelines_equal_on_forced_skew_path(spark):
    """Registered session and trail plans give the same rows on the skew path."""
    from cairn.plans import catalog
    sf = "/root/testdata/sf0.001"
    names = ["s3_read_sessions", "c7_trail", "c5_rules"]
    plain = {n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in names}
    spark.conf.set("cairn.rank.maxGroupRows", "0")
    try:
        forced = {n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in names}
    finally:
        spark.conf.unset("cairn.rank.maxGroupRows")
    assert plain == forced


def test_null_group_is_its_own_group_on_both_paths(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5), (None, 2)], "g string, k int")
    key = lambda r: (r["g"] is None, r["g"] or "", r["k"])
    want = sorted(df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("k"))).collect(), key=key)
    for m in (None, 0):
        got = sorted(rank_within(df, ["g"], ["k"], num_partitions=3, max_group_rows=m).collect(), key=key)
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
    wl = sorted(df.withColumn("next_k", F.lead("k").over(Window.partitionBy("g").orderBy("k"))).collect(), key=key)
    got = sorted(next_within(df, ["g"], ["k"], ["k"], max_group_rows=0).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in wl]

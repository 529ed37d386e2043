"""Exact places and quotas without class windows, against sorting in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import corpus
from lumenloom.operators.ranks import first_rows, quota_flag, ranked


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)]), i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r.i: (r.place, r.whole) for r in ranked(df, ["g"], ["v", "i"], "place", total="whole").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (k, len(mine)) for k, r in enumerate(mine)}
    assert got == want


def test_ranked_without_groups_and_empty(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("x"))
    assert sorted((r.x, r["rank"]) for r in ranked(df, [], ["x"]).collect()) == [(i, i) for i in range(100)]
    assert ranked(df.where("x < 0"), [], ["x"]).count() == 0


def test_hot_group_takes_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df, ["g"], ["id"])
        assert out.where("rank <> id").count() == 0
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 20_000
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]  # noqa: SLF001


@pytest.mark.parametrize("digits", [1, 4])
def test_quotas(spark, digits):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "g string, v int, i int")
    quota = spark.createDataFrame([("a", 37), ("b", 10_000), (None, 0)], "g string, quota long")
    digest = F.md5(F.col("i").cast("string"))
    got = {r.i for r in first_rows(df, ["g"], digest, ["i"], quota, digits).collect()}
    order = lambda r: (hashlib.md5(str(r[2]).encode()).hexdigest(), r[2])
    want = {r[2] for r in sorted((r for r in rows if r[0] == "a"), key=order)[:37]} | {r[2] for r in rows if r[0] == "b"}
    assert got == want
    flags = quota_flag(df, ["g"], digest, ["i"], 5, "kept", digits)
    assert flags.count() == len(rows)
    assert sorted((r.g or "", r.n) for r in flags.where("kept").groupBy("g").agg(F.count("*").alias("n")).collect()) == [("", 5), ("a", 5), ("b", 5)]
    assert first_rows(df, [], digest, ["i"], 7, digits).count() == 7
    assert first_rows(df.where("i < 0"), ["g"], digest, ["i"], quota, digits).count() == 0


def test_split_of_small_classes(spark):
    docs = spark.createDataFrame([(0, "one"), (1, "two"), (2, "two")], "doc_id long, corpus_class string")
    sides = {(r.corpus_class, r.side): r["count"] for r in corpus.split(docs).groupBy("corpus_class", "side").count().collect()}
    assert sides == {("one", "eval"): 1, ("two", "train"): 1, ("two", "eval"): 1}

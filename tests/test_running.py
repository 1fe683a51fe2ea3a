"""Running and sliding sums against a direct count, with ties and a hot key."""

import random

import pytest

from sparkward.operators.running import Cut, Running, Sliding, running, sliding


def rows(seed, n=600, span=4000):
    rnd = random.Random(seed)
    # One key holds more than a third of the rows.
    return [(i, rnd.choice("aaaabcd"), rnd.randrange(span) - span // 4, rnd.randrange(5)) for i in range(n)]


@pytest.mark.parametrize("seed,width,stretch", [(1, 300, 1000), (2, 1000, 70), (3, 1, 10), (4, 5000, 333)])
def test_sliding(spark, seed, width, stretch):
    data = rows(seed)
    df = spark.createDataFrame(data, "id int, k string, us bigint, m bigint")
    got = sliding(df, ["k"], "us", {"upto": Sliding("m", width), "past": Sliding("m", 2 * width, before=True)}, Cut(stretch))
    assert got.columns == ["id", "k", "us", "m", "upto", "past"]
    assert got.count() == len(data)
    for r in got.collect():
        same = [(t, m) for _, k, t, m in data if k == r["k"]]
        assert r["upto"] == sum(m for t, m in same if 0 <= r["us"] - t < width)
        assert r["past"] == sum(m for t, m in same if 0 < r["us"] - t < 2 * width)


@pytest.mark.parametrize("seed,stretch", [(5, 100), (6, 7), (7, 100_000)])
def test_running(spark, seed, stretch):
    data = rows(seed)
    df = spark.createDataFrame(data, "id int, k string, us bigint, m bigint")
    got = running(df, ["k"], "us", {
        "total": Running("m"), "prev": Running("us", "max", before=True),
        "next": Running("us", "min", before=True, ahead=True), "best": Running("m", "max"),
    }, Cut(stretch))
    for r in got.collect():
        same = [(t, m) for _, k, t, m in data if k == r["k"]]
        assert r["total"] == sum(m for t, m in same if t <= r["us"])
        assert r["best"] == max(m for t, m in same if t <= r["us"])
        assert r["prev"] == max((t for t, _ in same if t < r["us"]), default=None)
        assert r["next"] == min((t for t, _ in same if t > r["us"]), default=None)


def test_a_hot_key_is_spread(spark):
    """The rows of one key end up in many partitions of the shuffle."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 1000).alias("us"), F.lit(1).cast("bigint").alias("m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sliding(df, ["k"], "us", {"n": Sliding("m", 50_000)}, Cut(100_000))
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 10_000
    assert got.filter("n > 50").count() == 0 and got.filter("n = 50").count() == 20_000 - 49


def test_null_keys_are_a_key(spark):
    """Rows in, rows out, and the same sums as for a key with a name; 200 keys, some null."""
    from sparkward.operators.ranking import neighbours, ranks

    rnd = random.Random(8)
    data = [(i, rnd.choice([None, None, *[f"k{j}" for j in range(200)]]), rnd.randrange(2000), 1) for i in range(1500)]
    df = spark.createDataFrame(data, "id int, k string, us bigint, m bigint")
    got = {r["id"]: r for r in sliding(df, ["k"], "us", {"n": Sliding("m", 500)}, Cut(100)).collect()}
    assert len(got) == len(data)
    for i, k, us, _ in data:
        assert got[i]["n"] == sum(1 for _, k2, t, _ in data if k2 == k and 0 <= us - t < 500)
    ranked = {r["id"]: r["row_number"] for r in ranks(df, ["k"], "us", ["id"], Cut(100)).collect()}
    near = {r["id"]: r["lag"] for r in neighbours(df, ["k"], "us", ["id"], "id", Cut(100)).collect()}
    for key in {k for _, k, _, _ in data}:
        own = [i for _, i in sorted((us, i) for i, k, us, _ in data if k == key)]
        assert [ranked[i] for i in own] == list(range(1, len(own) + 1))
        assert [near[i] for i in own] == [None, *own[:-1]]

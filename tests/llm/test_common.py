from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenspan.llm import common


@pytest.mark.parametrize("bound", [1 << 20, 300, 10])
def test_checked_joins_equal_plain_ones(spark, monkeypatch, bound):
    """Sides that fit, sides of which the heaviest keys fit, and sides of which none does."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    left = spark.range(300).select((F.sqrt("id").cast("int")).alias("k"), "id")
    right = left.where("k % 3 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.array_repeat(F.lit(1), F.max("k")).alias("more"))
    rows = right.count()
    for how in ("inner", "left", "left_semi"):
        got = common.hot_join(left, right, ["k"], how, rows, 40, "n", hot=4, size=8 * F.size("more"))
        assert Counter(map(str, got.collect())) == Counter(map(str, left.join(right, "k", how).collect()))
    assert Counter(common.without(left, right, ["k"], rows, 40, "n", hot=4).collect()) == Counter(left.join(right, "k", "left_anti").collect())


def test_bound_is_raised_until_keys_fit(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    right = spark.range(1000).select("id", F.col("id").alias("n"))
    bound = common.fitting(right, F.lit(10), "n", 4)
    assert right.where(F.col("n") > bound).count() * 10 <= 100 < right.where(F.col("n") > bound // 2).count() * 10


def test_rank_is_global(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") % 2 == 0).alias("at"), F.lit(None).cast("long").alias("rank0"))
    got = sorted(common.ranked(rows, ["a"], "rank")[0].collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(500)) and [r["a"] for r in got] == sorted(r["a"] for r in got)
    assert common.ranked(rows.limit(0), ["a"], "rank")[0].collect() == []

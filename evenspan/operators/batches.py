"""Orders that are balanced, seeded or bucketed by length, and the batches cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import seeded_key
from ..functions.timegrid import div
from .durable import checkpointed


def ranked(df: DataFrame, *order, name: str) -> DataFrame:
    """Adds a global rank from 0.  The rows are components or samples, not events; ranks are counted per range of the order, then shifted, so no task holds all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = {r[0]: r[1] for r in dealt.groupBy("_part").count().collect()}  # one row for each partition
    shift, total = F.lit(0), 0
    for part in sorted(sizes):
        shift = F.when(F.col("_part") == part, total).otherwise(shift)
        total += sizes[part]
    return within.withColumn(name, (F.col("_in") - 1 + shift).cast("bigint")).drop("_in", "_part")


def balanced_order(components: DataFrame, seed: int, purpose: str, bins: int = 10) -> DataFrame:
    """Components (id, density) ranked into bins of density, then dealt from the bins in turn, in seeded order; adds bin and place."""
    total = components.count()
    bins = max(1, min(bins, total))
    rows = ranked(components, "density", "id", name="rank").withColumn("bin", F.least(F.lit(bins - 1), div(F.col("rank") * bins, max(total, 1))))
    turn = F.row_number().over(Window.partitionBy("bin").orderBy(seeded_key(seed, purpose, F.col("id"))))
    rows = rows.withColumn("turn", turn).withColumn("bin_key", seeded_key(seed, f"{purpose}:bin", F.col("bin")))
    return ranked(rows, "turn", "bin_key", name="place").drop("bin_key", "turn", "rank")


def sized_batches(samples: DataFrame, n: int) -> DataFrame:
    """Samples (id, size) in batches of n, ascending by size."""
    return ranked(samples, "size", "id", name="i").select("id", "size", div(F.col("i"), n).alias("batch"))


def epoch_batches(samples: DataFrame, seed: int, window: int, n: int) -> DataFrame:
    """Samples in a seeded order, sorted by size within windows of that order, and cut into batches of n."""
    rows = ranked(samples.withColumn("_k", seeded_key(seed, "epoch", F.col("id"))), "_k", name="i").withColumn("w", div(F.col("i"), window))
    j = F.row_number().over(Window.partitionBy("w").orderBy("size", "id")) - 1
    return rows.withColumn("j", j).select("id", "size", (F.col("w") * (window // n) + div(F.col("j"), n)).alias("batch"))

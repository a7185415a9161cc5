"""Cutting the lineage of loops and ranks by files that outlive any executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that ``spark.checkpoint.dir`` names (one of our own where it is unset)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

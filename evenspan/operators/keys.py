"""Key estimation: pitch-class weights against published key profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pitch import major_frame

#: The profiles of Krumhansl and Kessler, and of Aarden and Essen, from the tonic up.
PROFILES = {
    "krumhansl": {
        "major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
        "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
    },
    "aarden": {
        "major": (17.7661, 0.145624, 14.9265, 0.160186, 19.8049, 11.3587, 0.291248, 22.062, 0.145624, 8.15494, 0.232998, 4.95122),
        "minor": (18.2648, 0.737619, 14.0499, 16.8599, 0.702494, 14.4362, 0.702494, 18.6161, 4.56621, 1.93186, 7.37619, 1.75623),
    },
}


def profile_rows() -> list[tuple[str, int, str, int, float]]:
    """analyzer, tonic, mode, pitch class, weight of the 24 keys."""
    return [(a, t, m, (t + i) % 12, w) for a, modes in PROFILES.items() for m, weights in modes.items() for t in range(12) for i, w in enumerate(weights)]


def weights(facts: DataFrame) -> DataFrame:
    """song_id, pc, weight: sounding time of all twelve pitch classes, absent ones 0."""
    notes = facts.where("event_type = 'NOTE'")
    have = notes.groupBy("song_id", F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum("duration").cast("double").alias("weight"))
    grid = notes.select("song_id").distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return grid.join(have, ["song_id", "pc"], "left").fillna(0.0, ["weight"])


def correlations(facts: DataFrame) -> DataFrame:
    """song_id, analyzer, tonic, mode, correlation of the weights with each key's profile."""
    spark = facts.sparkSession
    profiles = F.broadcast(spark.createDataFrame(profile_rows(), "analyzer string, tonic int, mode string, pc int, p double"))  # 576 rows
    return weights(facts).join(profiles, "pc").groupBy("song_id", "analyzer", "tonic", "mode").agg(F.corr("weight", "p").alias("correlation"))


def estimates(facts: DataFrame) -> DataFrame:
    """Per song and analyzer: the best key and its margin to the best key in another frame."""
    rows = correlations(facts).withColumn("frame", major_frame(F.col("tonic"), F.col("mode")))
    order = [F.round("correlation", 9).desc_nulls_last(), "tonic", "mode"]
    w = Window.partitionBy("song_id", "analyzer")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("best_frame", F.first("frame").over(w.orderBy(*order)))
    return rows.groupBy("song_id", "analyzer").agg(
        F.max(F.when(F.col("rank") == 1, F.col("tonic"))).alias("tonic"), F.max(F.when(F.col("rank") == 1, F.col("mode"))).alias("mode"), F.first("best_frame").alias("frame"),
        F.max("correlation").alias("correlation"), (F.max("correlation") - F.max(F.when(F.col("frame") != F.col("best_frame"), F.col("correlation")))).alias("margin"),
    )

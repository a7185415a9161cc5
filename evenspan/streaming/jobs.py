"""The same operators on streams of events: windows with a watermark, sessions, and rests that stay open between batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.shared import shared_dir
from .rests import use_state_store

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def _rests(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    reach = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["onset", "pitch", "duration"])
    out = []
    for onset, duration in zip(rows["onset"].tolist(), rows["duration"].tolist()):
        if onset > reach:
            out.append((key[0], reach, onset - reach))
        reach = max(reach, onset + duration)
    state.update((reach,))
    yield pd.DataFrame(out, columns=["song_id", "onset", "duration"])


def open_rests(facts: DataFrame) -> DataFrame:
    """Rests of a stream of facts that comes in order of onset by batches: each song's reach is its state."""
    return facts.groupBy("song_id").applyInPandasWithState(_rests, "song_id long, onset long, duration long", "reach long", "append", GroupStateTimeout.NoTimeout)


def ran(stream: DataFrame, folder: str) -> None:
    """Run a stream to the end of what there is, into files; a run in the same folder goes on from the checkpoint of the one before."""
    # output, checkpoint and state are in the folder that all executors share: none of it passes through the driver
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def by_parts(parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` makes of a stream of parts: it is stopped after each part and started again from its checkpoint."""
    spark, folder = parts[0].sparkSession, f"{shared_dir(parts[0].sparkSession)}/streams/{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        made = operator(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        ran(made, folder)
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def closed(spark: SparkSession, path: str, operator: Callable[..., DataFrame]) -> DataFrame:
    """What ``operator`` makes of all events, in whatever order their files come: the watermark stays behind the first event.

    A mark that is read after the last event moves the watermark beyond it, which closes what is open; what holds the mark itself stays open.
    """
    use_state_store(spark)
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = spark.read.schema(SCHEMA).parquet(path).agg(F.coalesce(F.min(second), F.lit(0)), F.coalesce(F.max(second), F.lit(0))).first()
    late = last - first + 1
    at = F.timestamp_seconds(F.lit(last + late + 2 * 86_400)).cast("timestamp_ntz")
    mark = spark.range(1).select(*(at.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA)))
    mark.limit(0).write.parquet(f"{folder}/mark")
    for _ in range(2):
        made = operator(event_stream(spark, path).unionByName(event_stream(spark, f"{folder}/mark")), late=f"{late} seconds")
        ran(made, folder)
        mark.write.mode("append").parquet(f"{folder}/mark")
    return spark.read.schema(made.schema).parquet(f"{folder}/out")

"""Scans that a table of metadata leads: each of its rows gets its file's record, or the first fault that was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import midi

#: The metadata's names of keys, and the ticks of a beat of its files.
KEYS, TICKS = {"cmajor": "C", "aminor": "Am"}, 480
#: Bytes of metadata that are sent to the files; more meets them by a shuffle.
SMALL = 32 << 20


def read_metadata(spark: SparkSession, path: str, meter: str = "4/4") -> DataFrame:
    """The rows of the meter (a condition that reaches the scan) of a CSV file with a header, which may begin with a byte order mark."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns)).where(F.col("time_signature") == meter)


def scanned(meta: DataFrame, files: DataFrame, meter: str = "4/4") -> DataFrame:
    """sample_id, split, source_path, fault, error, note_count, notes of every row of metadata.

    ``files`` (path, content) have paths below the data's folder.  Faults: missing, unreadable, ticks, frame (a key that
    the metadata may not have), key (the file says another), meter, repeated (a file that several rows name).
    """
    path = F.concat_ws("/", F.lit("commu_midi"), "split_data", F.lit("raw"), F.concat("id", F.lit(".mid")))
    named = meta.select(F.col("id").alias("sample_id"), F.col("split_data").alias("split"), "audio_key", path.alias("path"))
    named = named.groupBy("path").agg(F.min_by(F.struct("sample_id", "split", "audio_key"), "sample_id").alias("m"), F.count("*").alias("rows")).select("path", "rows", "m.*")
    wanted = named.select("path")
    wanted = F.broadcast(wanted) if named.count() * 128 <= SMALL else wanted
    parsed = midi.parsed(files.join(wanted, "path", "left_semi"), strict=True)
    both = named.join(parsed, "path", "left")
    key = F.create_map(*(F.lit(x) for item in KEYS.items() for x in item))
    expected = F.try_element_at(key, F.col("audio_key"))
    fault = (
        F.when(F.col("rows") > 1, "repeated").when(F.col("status").isNull(), "missing").when(F.col("status") != "ok", "unreadable").when(F.col("ppq") != TICKS, "ticks").when(expected.isNull(), "frame")
        .when(~F.array_distinct("keys").eqNullSafe(F.array(expected)), "key").when(F.array_distinct("meters") != F.array(F.lit(meter)), "meter")
    )
    sound = fault.isNull()
    return both.select("sample_id", "split", F.col("path").alias("source_path"), fault.alias("fault"), "error", F.when(sound, F.size("notes")).otherwise(0).cast("long").alias("note_count"), F.when(sound, F.col("notes")).alias("notes"))

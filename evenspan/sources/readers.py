"""Text sources with fixed schemas, and scans that check what they read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    """With a header; a condition reaches the scan."""
    rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.where(where) if where else rows


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table that is partitioned by split: the others aren't opened."""
    return spark.read.parquet(path).where(F.col("split") == split)


def downbeats(lines: DataFrame) -> DataFrame:
    """song_id, i, time from (song_id, n, line): lines of three fields or more whose third is 0.5 at least, and one more after the median of the steps."""
    f = F.split(F.trim("line"), r"\s+")
    beats = lines.select("song_id", "n", f.alias("f")).where((F.size("f") >= 3) & (F.get("f", F.lit(2)).try_cast("double") >= 0.5))
    beats = beats.select("song_id", "n", F.col("f")[0].cast("double").alias("time"))
    w = Window.partitionBy("song_id").orderBy("n")
    steps = beats.withColumn("step", F.col("time") - F.lag("time").over(w))
    steps = steps.where(F.when(F.col("step").isNull() | (F.col("step") > 0), True).otherwise(F.raise_error(F.lit("downbeats go backward")).cast("boolean")))
    last = steps.groupBy("song_id").agg((F.max("n") + 1).alias("n"), (F.max("time") + F.median("step")).alias("time"))
    return steps.select("song_id", "n", "time").unionByName(last).select("song_id", (F.row_number().over(w) - 1).alias("i"), "time")


def chord_intervals(lines: DataFrame) -> DataFrame:
    """song_id, n, start, stop, label from lines of three fields."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.where(F.trim("line") != "").select("song_id", "n", f.alias("f"))
    return rows.select("song_id", "n", F.col("f")[0].cast("double").alias("start"), F.col("f")[1].cast("double").alias("stop"), F.col("f")[2].alias("label"))


def longest_key(intervals: DataFrame) -> DataFrame:
    """song_id, label of the longest interval; the first line wins ties, and intervals without a length don't count."""
    rows = intervals.withColumn("span", F.col("stop") - F.col("start")).where("span > 0")
    return rows.groupBy("song_id").agg(F.max_by("label", F.struct("span", (-F.col("n")).alias("n"))).alias("label"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def tree_digest(inventory: DataFrame) -> DataFrame:
    """One digest over the sorted lines path NUL digest; folded in 256 groups of paths first, so no task holds all lines."""
    line = F.concat(F.col("path"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.col("sha256"))
    groups = inventory.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def relative_path(path, root: str):
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def source_song_id(path: Column, corpus: str) -> Column:
    """``corpus:src_x:n`` of a relative path src_x/n.ext, n an integer; other paths are an error."""
    found = r"^(src_[^/]*)/([+-]?\d+)(?:\.[^./]*)?$"
    wrong = F.raise_error(F.concat(F.lit("unexpected path "), F.coalesce(path, F.lit("null")))).cast("string")
    return F.when(path.rlike(found), F.concat_ws(":", F.lit(corpus), F.regexp_extract(path, found, 1), F.regexp_extract(path, found, 2))).otherwise(wrong)


def load_config(path: str, version: str | None = None) -> dict:
    """A configuration file in JSON; with ``version``, another ``schema_version`` is an error."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if version is not None and value.get("schema_version") != version:
        raise ValueError(f"unexpected schema version {value.get('schema_version')!r}")
    return value


def tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tokenizer's JSON file as vocabulary (token, id) and merges (rank, left, right)."""
    text = spark.read.option("wholetext", True).text(path)
    model = text.select(F.from_json("value", "model struct<vocab:map<string,int>,merges:array<string>>").alias("t")).select("t.model.*")
    vocabulary = model.select(F.explode("vocab").alias("token", "id"))
    merges = model.select(F.posexplode("merges").alias("rank", "m"))
    # a merge is written as a list of two or as two words
    pair = F.when(F.col("m").startswith("["), F.from_json("m", "array<string>")).otherwise(F.split("m", " ", 2))
    return vocabulary, merges.select("rank", pair[0].alias("left"), pair[1].alias("right"))

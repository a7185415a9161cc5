"""Contracts, consensus, selection, detectors and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def song_contract(facts: DataFrame) -> DataFrame:
    """Per song: size, ranges, and whether every fact is sound."""
    sound = F.col("pitch").between(0, 127) & (F.col("duration") > 0)
    return facts.groupBy("song_id").agg(
        F.count("*").alias("n"), F.min("pitch").cast("bigint").alias("low"), F.max("pitch").cast("bigint").alias("high"),
        F.min("onset").alias("first_onset"), F.max(F.col("onset") + F.col("duration")).alias("last_end"), F.bool_and(sound).alias("sound"),
    )


def consensus(rows: DataFrame, correlation: float = 0.6, margin: float = 0.05) -> DataFrame:
    """Two analyses ``a`` and ``b`` (frame, correlation, margin): accepted if they agree and both are sure, and no frame where they don't agree."""
    a, b = F.col("a"), F.col("b")
    agree = a["frame"] == b["frame"]
    sure = (F.least(a["correlation"], b["correlation"]) >= correlation) & (F.least(a["margin"], b["margin"]) >= margin)
    return rows.withColumn("status", F.when(~agree, "disagree").when(sure, "accepted").otherwise("low")).withColumn("frame", F.when(agree, a["frame"]))


def best_checkpoint(history: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """The least exposure among the rows whose bits are the least but for ``tolerance``."""
    best = F.min("bits").over(Window.partitionBy(*keys))
    tied = history.withColumn("best", best).where(F.col("bits") <= F.col("best") + tolerance)
    return tied.groupBy(*keys).agg(F.min("exposure").alias("exposure"), F.min("best").alias("bits"))


def missing_fields(have: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), have))


def hash_matches(given: Column, true: Column) -> Column:
    return (F.length(given) == 64) & (given == true)


def findings(rows: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Distinct (key, detector) of the patterns found in a text, in one pass over the rows."""
    hits = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items())))
    return rows.select(key, F.explode(hits).alias("detector")).distinct()


def exclusive_slots(rows: DataFrame, key: str, slot: str, wanted: list[int]) -> DataFrame:
    """Whether each wanted slot of a key is there exactly once; keys without any are left out."""
    counts = rows.where(F.col(slot).isin(wanted)).groupBy(key, slot).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg((F.bool_and(F.col("n") == 1) & (F.count("*") == len(wanted))).alias("owned"))


#: What each arm of the comparison does with time and pitch.
ARMS = [
    ("A", "sequence", "absolute"), ("B", "lookup", "absolute"), ("C", "unary", "absolute"), ("D", "pairwise", "absolute"), ("E", "pairwise", "chromatic"), ("F", "pairwise", "absolute"),
    ("G", "pairwise", "canonical"), ("H", "pairwise", "class"), ("I", "pairwise", "fifths"), ("J", "serialized", "token"), ("K", "serialized", "bpe"),
]


#: Active parameters of each arm.
PARAMETERS = {"A": 809_475, "B": 811_079, "C": 810_499, "D": 812_815, "E": 805_455, "F": 812_815, "G": 812_815, "H": 813_519, "I": 805_455, "J": 689_349, "K": 804_675}
#: Family, pitch interface, and whether pitches are moved and the frame is an input, of the arms that differ in pitch alone.
FLAGS = {
    "F": ("tonal_reference_v1", "raw_transposed_midi_id", "true", "false"), "G": ("tonal_reference_v1", "learned_relative_pc_plus_relative_register", "true", "true"),
    "H": ("pitch_interface_v1", "learned_absolute_pc_plus_absolute_register", "false", "false"), "I": ("pitch_interface_v1", "fixed_fifths_circle_plus_absolute_register", "false", "false"),
}


def representations(spark: SparkSession) -> DataFrame:
    """arm, time, pitch, parameters, flags (null where an arm has no contract of flags)."""
    rows = [(*row, PARAMETERS[row[0]], list(FLAGS[row[0]]) if row[0] in FLAGS else None) for row in ARMS]
    return spark.createDataFrame(rows, "arm string, time string, pitch string, parameters long, flags array<string>")


def representation(arm: str) -> dict:
    for row in ARMS:
        if row[0] == arm:
            return dict(zip(("arm", "time", "pitch"), row)) | {"parameters": PARAMETERS[arm], "flags": FLAGS.get(arm)}
    raise KeyError(arm)


def flags_hold(wanted: Column, seen: Column) -> Column:
    """Whether a run has all of its arm's flags, in their order; an arm without a contract holds."""
    return wanted.isNull() | (wanted == seen)


def require_flags(arm: str, seen: tuple[str, ...]) -> None:
    """Flags other than the arm's are an error."""
    if arm in FLAGS and tuple(seen) != FLAGS[arm]:
        raise ValueError(f"{arm} has {seen}, not {FLAGS[arm]}")


def unchanged_counts(manifest: DataFrame, counted: DataFrame, key: str = "song_id", count: str = "target_event_count") -> DataFrame:
    """The manifest, whose counts have to be those counted anew; another count, or none, is an error."""
    both = manifest.join(counted.select(key, F.col(count).alias("_now")), key, "left")
    wrong = F.raise_error(F.concat(F.lit("count changed for "), F.col(key).cast("string"))).cast("bigint")
    return both.withColumn(count, F.when(F.col(count) == F.col("_now"), F.col(count)).otherwise(wrong)).drop("_now")

"""The corpus build: files -> records and facts -> families -> splits -> audit -> reports, published as one.

Every table is made by joins and aggregations on sample ids and hashes; notes are read once, in the first stage.
Nothing of the size of the corpus comes to the driver: counts of splits and of relations do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import midi
from . import lineage
from .staged import StagedBuild, inventory_digest

RELATIONS = ["exact_hash", "transposition_invariant_hash", "rhythm_interval_hash"]
#: The 29 columns of the lineage table: names, types and which may be null (fixed values).
LINEAGE = """sample_id string NOT NULL, release_index int NOT NULL, source_path string NOT NULL, source_song_id string, lineage_id string NOT NULL, augmentation_type string NOT NULL,
transpose_offset smallint, crop_window_information string NOT NULL, preprocessing_version string NOT NULL, source_byte_sha256 string NOT NULL, exact_hash string,
transposition_invariant_hash string, rhythm_interval_hash string, source_ticks_per_beat int, note_count int NOT NULL, onset_count int NOT NULL, duration_ticks bigint NOT NULL,
duration_beats double NOT NULL, time_signature_summary string NOT NULL, drum_note_count int NOT NULL, source_metadata_status string NOT NULL, lineage_confidence string NOT NULL,
lineage_status string NOT NULL, merge_reasons string NOT NULL, split string NOT NULL, old_split string NOT NULL, moved_relative_to_old boolean NOT NULL, parse_status string NOT NULL, parse_error string"""
#: Columns of a sample's line in the manifest of its split (fixed values).
SAMPLE = ["sample_id", "source_path", "source_song_id", "lineage_id", *RELATIONS, "note_count", "onset_count", "duration_beats", "preprocessing_version"]
#: What is said of releases that tell nothing of their sources (fixed values).
SAID = {
    "augmentation_type": "release_augmented; per-sample operation unavailable",
    "crop_window_information": "released_8_bar_excerpt; original crop/window unavailable",
    "source_metadata_status": "no source-work or augmentation provenance in released MIDI",
}
CORRUPT = "excluded_proven_corruption"


def scanned(files: DataFrame, version: str) -> dict[str, DataFrame]:
    """``records``: one for each file (path, content), broken ones too; ``facts``: the notes of the others, in the file's own ticks."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    release = F.coalesce(F.expr("try_cast(regexp_extract(sample_id, '_([^_]*)$', 1) AS int)"), F.lit(-1))
    found = midi.parsed(files, strict=True, per_beat=None).withColumn("sample_id", stem)
    ends = F.transform("notes", lambda n: n["onset"] + n["duration"])
    starts = F.transform("notes", lambda n: n["onset"])
    ok = F.col("status") == "ok"
    ticks = F.when(ok, F.array_max(ends) - F.array_min(starts)).otherwise(0).cast("long")
    meters = F.array_sort("meters", lambda a, b: F.when(_meter(a) < _meter(b), -1).when(_meter(a) > _meter(b), 1).otherwise(0))
    records = found.join(files.select("path", F.sha2("content", 256).alias("source_byte_sha256")), "path").select(
        "sample_id", release.alias("release_index"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("source_song_id"), F.lit(None).cast("smallint").alias("transpose_offset"),
        *(F.lit(v).alias(k) for k, v in SAID.items()), F.lit(version).alias("preprocessing_version"), "source_byte_sha256", F.when(ok, F.col("ppq")).alias("source_ticks_per_beat"),
        F.when(ok, F.size("notes")).otherwise(0).alias("note_count"), F.when(ok, F.size(F.array_distinct(starts))).otherwise(0).alias("onset_count"), ticks.alias("duration_ticks"),
        F.when(ok, ticks / F.col("ppq")).otherwise(0.0).alias("duration_beats"), F.when(ok, F.array_join(F.array_distinct(meters), ";")).otherwise("").alias("time_signature_summary"),
        F.when(ok, F.col("drum_notes")).otherwise(0).cast("int").alias("drum_note_count"), F.col("status").alias("parse_status"), F.when(~ok, F.coalesce("error", F.lit("unknown"))).alias("parse_error"),
    )
    facts = found.where(ok).select(F.col("sample_id").alias("song_id"), "ppq", F.explode("notes").alias("n")).select("song_id", "ppq", F.lit("NOTE").alias("event_type"), "n.onset", "n.duration", "n.pitch")
    return {"records": records, "facts": facts}


def _meter(text: Column) -> Column:
    parts = F.split(text, "/")
    return F.struct(parts[0].cast("int"), parts[1].cast("int"))


def hashed(facts: DataFrame, version: str) -> DataFrame:
    """sample_id and the three hashes; times are in beats of the file's own grid, so each grid is hashed by itself."""
    grids = [r[0] for r in facts.select("ppq").distinct().collect()]  # as many as MIDI files use
    out = None
    for ppq in grids:
        part = lineage.line_hashes(facts.where(F.col("ppq") == ppq).drop("ppq"), version, ppq)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = lineage.line_hashes(facts.drop("ppq"), version)
    return out.select(F.col("song_id").alias("sample_id"), F.col("exact").alias("exact_hash"), F.col("transposed").alias("transposition_invariant_hash"), F.col("rhythm").alias("rhythm_interval_hash"))


def family_members(records: DataFrame, hashes: DataFrame, prefix: str) -> DataFrame:
    """Records with their hashes and family; broken files are families of their own."""
    rows = records.join(hashes, "sample_id", "left")
    sound = rows.where("parse_status = 'ok'").select("sample_id", *RELATIONS)
    roots = lineage.components(sound, RELATIONS, "sample_id")
    found = lineage.families(sound, RELATIONS, f"{prefix}_content_family_", "sample_id", roots)
    members = roots.join(found, "root").select("sample_id", "lineage_id", "sample_count", F.array_join(F.array_sort(F.split("reasons", ",")), ",").alias("merge_reasons"))
    out = rows.join(members, "sample_id", "left")
    bad = F.col("parse_status") != "ok"
    lone = F.concat(F.lit(f"{prefix}_corrupt_"), F.substring(F.sha2("sample_id", 256), 1, 24))
    status = F.when(bad, CORRUPT).when(F.col("sample_count") > 1, "content_family_detected_without_source_provenance").otherwise("singleton_without_source_provenance")
    return out.withColumns({
        "lineage_id": F.when(bad, lone).otherwise(F.col("lineage_id")), "merge_reasons": F.coalesce("merge_reasons", F.lit("")),
        "lineage_confidence": F.when(bad, CORRUPT).otherwise("unresolved_source_lineage"), "lineage_status": status,
    }).drop("sample_count")


def split_members(members: DataFrame, validation: int, test: int, old_holdout: int, seed: int) -> DataFrame:
    """Whole families in splits, and the former split by release order; broken files are excluded from both."""
    sound = members.where("parse_status = 'ok'")
    sizes = sound.groupBy(F.col("lineage_id").alias("id")).agg(F.count("*").alias("n"), F.avg("note_count").alias("density"))
    splits = lineage.assign_splits(sizes, test, validation, seed).select(F.col("id").alias("lineage_id"), "split")
    placed = sound.join(splits, "lineage_id")
    old = lineage.moved_samples(placed.select(F.col("sample_id").alias("id"), F.col("release_index").alias("release"), "split"), old_holdout)
    placed = placed.join(old.select(F.col("id").alias("sample_id"), "old_split", F.col("moved").alias("moved_relative_to_old")), "sample_id")
    broken = members.where("parse_status <> 'ok'").select("*", F.lit("excluded").alias("split"), F.lit("excluded").alias("old_split"), F.lit(False).alias("moved_relative_to_old"))
    return placed.unionByName(broken)


def lineage_table(rows: DataFrame) -> DataFrame:
    """In the contract's columns and types; a null where none may be is an error."""
    schema = StructType.fromDDL(LINEAGE)
    fault = lambda f: F.raise_error(F.lit(f"{f.name} may not be null")).cast(f.dataType)
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.nullable else F.coalesce(F.col(f.name).cast(f.dataType), fault(f)).alias(f.name) for f in schema))


def reports(rows: DataFrame) -> dict[str, DataFrame]:
    """Seven tables: duplicates by relation, leakage, families, distributions, counts."""
    sound = rows.where("parse_status = 'ok'")
    out = {}
    for relation, name in zip(RELATIONS, ("exact_duplicates", "transposition_duplicates", "rhythm_interval_duplicates")):
        groups = sound.groupBy(F.col(relation).alias("hash")).agg(F.count("*").alias("group_size")).where("group_size > 1")
        out[name] = sound.withColumnRenamed(relation, "hash").join(groups, "hash").select("hash", "group_size", "lineage_id", "sample_id", "source_path", "split")
    out["lineage_leakage"] = lineage.crossing_report(sound, ["lineage_id", *RELATIONS])
    families = sound.groupBy("lineage_id").agg(F.count("*").alias("sample_count"), F.first("merge_reasons").alias("relation_types"), F.min("sample_id").alias("representative_sample_id"))
    lone = families.agg(F.count_if(F.col("sample_count") == 1).alias("sample_count")).select(F.lit("__UNRESOLVED_SINGLETONS__").alias("lineage_id"), "sample_count", F.lit("none_detected").alias("relation_types"), F.lit("").alias("representative_sample_id"))
    out["ambiguous_lineage"] = families.where("sample_count > 1").unionByName(lone).withColumn("source_lineage_confidence", F.lit("unresolved"))
    schemes = sound.select(F.lit("by_family").alias("partition_scheme"), "split", "note_count", "onset_count", "duration_beats").unionByName(sound.select(F.lit("by_release").alias("partition_scheme"), F.col("old_split").alias("split"), "note_count", "onset_count", "duration_beats"))
    total = F.sum("sample_count").over(Window.partitionBy("partition_scheme"))
    share = schemes.groupBy("partition_scheme", "split").agg(F.count("*").alias("sample_count"), F.avg("note_count").alias("mean_note_count"), *(F.percentile("note_count", p / 100).alias(f"p{p:02d}_note_count") for p in (5, 50, 95)), F.avg("onset_count").alias("mean_onset_count"), F.avg("duration_beats").alias("mean_duration_beats"))
    out["distribution_comparison"] = share.withColumn("sample_percent", 100.0 * F.col("sample_count") / total)
    out["split_counts"] = rows.groupBy("split", "old_split", "moved_relative_to_old", "parse_status").agg(F.count("*").alias("samples"), F.sum("note_count").alias("notes"))
    return out


def build(spark: SparkSession, files: DataFrame, root: str, *, validation: int, test: int, old_holdout: int = 0, seed: int = 0, version: str = "v1", prefix: str = "corpus", before=lambda stage: None) -> dict:
    """Build and publish from files (path, content); returns the manifest.

    A run with the same files and settings goes on where another one ended.  A value of a relation in two splits is an
    error, and then nothing is published.  ``before`` is called with each stage's name before it is run or read.
    """
    given = inventory_digest(files.select("path", F.sha2("content", 256).alias("sha256")))
    b = StagedBuild(spark, root, {"files": given, "validation": validation, "test": test, "old_holdout": old_holdout, "seed": seed, "version": version, "prefix": prefix})

    def stage(name: str, make) -> dict[str, DataFrame]:
        before(name)
        return b.stage(name, make)

    scan = stage("scan", lambda: scanned(files, version))
    hashes = stage("hashes", lambda: {"hashes": hashed(scan["facts"], version)})["hashes"]
    members = stage("families", lambda: {"members": family_members(scan["records"], hashes, prefix)})["members"]
    placed = stage("splits", lambda: {"lineage_table": lineage_table(split_members(members, validation, test, old_holdout, seed))})["lineage_table"]
    audit = stage("audit", lambda: {"crossings": lineage.crossings(placed.where("parse_status = 'ok'"), ["lineage_id", *RELATIONS])})["crossings"]
    crossing = {r["field"]: r["crossing"] for r in audit.collect()}
    if any(crossing.values()):
        raise ValueError(f"values in several splits: {crossing}")
    stage("samples", lambda: {s: placed.where(F.col("split") == s).select(*SAMPLE) for s in ("train", "validation", "test")})
    stage("reports", lambda: reports(placed))
    before("publish")
    return b.publish({"crossings": crossing})

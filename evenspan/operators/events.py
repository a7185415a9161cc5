"""Event facts of songs: canonical order, explicit rests, note groups, windows and contracts.

``facts`` has song_id, event_type (NOTE or REST), onset, duration, pitch (null for a rest).  All work is by song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import BAR, div

EPOCH = 1704067200  # 2024-01-01
ORDER = ["onset", "rank_pitch", "duration", "event_type"]


def facts_of(events: DataFrame, drums: str = "error") -> DataFrame:
    """Notes from an event log: minutes since 2024 as onsets; the rows of type ``drums`` are left out."""
    minute = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - EPOCH) / 60).cast("bigint")
    return events.where(F.col("event_type") != drums).select(
        F.col("user_id").alias("song_id"),
        F.lit("NOTE").alias("event_type"),
        minute.alias("onset"),
        F.greatest(F.lit(1), F.floor("value")).cast("bigint").alias("duration"),
        (14 + F.get_json_object("props", "$.k").cast("int")).alias("pitch"),
    )


def in_order(*keys: str) -> list[Column]:
    """Onset, pitch (rests first), duration, type."""
    return [F.col("onset"), F.coalesce("pitch", F.lit(-1)), F.col("duration"), F.col("event_type"), *map(F.col, keys)]


def by_song() -> Window:
    return Window.partitionBy("song_id").orderBy(*in_order())


def canonical(facts: DataFrame) -> DataFrame:
    """Adds ord, from 1, in canonical order; equal facts are interchangeable."""
    return facts.withColumn("ord", F.row_number().over(by_song()).cast("bigint"))


def insert_rests(facts: DataFrame, min_gap: int = 1, leading: bool = True) -> DataFrame:
    """The facts and a rest for each gap of at least ``min_gap`` ticks to the end of all earlier events; ``leading`` also counts silence from tick 0."""
    before = by_song().rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.col("onset") + F.col("duration")).over(before)
    end = F.coalesce(end, F.lit(0)) if leading else end
    gaps = facts.select("*", end.alias("_end")).where(F.col("onset") - F.col("_end") >= min_gap)
    rests = gaps.select("song_id", F.lit("REST").alias("event_type"), F.col("_end").alias("onset"), (F.col("onset") - F.col("_end")).alias("duration"), F.lit(None).cast("int").alias("pitch"))
    return facts.select("song_id", "event_type", "onset", "duration", "pitch").unionByName(rests)


def note_groups(facts: DataFrame) -> DataFrame:
    """song_id, onset, notes: the notes that start together, ascending by pitch and duration."""
    note = F.struct("pitch", "duration")
    return facts.where("event_type = 'NOTE'").groupBy("song_id", "onset").agg(F.array_sort(F.collect_list(note)).alias("notes"))


def atoms(facts: DataFrame, min_gap: int = 1) -> DataFrame:
    """song_id, t (from 0), kind, anchor, rest, notes: note groups with a rest before each that starts ``min_gap`` after all earlier notes end; no leading rest."""
    groups = note_groups(facts).withColumn("end", F.col("onset") + F.array_max(F.transform("notes", lambda n: n["duration"])))
    w = Window.partitionBy("song_id").orderBy("onset")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("reach", reach)
    gap = groups.where(F.col("onset") - F.col("reach") >= min_gap)
    rests = gap.select("song_id", F.lit("REST").alias("kind"), F.col("reach").alias("anchor"), (F.col("onset") - F.col("reach")).alias("rest"), F.lit(None).cast("array<struct<pitch:int,duration:bigint>>").alias("notes"))
    notes = groups.select("song_id", F.lit("NOTE").alias("kind"), F.col("onset").alias("anchor"), F.lit(None).cast("bigint").alias("rest"), "notes")
    # a rest that starts where a group does not overlap it comes before the next group
    order = Window.partitionBy("song_id").orderBy("anchor", F.col("kind").desc())
    return notes.unionByName(rests).withColumn("t", (F.row_number().over(order) - 1).cast("bigint"))


def boundaries(facts: DataFrame) -> DataFrame:
    """song_id, overlaps, touches, rests: how each group starts against the reach of all before it."""
    groups = note_groups(facts).withColumn("end", F.col("onset") + F.array_max(F.transform("notes", lambda n: n["duration"])))
    w = Window.partitionBy("song_id").orderBy("onset").rowsBetween(Window.unboundedPreceding, -1)
    gap = groups.withColumn("gap", F.col("onset") - F.max("end").over(w))
    return gap.groupBy("song_id").agg(F.count_if(F.col("gap") < 0).alias("overlaps"), F.count_if(F.col("gap") == 0).alias("touches"), F.count_if(F.col("gap") > 0).alias("rests"))


def tokens(facts: DataFrame, min_gap: int = 96) -> DataFrame:
    """song_id, ord, kind (2 note, 3 rest), anchor, pitch (0 for a rest), duration: atoms as a row of tokens; a rest comes before the notes of its anchor."""
    parts = atoms(facts, min_gap)
    rests = parts.where("kind = 'REST'").select("song_id", "t", F.lit(3).alias("kind"), "anchor", F.lit(0).alias("pitch"), F.col("rest").alias("duration"))
    notes = parts.where("kind = 'NOTE'").select("song_id", "t", F.lit(2).alias("kind"), "anchor", F.explode("notes").alias("n")).select("song_id", "t", "kind", "anchor", "n.pitch", "n.duration")
    order = Window.partitionBy("song_id").orderBy("t", "pitch", "duration")
    return rests.unionByName(notes).withColumn("ord", F.row_number().over(order).cast("bigint"))


def windows(facts: DataFrame, bars: int = 8, stride: int = 8, most: int | None = 2048) -> DataFrame:
    """The facts of each window of ``bars`` bars that starts every ``stride`` bars, by onset: rebased, not clipped, the tail kept, empty windows left out.

    A window of more than ``most`` events is an error.
    """
    bar = div(F.col("onset"), BAR)
    first = F.greatest(F.lit(0), div(bar - bars, stride) + 1)
    starts = F.transform(F.sequence(first, div(bar, stride)), lambda i: i * stride)
    out = facts.withColumn("start_bar", F.explode(starts) if stride < bars else div(bar, stride) * stride)
    if stride > bars:
        out = out.where(bar < F.col("start_bar") + bars)
    out = out.withColumn("rel_onset", F.col("onset") - F.col("start_bar") * BAR)
    if most is not None:
        n = F.count("*").over(Window.partitionBy("song_id", "start_bar"))
        out = out.withColumn("events", n).where(F.when(F.col("events") <= most, True).otherwise(F.raise_error(F.lit("too many events in a window")).cast("boolean"))).drop("events")
    return out


def clipped_windows(facts: DataFrame, bars: int = 8, tail: bool = False) -> DataFrame:
    """Tumbling windows with the sounding part of each event inside; without ``tail``, a last window that no event fills goes."""
    size = bars * BAR
    end = F.col("onset") + F.col("duration")
    out = facts.withColumn("w", F.explode(F.sequence(div(F.col("onset"), size), div(end - 1, size))))
    start = F.greatest(F.col("onset"), F.col("w") * size)
    stop = F.least(end, (F.col("w") + 1) * size)
    out = out.select("song_id", "event_type", "pitch", "w", (start - F.col("w") * size).alias("rel_onset"), (stop - start).alias("duration"), end.alias("_end"))
    if not tail:
        last = F.max("_end").over(Window.partitionBy("song_id"))
        out = out.withColumn("_last", last).where((F.col("w") + 1) * size <= F.col("_last")).drop("_last")
    return out.drop("_end")


def bar_slice(facts: DataFrame, first: int, stop: int) -> DataFrame:
    """Events that start in bars [first, stop), rebased; at most 32 bars."""
    if not 0 <= first < stop <= first + 32:
        raise ValueError("a slice has 1 to 32 bars")
    inside = facts.where((F.col("onset") >= first * BAR) & (F.col("onset") < stop * BAR))
    return inside.withColumn("rel_onset", F.col("onset") - first * BAR)


def faults(facts: DataFrame) -> DataFrame:
    """Rows with ``fault``: the first rule that a fact breaks, or null."""
    rest, note = F.col("event_type") == "REST", F.col("event_type") == "NOTE"
    fault = (
        F.when(~(rest | note) | F.col("event_type").isNull(), "type")
        .when(F.col("onset").isNull() | (F.col("onset") < 0), "onset")
        .when(F.col("duration").isNull() | (F.col("duration") <= 0), "duration")
        .when(note & (F.col("pitch").isNull() | ~F.col("pitch").between(0, 127)), "pitch")
        .when(rest & F.col("pitch").isNotNull(), "rest pitch")
    )
    return facts.withColumn("fault", fault)


def token_faults(rows: DataFrame) -> DataFrame:
    """The same for tokens, where a rest's pitch is 0."""
    fault = (
        F.when(~F.col("kind").isin(2, 3), "kind").when(F.col("anchor") < 0, "anchor").when(F.col("duration") <= 0, "duration")
        .when((F.col("kind") == 2) & ~F.col("pitch").between(0, 127), "pitch").when((F.col("kind") == 3) & (F.col("pitch") != 0), "rest pitch")
    )
    return rows.withColumn("fault", fault)


def backward_steps(rows: DataFrame, anchor: str = "anchor", order: str = "t") -> DataFrame:
    """Rows whose anchor is before the previous one's."""
    previous = F.lag(anchor).over(Window.partitionBy("song_id").orderBy(order))
    return rows.withColumn("_p", previous).where(F.col(anchor) < F.col("_p")).drop("_p")


def deltas(rows: DataFrame) -> DataFrame:
    """Tokens with the step from the previous anchor (the first from 0) in bars and remainder."""
    step = F.col("anchor") - F.lag("anchor", 1, 0).over(Window.partitionBy("song_id").orderBy("ord"))
    out = rows.withColumn("step", step)
    return out.withColumn("step_bars", div(F.col("step"), BAR)).withColumn("step_rest", F.pmod("step", F.lit(BAR)))


def tessitura(rows: DataFrame) -> DataFrame:
    """Running lowest and highest pitch, span / 127, centre / 254 and whether any note has come yet (zeros before)."""
    w = Window.partitionBy("song_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sounding = F.when(F.col("kind") == 2, F.col("pitch"))
    low, high = F.min(sounding).over(w), F.max(sounding).over(w)
    out = rows.withColumn("low", low).withColumn("high", high)
    zero = F.lit(0.0)
    return out.withColumn("span", F.coalesce((F.col("high") - F.col("low")) / 127, zero)).withColumn("centre", F.coalesce((F.col("high") + F.col("low")) / 254, zero)).withColumn("seen", F.col("low").isNotNull().cast("int"))


def local_relation(parts: DataFrame) -> DataFrame:
    """Atoms with their relation to the previous one."""
    previous = F.lag("kind").over(Window.partitionBy("song_id").orderBy("t"))
    return parts.withColumn("relation", F.when(previous.isNull(), "START").otherwise(F.concat(previous, F.lit("_"), F.col("kind"))))


def next_targets(parts: DataFrame) -> DataFrame:
    """What is to be predicted at each place of a stream, and its end: type, how its time and anchor are given, gaps and durations.

    A group's time is absolute at the start, fixed by the rest before it, or a step from the previous group; its lowest
    pitch is absolute at the start and after a rest, else a difference (plus 127).
    """
    w = Window.partitionBy("song_id").orderBy("t")
    low = F.col("notes")[0]["pitch"]
    rows = parts.select("*", low.alias("low"), F.lag("kind").over(w).alias("pkind"), F.lag("anchor").over(w).alias("panchor"), F.lag(low).over(w).alias("plow"))
    first, rested, rest = F.col("pkind").isNull(), F.col("pkind") == "REST", F.col("kind") == "REST"
    mode = F.when(rest, "REST_DURATION").when(first, "ABSOLUTE_START").when(rested, "NONE").otherwise("ONSET_DELTA")
    value = F.when(rest, F.col("rest")).when(first, F.col("anchor")).when(rested, F.lit(0)).otherwise(F.col("anchor") - F.col("panchor")).cast("bigint")
    pitches = F.transform("notes", lambda n: n["pitch"])
    gaps = F.zip_with(F.slice(pitches, 2, F.greatest(F.size(pitches) - 1, F.lit(0))), F.slice(pitches, 1, F.greatest(F.size(pitches) - 1, F.lit(0))), lambda a, b: a - b)
    out = rows.select(
        "song_id", "t", F.when(rest, "REST").otherwise("NOTE_GROUP").alias("target"), mode.alias("time_mode"), value.alias("time_value"),
        F.when(~rest, F.size("notes")).alias("cardinality"),
        F.when(rest, None).when(first | rested, "ABSOLUTE").otherwise("DELTA").alias("anchor_mode"),
        F.when(rest, None).when(first | rested, F.col("low")).otherwise(F.col("low") - F.col("plow") + 127).alias("anchor_class"),
        F.when(~rest, gaps).alias("gaps"), F.when(~rest, F.transform("notes", lambda n: n["duration"])).alias("durations"),
    )
    end = parts.groupBy("song_id").agg((F.max("t") + 1).alias("t")).select("song_id", "t", F.lit("EOS").alias("target"))
    return out.unionByName(end, allowMissingColumns=True)


def target_counts(facts: DataFrame, min_gap: int = 96) -> DataFrame:
    """song_id, target_event_count: a song's tokens and its end mark."""
    return tokens(facts, min_gap).groupBy("song_id").agg((F.count("*") + 1).alias("target_event_count"))


def component_counts(targets: DataFrame, keys: list[str]) -> DataFrame:
    """How many targets each component of the prediction applies to."""
    group, timed = F.col("target") == "NOTE_GROUP", F.coalesce(F.col("time_mode"), F.lit("NONE")) != "NONE"
    notes = F.coalesce(F.sum(F.when(group, F.col("cardinality"))), F.lit(0)).cast("bigint")
    counts = {"total": F.count("*"), "type": F.count("*"), "time": F.count_if(timed), "cardinality": F.count_if(group), "anchor": F.count_if(group)}
    counts |= {"gaps": F.coalesce(F.sum(F.when(group, F.size("gaps"))), F.lit(0)).cast("bigint"), "duration": notes, "raw_notes": notes}
    counts |= {"musical_units": F.count_if(F.col("target") != "EOS"), "eos": F.count_if(F.col("target") == "EOS")}
    return targets.groupBy(*keys).agg(*(c.alias(name) for name, c in counts.items()))


def translated(windows: DataFrame, bars: int, most: int = 256) -> DataFrame:
    """Windows that start ``bars`` bars later; a start outside of [0, ``most``) is an error."""
    start = F.col("start_bar") + bars
    held = F.when((start >= 0) & (start < most), start).otherwise(F.raise_error(F.lit("a window leaves the bars there are")).cast("bigint"))
    return windows.withColumn("start_bar", held)


def rebuilt(targets: DataFrame) -> DataFrame:
    """Facts again from :func:`next_targets`: anchors by running sums, lowest pitches by sums since the last absolute one."""
    w = Window.partitionBy("song_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = targets.where("target <> 'EOS'")
    # a step moves on from the previous group; after a rest the group stands at the rest's start plus its length
    rows = rows.withColumn("seg", F.sum(F.when(F.col("anchor_mode") == "ABSOLUTE", 1).otherwise(0)).over(w))
    within = Window.partitionBy("song_id", "seg").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.sum(F.when(F.col("anchor_mode") == "ABSOLUTE", F.col("anchor_class")).when(F.col("anchor_mode") == "DELTA", F.col("anchor_class") - 127)).over(within)
    rows = rows.withColumn("low", low)
    pitches = F.transform(F.sequence(F.lit(0), F.size("gaps")), lambda i: F.aggregate(F.slice("gaps", 1, i), F.col("low").cast("int"), lambda a, g: a + g))
    return rows.withColumn("pitches", F.when(F.col("target") == "NOTE_GROUP", pitches))


def contexts(rows: DataFrame, value: str, length: int) -> DataFrame:
    """For each place of a sequence and its end, the up to ``length`` values before it."""
    end = rows.groupBy("song_id").agg((F.max("ord") + 1).alias("ord"))
    w = Window.partitionBy("song_id").orderBy("ord").rowsBetween(-length, -1)
    return rows.select("song_id", "ord", value).unionByName(end, allowMissingColumns=True).withColumn("context", F.collect_list(value).over(w))


def shifted_pairs(rows: DataFrame, value: str, bos: int, eos: int) -> DataFrame:
    """Input and target of each step: the sequence behind a start mark, and before an end mark."""
    end = rows.groupBy("song_id").agg((F.max("ord") + 1).alias("ord")).withColumn(value, F.lit(eos))
    w = Window.partitionBy("song_id").orderBy("ord")
    return rows.select("song_id", "ord", F.col(value).cast("bigint").alias(value)).unionByName(end.select("song_id", "ord", F.col(value).cast("bigint").alias(value))).select("song_id", "ord", F.lag(value, 1, bos).over(w).alias("input"), F.col(value).alias("target"))

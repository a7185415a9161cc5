"""Joins: paired differences, interval lookups, relations between the events of a window, negatives and splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import BEAT, div, floor_distance, signed_exact_log_bucket, signed_time_bucket, unit_distance

SLOT = 192


def paired(rows: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """Per pair of arms: mean and sample deviation of left - right over the seeds that both have, and whether all differ the same way."""
    spark = rows.sparkSession
    pairs = F.broadcast(spark.createDataFrame(comparisons, "left_arm string, right_arm string"))  # as many rows as were asked for
    left = rows.select(F.col("arm").alias("left_arm"), "seed", F.col("bits").alias("a"))
    right = rows.select(F.col("arm").alias("right_arm"), "seed", F.col("bits").alias("b"))
    d = left.join(pairs, "left_arm").join(right, ["right_arm", "seed"]).withColumn("d", F.col("a") - F.col("b"))
    same = F.bool_and(F.col("d") > 0) | F.bool_and(F.col("d") < 0)
    return d.groupBy("left_arm", "right_arm").agg(F.count("*").alias("seeds"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("sd_delta"), same.alias("same_direction"))


def verify_sources(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: paths checked, missing and with another digest; ``manifest`` and ``files`` have path and sha256."""
    both = manifest.join(files.withColumnRenamed("sha256", "found"), "path", "left")
    return both.agg(F.count("*").alias("checked"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("found") != F.col("sha256")).alias("mismatched"))


def chord_slots(bounds: DataFrame, chords: DataFrame, bucket: int = 3072) -> DataFrame:
    """Two slots a bar, each with the chord that sounds at its middle, else N.

    ``bounds``: song_id, bar, start, stop.  ``chords``: song_id, start, stop, root, quality, not overlapping.  Both meet
    on buckets of time, so no bar is compared with all chords of a song.
    """
    slots = bounds.select("song_id", "bar", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), F.col("start").alias("s"), F.col("stop").alias("e"))
    middle = F.col("s") + (F.col("e") - F.col("s")) * (F.lit(0.25) + F.lit(0.5) * F.col("half"))
    slots = slots.withColumn("middle", middle).withColumn("b", F.floor(F.col("middle") / bucket).cast("bigint"))
    # the last place of a chord is just before its stop
    spread = chords.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("bigint"), F.ceil(F.col("stop") / bucket).cast("bigint"))))
    c = spread.select("song_id", "b", F.col("start").alias("cs"), F.col("stop").alias("ce"), "root", "quality")
    inside = (F.col("cs") <= F.col("middle")) & (F.col("middle") < F.col("ce"))
    hit = slots.join(c, ["song_id", "b"]).where(inside).select("song_id", "bar", "half", "root", "quality")
    out = slots.select("song_id", "bar", "half").join(hit, ["song_id", "bar", "half"], "left")
    return out.select("song_id", "bar", "half", F.coalesce("root", F.lit(12)).alias("root"), F.coalesce("quality", F.lit("N")).alias("quality"))


def current_slot(targets: DataFrame, slots: DataFrame) -> DataFrame:
    """The slot (song_id, anchor at multiples of half a bar) that holds each target's onset; more than one, or none, is an error."""
    t = targets.withColumn("_slot", div(F.col("onset"), SLOT))
    s = slots.withColumn("_slot", div(F.col("anchor"), SLOT)).groupBy("song_id", "_slot").agg(F.count("*").alias("_n"), F.any_value("root").alias("root"))
    joined = t.join(s, ["song_id", "_slot"], "left")
    one = F.when(F.col("_n") == 1, F.col("root")).otherwise(F.raise_error(F.lit("no single slot holds the target")).cast("int"))
    return joined.withColumn("root", one).drop("_n", "_slot")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the dimension's value; a key that it lacks is an error."""
    found = rows.join(dimension.select(key, value, F.lit(True).alias("_there")), key, "left")
    there = F.when(F.col("_there"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast(dimension.schema[value].dataType))
    return found.withColumn(value, there).drop("_there")


def pairs(windows: DataFrame, causal: bool = False) -> DataFrame:
    """All ordered pairs (l_, r_) of the events of one window, never of two.  Windows have at most 2,048 events."""
    keys = ["song_id", "start_bar"]
    order = Window.partitionBy(*keys).orderBy("rel_onset", "pitch", "duration")
    rows = windows.select(*keys, "rel_onset", "pitch", "duration").withColumn("i", F.row_number().over(order))
    left = rows.select(*keys, *(F.col(c).alias(f"l_{c}") for c in ("i", "rel_onset", "pitch", "duration")))
    right = rows.select(*keys, *(F.col(c).alias(f"r_{c}") for c in ("i", "rel_onset", "pitch", "duration")))
    both = left.join(right, keys)
    return both.where("l_i >= r_i") if causal else both


#: Edges of the binary logarithm of duration ratios.
RATIO_EDGES = (-3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0)


def relation_ids() -> dict[str, Column]:
    """Small enumerations of a pair of events: pitch step, time bucket, same onset, duration ratio, overlap, meter."""
    lo, ro = F.col("l_rel_onset"), F.col("r_rel_onset")
    le, re_ = lo + F.col("l_duration"), ro + F.col("r_duration")
    step = F.col("r_pitch") - F.col("l_pitch")
    pitch = F.when(step < -24, 0).when(step > 24, 50).otherwise(step + 25)
    ratio = F.log2(F.greatest(F.col("r_duration"), F.lit(1)) / F.greatest(F.col("l_duration"), F.lit(1)))
    ratios = F.size(F.filter(F.array(*map(F.lit, RATIO_EDGES)), lambda e: e < ratio))
    # the strongest statement first
    overlap = (
        F.when(lo > re_, 7).when(lo == re_, 6).when((lo == ro) & (le == re_), 5).when((ro <= lo) & (re_ >= le), 4)
        .when((lo <= ro) & (le >= re_), 3).when(F.greatest(lo, ro) < F.least(le, re_), 2).when(le == ro, 1).otherwise(0)
    )

    def same(a: Column, b: Column) -> Column:
        return F.when(a == b, 1).otherwise(0)

    def mod(x: Column, n: int) -> Column:
        return F.pmod(x, F.lit(n))

    meter = same(mod(lo, BEAT), mod(ro, BEAT)) + 2 * same(mod(div(lo, BEAT), 4), mod(div(ro, BEAT), 4)) + 4 * same(mod(lo, 4 * BEAT), mod(ro, 4 * BEAT))
    named = {"delta_pitch": pitch, "delta_time": signed_time_bucket(ro - lo), "same_onset": same(lo, ro), "duration_ratio": ratios, "overlap": overlap, "metrical": meter}
    return {n: c.cast("bigint") for n, c in named.items()}


def time_features(delta: Column) -> dict[str, Column]:
    """Pairwise distances in three units, floored or toward zero, in buckets, and the place in the bar."""
    out = {f"floor_{u}": floor_distance(delta, u) for u in (1, 96, 384)} | {f"unit_{u}": signed_exact_log_bucket(unit_distance(delta, u)) for u in (1, 96, 384)}
    return out | {"meter": F.pmod(delta, F.lit(384))}


def consistency(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The share of equal values of two sets of relations."""
    both = left.join(right.select(*keys, *(F.col(v).alias(f"{v}_2") for v in values)), keys)
    return both.agg(*(F.avg((F.col(v) == F.col(f"{v}_2")).cast("double")).alias(v) for v in values))


def same_song_negatives(windows: DataFrame, apart: int = 8, seed: int = 0) -> DataFrame:
    """For each window (song_id, start_bar) one other of its song at least ``apart`` bars away, else any other; drawn by a digest."""
    other = windows.select("song_id", F.col("start_bar").alias("other"))
    both = windows.join(other, "song_id").where("start_bar <> other")
    far = F.when(F.abs(F.col("start_bar") - F.col("other")) >= apart, 0).otherwise(1)
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "song_id", "start_bar", "other"), 256)
    return both.groupBy("song_id", "start_bar").agg(F.min_by("other", F.struct(far.alias("far"), key.alias("k"))).alias("negative"))


def _drawn(n: Column, *fields: Column) -> Column:
    """A number below ``n`` by the first 60 bits of a digest over the fields, joined by bars."""
    digest = F.sha2(F.concat_ws("|", *(f.cast("string") for f in fields)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), n)


def donor_triples(windows: DataFrame, apart: int = 8, seed: int = 0) -> DataFrame:
    """song_id, start_bar, melody_bar, context_bar: for each window with a melody two donors of its song, ``apart`` bars away at least.

    ``windows``: song_id, start_bar (once a song), melody (whether the window has one).  The melody's donor has a melody;
    the context's donor is another window, or the same one where there is no other.  Windows without a donor are left out.
    Donors are drawn by their rank in the song, so no pairs of windows are made.
    """
    by = Window.partitionBy("song_id").orderBy("start_bar")
    song, before, after = Window.partitionBy("song_id"), by.rangeBetween(Window.unboundedPreceding, -apart), by.rangeBetween(apart, Window.unboundedFollowing)
    one, sings = F.count("*"), F.count_if("melody")
    rows = windows.select(
        "song_id", "start_bar", "melody", (F.row_number().over(by) - 1).cast("bigint").alias("rank"), (sings.over(by) - 1).alias("turn"),
        *(f.over(w).alias(name) for f, names in ((one, "nlr"), (sings, "mxy")) for w, name in zip((song, before, after), names)),
    )

    def place(k: Column, of: Column, left: Column, right: Column) -> Column:
        """The rank of the ``k``-th of the windows that are far enough away, which lie at both ends of the song."""
        return F.when(k < left, k).otherwise(of - right + k - left)

    n, left, right, of, x, y = (F.col(c) for c in "nlrmxy")
    key = [F.col("song_id"), F.col("start_bar")]
    source = rows.where(F.col("melody") & (x + y > 0)).withColumn("turn", place(_drawn(x + y, F.lit(seed), F.lit("melody"), *key), of, x, y))
    donors = rows.where("melody").select("song_id", "turn", F.col("start_bar").alias("melody_bar"), F.col("rank").alias("taken"))
    source = source.drop("rank").join(donors, ["song_id", "turn"])
    at = F.when(F.col("taken") < left, F.col("taken")).otherwise(F.col("taken") - (n - right) + left)
    k = _drawn(F.greatest(left + right - 1, F.lit(1)), F.lit(seed), F.lit("context"), *key)
    k = F.when(left + right == 1, F.lit(0)).otherwise(k + (k >= at).cast("bigint"))
    contexts = rows.select("song_id", "rank", F.col("start_bar").alias("context_bar"))
    return source.withColumn("rank", place(k, n, left, right)).join(contexts, ["song_id", "rank"]).select("song_id", "start_bar", "melody_bar", "context_bar")


def cross_song_negatives(windows: DataFrame) -> DataFrame:
    """For each window the first one of the next song, and for the last song that of the first: songs are ranked once, so no pairs are made."""
    from .batches import ranked

    songs = ranked(windows.groupBy("song_id").agg(F.min("start_bar").alias("negative_bar")), "song_id", name="i")
    n = songs.count()
    nxt = songs.select(F.pmod(F.col("i") - 1, F.lit(max(n, 1))).alias("i"), F.col("song_id").alias("negative_song"), "negative_bar")
    return windows.join(songs.select("song_id", "i"), "song_id").join(nxt, "i").drop("i").where("song_id <> negative_song")


def rotated_partner(rows: DataFrame, shift: int) -> DataFrame:
    """Rows (i, song_id) with the song ``shift`` places on, in a circle, and whether all partners are of other songs."""
    n = rows.count()
    other = rows.select(F.pmod(F.col("i") - shift, F.lit(n)).alias("i"), F.col("song_id").alias("partner"))
    return rows.join(other, "i")


def rotation_for(rows: DataFrame) -> int | None:
    """The least shift from a third of the rows on at which all partners are of other songs."""
    n = rows.count()
    for shift in range(max(1, n // 3), n):
        if rotated_partner(rows, shift).where("song_id = partner").isEmpty():
            return shift
    return None


def first_donors(rows: DataFrame) -> DataFrame | None:
    """Where no rotation serves: rows (i, song_id) with ``donor``, the first row of another song; None if there is one song only."""
    first = rows.orderBy("i").first()
    other = first and rows.where(F.col("song_id") != first["song_id"]).agg(F.min("i")).first()[0]
    if other is None:
        return None
    return rows.withColumn("donor", F.when(F.col("song_id") == first["song_id"], F.lit(other)).otherwise(F.lit(first["i"])))


def spliced(source: Column, donor: Column, first: int, stop: int) -> Column:
    """The source with places [first, stop) from the donor."""
    return F.concat(F.slice(source, 1, first), F.slice(donor, first + 1, stop - first), F.slice(source, F.lit(stop + 1), F.greatest(F.size(source) - stop, F.lit(0))))


#: Bytes of an index that is sent to the vectors; a larger one meets them by a shuffle.
INDEX_BYTES = 32 << 20


def latent_windows(latents: DataFrame, index: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """The index's rows (key, start, ...) with ``slice``: ``width`` places of the key's array from ``start`` on.

    The index is gathered by key into lists of its rows, so an array is joined once, whatever the number of its windows,
    and isn't cut up; where the counted index fits, it goes to the arrays, which then aren't shuffled.  A window that
    leaves its array is an error.
    """
    rest = [c for c in index.columns if c != key]
    lists = index.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("_windows"))
    fits = index.count() * 16 * len(index.columns) <= INDEX_BYTES
    both = latents.select(key, values).join(F.broadcast(lists) if fits else lists, key)
    rows = both.select(key, values, F.explode("_windows").alias("w"))
    start = F.col("w.start")
    inside = (start >= 0) & (start + width <= F.size(values))
    part = F.when(inside, F.slice(values, start + 1, F.lit(width))).otherwise(F.raise_error(F.lit("a window leaves its array")).cast(latents.schema[values].dataType))
    return rows.select(key, *(F.col(f"w.{c}").alias(c) for c in rest), part.alias("slice"))

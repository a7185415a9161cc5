"""Content hashes of songs, duplicate families, split assignment and leakage audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import json_text, list_text, ordered_text, reduced_fraction, seeded_key
from .batches import balanced_order, ranked
from .durable import checkpointed
from .events import canonical, in_order


def event_hashes(facts: DataFrame) -> DataFrame:
    """song_id and three digests of the ordered events as compact JSON: as they are, relative to the first pitch, and by steps and intervals."""
    w = Window.partitionBy("song_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = canonical(facts)
    origin = F.first("pitch", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("pitch", ignorenulls=True).over(before)
    rows = rows.select("*", origin.alias("origin"), last.alias("last"), (F.col("onset") - F.lag("onset", 1, 0).over(w)).alias("step"))
    interval = F.when(F.col("pitch").isNotNull(), F.coalesce(F.col("pitch") - F.col("last"), F.lit(0)))
    exact = json_text(("event_type", F.col("event_type"), True), ("onset_ticks", F.col("onset"), False), ("duration_ticks", F.col("duration"), False), ("pitch", F.col("pitch"), False))
    moved = list_text((F.col("event_type"), True), (F.col("onset"), False), (F.col("pitch") - F.col("origin"), False), (F.col("duration"), False))
    rhythm = list_text((F.col("event_type"), True), (F.col("step"), False), (interval, False), (F.col("duration"), False))

    def digest(text: Column) -> Column:
        return F.sha2(F.concat(F.lit("["), ordered_text(F.col("ord"), text), F.lit("]")), 256)

    return rows.groupBy("song_id").agg(digest(exact).alias("exact"), digest(moved).alias("transposed"), digest(rhythm).alias("rhythm"))


def line_hashes(facts: DataFrame, version: str = "v1", per_beat: int = 96) -> DataFrame:
    """song_id and three digests of notes as lines: leading silence left out, times as reduced fractions of a beat.

    The transposed form counts pitches from the lowest at the first onset; the rhythm form has a line for each onset
    with the motion of its lowest and highest pitch and the pitch classes above the lowest.
    """
    # all steps are within a song, so its notes are dealt once, and one sort serves both windows
    notes = facts.where("event_type = 'NOTE' and song_id is not null").select("song_id", "onset", "pitch", "duration").repartition("song_id")
    chord = Window.partitionBy("song_id", "onset").orderBy("pitch", "duration")
    song = Window.partitionBy("song_id").orderBy("onset", "pitch", "duration")
    of_chord, of_song = (w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for w in (chord, song))
    notes = notes.select("*", F.count("*").over(of_chord).alias("n"), F.first("pitch").over(of_chord).alias("low"), F.last("pitch").over(of_chord).alias("high"))
    known = F.when(F.col("onset").isNotNull() & F.col("pitch").isNotNull(), F.struct("onset", "pitch"))
    # the note before is of the same chord if its onset is equal, else of the chord before
    before = [F.lag(c).over(song).alias(f"p{c}") for c in ("onset", "low", "high")]
    notes = notes.select("*", F.row_number().over(song).alias("i"), F.min("onset").over(of_song).alias("start"), F.first(known, ignorenulls=True).over(of_song).alias("known"), *before)
    base = F.when(F.col("known.onset") == F.col("start"), F.col("known.pitch"))
    notes = notes.select("*", base.alias("base"), reduced_fraction(F.col("onset") - F.col("start"), per_beat).alias("at"), reduced_fraction(F.col("duration"), per_beat).alias("d"))

    def motion(a: str, b: str) -> Column:
        return F.coalesce(F.pmod(F.col(a) - F.col(b), F.lit(12)).cast("string"), F.lit("START"))

    def flat(pitch: Column) -> Column:
        return F.concat_ws("|", F.lit("NOTE"), "at", pitch.cast("string"), "d")

    step = F.col("onset") - F.coalesce("ponset", "onset")
    head = F.concat(F.lit("ONSET|"), reduced_fraction(step, per_beat), F.lit("|N="), F.col("n").cast("string"), F.lit("|B="), motion("low", "plow"), F.lit("|T="), motion("high", "phigh"), F.lit("|"))
    opening = F.when(F.col("i") == 1, head).when(F.col("onset").eqNullSafe(F.col("ponset")), ",").otherwise(F.concat(F.lit("\n"), head))
    rhythm = F.concat(opening, F.concat_ws(":", F.pmod(F.col("pitch") - F.col("low"), F.lit(12)).cast("string"), "d"))
    rows = notes.select("song_id", F.struct("i", flat(F.col("pitch")).alias("exact"), flat(F.col("pitch") - F.col("base")).alias("transposed"), rhythm.alias("rhythm")).alias("x"))
    songs = rows.groupBy("song_id").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def lines(kind: str, form: str, between: str = "\n") -> Column:
        return F.sha2(F.concat_ws("\n", F.lit(version), F.lit(f"kind={kind}"), F.array_join(F.col(f"x.{form}"), between), F.lit("")), 256).alias(form)

    return songs.select("song_id", lines("exact", "exact"), lines("transposition_invariant", "transposed"), lines("rhythm_interval", "rhythm", ""))


def note_content_hash(facts: DataFrame) -> DataFrame:
    """Digest of the notes as a compact JSON list of [onset, pitch, duration]."""
    order = F.struct("onset", "pitch", "duration")
    text = list_text((F.col("onset"), False), (F.col("pitch"), False), (F.col("duration"), False))
    body = F.concat(F.lit("["), ordered_text(order, text), F.lit("]"))
    return facts.where("event_type = 'NOTE'").groupBy("song_id").agg(F.sha2(body, 256).alias("content"))


def _classes(members: DataFrame, relations: list[str], key: str, *more: Column) -> DataFrame:
    """The relations' values, rep (the smallest key that has them) and ``more`` for each class of samples that agree in all relations."""
    some = reduce(Column.__or__, (F.col(r).isNotNull() for r in relations))
    return checkpointed(members.where(some).groupBy(*relations).agg(F.min(key).alias("rep"), *more))


def _rooted(classes: DataFrame, relations: list[str]) -> DataFrame:
    """Adds root to classes: the smallest key of all classes that are connected by shared values."""
    links = reduce(DataFrame.unionByName, (classes.select(F.col("rep").alias("node"), F.struct(F.lit(r).alias("r"), F.col(r).alias("v")).alias("value")).where(F.col(r).isNotNull()) for r in relations))
    shared = links.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    links = checkpointed(links.join(shared, "value", "left_semi"))
    labels = checkpointed(links.select("node").distinct().withColumn("label", F.col("node")))
    labels = labels if links.isEmpty() else _least_labels(links, labels)
    return classes.join(labels, classes["rep"] == labels["node"], "left").select(*classes.columns, F.coalesce("label", "rep").alias("root"))


def components(members: DataFrame, relations: list[str], key: str = "song_id") -> DataFrame:
    """key, root (the smallest key that is connected): samples that share the value of any relation are connected.

    Samples that agree in all relations are one class, which the smallest of them stands for.  Labels pass from classes
    to values and back until none changes, so a value's samples are never paired; only classes that share a value take part.
    """
    rooted = _rooted(_classes(members, relations, key), relations).select(*(F.col(r).alias(f"_{r}") for r in relations), F.col("root").alias("_root"))
    same = reduce(Column.__and__, (F.col(r).eqNullSafe(F.col(f"_{r}")) for r in relations))
    return members.select(key, *relations).join(rooted, same, "left").select(key, F.coalesce("_root", key).alias("root"))


def _least_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable over values."""
    while True:
        least = links.join(labels, "node").groupBy("value").agg(F.min("label").alias("l"))
        better = links.join(least, "value").groupBy("node").agg(F.min("l").alias("l"))
        moved = checkpointed(labels.join(better, "node", "left").select("node", F.least("label", F.coalesce("l", "label")).alias("label"), "label"
        ).toDF("node", "label", "was"))
        # follow the label's own label: halves the length of chains
        roots = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = checkpointed(moved.join(roots, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        if jumped.where("label <> was").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.drop("was")


def families(members: DataFrame, relations: list[str], prefix: str = "family_", key: str = "song_id", roots: DataFrame | None = None) -> DataFrame:
    """Per component (``roots`` where they are known): root, lineage_id (a digest of its sorted keys), sample_count, merged relations."""
    held = [F.count("*").alias("n"), F.collect_list(F.col(key).cast("string")).alias("ids")]
    if roots is None:
        members = members.where(F.col(key).isNotNull())
        classes = _rooted(_classes(members, relations, key, *held), relations).drop("rep")
        none = reduce(Column.__and__, (F.col(r).isNull() for r in relations))
        classes = classes.unionByName(members.where(none).groupBy(F.col(key).alias("root"), *relations).agg(*held))
    else:
        classes = members.join(roots, key).groupBy("root", *relations).agg(*held)
    # values are counted once for each class, so lists of keys aren't carried along with every distinct count
    kinds = classes.groupBy("root").agg(*(F.count_distinct(r).alias(f"_{r}") for r in relations))
    name = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.array_join(F.sort_array(F.flatten("ids")), "\n"), F.lit("\n")), 256), 1, 24))
    found = classes.groupBy("root").agg(F.collect_list("ids").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count")).join(kinds, "root")
    reasons = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{r}") < F.col("sample_count"), F.lit(r)) for r in relations))), ",")
    return found.select("root", name.alias("lineage_id"), "sample_count", reasons.alias("reasons"))


def duplicate_members(rows: DataFrame, value: str, key: str = "song_id") -> DataFrame:
    """Samples whose value others share, with the group's size; counted per value and joined, as a window would hold a group in one task."""
    sizes = rows.groupBy(value).agg(F.count("*").alias("group_size")).where("group_size > 1")
    return rows.join(sizes, value).select(key, value, "group_size")


def _seen(rows: DataFrame, fields: list[str], split: str) -> DataFrame:
    """field, value, splits: the splits that each value is in; nulls don't count."""
    long = rows.select(split, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))).where("value is not null")
    return long.groupBy("field", "value").agg(F.collect_set(split).alias("splits"))


def _crossings(seen: DataFrame) -> DataFrame:
    return seen.groupBy("field").agg(F.count("*").alias("groups"), F.count_if(F.size("splits") > 1).alias("crossing"))


def crossings(rows: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """field, groups, crossing: how many values of each field there are, and how many are in more than one split; nulls don't count."""
    return _crossings(_seen(rows, fields, split))


def crossing_report(rows: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """Summary rows (PASS or FAIL) of each relation, and a row for each value that crosses; both read one shuffle."""
    seen = _seen(rows, fields, split)
    found = _crossings(seen)
    summary = found.select(F.col("field").alias("relation"), F.lit("__SUMMARY__").alias("key"), F.when(F.col("crossing") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat_ws(";", F.concat(F.lit("groups="), F.col("groups")), F.concat(F.lit("cross_split_groups="), F.col("crossing"))).alias("details"))
    bad = seen.where(F.size("splits") > 1)
    return summary.unionByName(bad.select(F.col("field").alias("relation"), F.col("value").alias("key"), F.lit("FAIL").alias("status"), F.array_join(F.array_sort("splits"), ",").alias("details")))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one, per range of the order and shifted by the ranges before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in dealt.groupBy("_part").agg(F.sum(value)).collect()}  # one row for each partition
    shift, total = F.lit(0), 0
    for part in sorted(sums):
        shift = F.when(F.col("_part") == part, total).otherwise(shift)
        total += sums[part]
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, F.sum(value).over(w) + shift).drop("_part")


def take_if_fits(components_: DataFrame, target: int, seed: int, purpose: str) -> DataFrame:
    """Components (id, n, density) taken in balanced order while they fit, then the one that comes closest to what is left.

    What fits is found in runs: all that come before the first that doesn't fit are taken at once; that one, and all
    larger ones after it, are out for good, so there are no more rounds than different sizes.
    """
    order = checkpointed(balanced_order(components_, seed, purpose).select("id", "n", "place"))
    left, rest, taken = target, order, []
    while left > 0:
        sums = running_total(rest.where(F.col("n") <= left), "place", "n", "upto")
        sums = checkpointed(sums)
        stop = sums.where(F.col("upto") > left).agg(F.min("place")).first()[0]
        run = sums if stop is None else sums.where(F.col("place") < stop)
        got = run.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        taken.append(run.select("id"))
        left -= got
        if stop is None:
            break
        rest = sums.where(F.col("place") > stop).drop("upto")
    chosen = reduce(DataFrame.unionByName, taken) if taken else order.select("id").limit(0)
    if left > 0:
        spare = order.join(chosen, "id", "left_anti").withColumn("gap", F.abs(F.col("n") - left))
        best = spare.orderBy("gap", seeded_key(seed, f"{purpose}:overshoot", F.col("id"))).limit(1).select("id")
        chosen = chosen.unionByName(best)
    return chosen


def assign_splits(components_: DataFrame, test: int, validation: int, seed: int) -> DataFrame:
    """id, n, split: test is filled first, validation from what remains."""
    tests = checkpointed(take_if_fits(components_, test, seed, "test"))
    remaining = checkpointed(components_.join(tests, "id", "left_anti"))
    valid = checkpointed(take_if_fits(remaining, validation, seed, "validation"))
    marked = components_.join(tests.withColumn("t", F.lit(1)), "id", "left").join(valid.withColumn("v", F.lit(1)), "id", "left")
    return marked.select("id", "n", F.when(F.col("t") == 1, "test").when(F.col("v") == 1, "validation").otherwise("train").alias("split"))


def moved_samples(rows: DataFrame, old_holdout: int) -> DataFrame:
    """Adds old_split (the last ``old_holdout`` samples by release and id were held out) and moved."""
    total = rows.count()
    out = ranked(rows, "release", "id", name="i").withColumn("old_split", F.when(F.col("i") >= max(0, total - old_holdout), "holdout").otherwise("train")).drop("i")
    old, new = F.col("old_split"), F.col("split")
    return out.withColumn("moved", ((old == "train") & (new != "train")) | ((old == "holdout") & (new == "train")))


def ordered(facts: DataFrame) -> DataFrame:
    return facts.orderBy("song_id", *in_order())


#: Held-out components that :func:`balanced_halves` takes on the driver, one small row each; more are an error.
MOST_HELD = 1_000_000


def balanced_halves(components_: DataFrame, seed: int, swaps: int = 16) -> DataFrame:
    """Held-out components (id, n, events) in validation and test: rows are halved, and events balanced.

    Large ones go first, each to the side with the lower load; then equally large ones change sides as long as that
    brings the events nearer to half.  A change is the pair of a size whose difference in events is nearest to the gap,
    found by bisection among the sorted events of the other side, not by trying all pairs.
    """
    from bisect import bisect_left, insort

    spark = components_.sparkSession
    key = seeded_key(seed, "heldout", F.col("id"))
    rows = components_.orderBy(F.desc("events"), key).limit(MOST_HELD + 1).collect()
    if len(rows) > MOST_HELD:
        raise ValueError("too many held-out components")
    total, events = sum(r["n"] for r in rows), sum(r["events"] for r in rows)
    room = {"validation": total // 2, "test": total - total // 2}
    have, load, side = {"validation": 0, "test": 0}, {"validation": 0, "test": 0}, {}
    for r in rows:
        fits = [s for s in room if have[s] + r["n"] <= room[s]]
        if len(fits) != 1:
            fits = ["test"] if have["validation"] + r["n"] > room["validation"] else fits
        if len(fits) == 2:
            weight = {s: have[s] / max(1, room[s]) + load[s] / max(1.0, events / 2) for s in room}
            fits = ["validation" if weight["validation"] <= weight["test"] else "test"]
        side[r["id"]] = fits[0]
        have[fits[0]] += r["n"]
        load[fits[0]] += r["events"]
    by_size: dict[int, dict[str, list]] = {}
    for r in rows:
        insort(by_size.setdefault(r["n"], {"validation": [], "test": []})[side[r["id"]]], (r["events"], r["id"]))
    for _ in range(swaps):
        gap = load["validation"] - events / 2
        best = None
        for size, sides in by_size.items():
            for v in sides["validation"]:
                at = bisect_left(sides["test"], (v[0] - gap,))
                for t in sides["test"][max(0, at - 1) : at + 1]:
                    error = abs(gap - v[0] + t[0])
                    if error + 1e-9 < abs(gap) and (best is None or error < best[0]):
                        best = error, size, v, t
        if best is None:
            break
        _, size, v, t = best
        for x, a, b in ((v, "validation", "test"), (t, "test", "validation")):
            by_size[size][a].remove(x)
            insort(by_size[size][b], x)
            side[x[1]] = b
        load["validation"] += t[0] - v[0]
    return spark.createDataFrame(list(side.items()) or [], "id string, split string")

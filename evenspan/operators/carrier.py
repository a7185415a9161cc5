"""Reversible token forms of event sequences, as text tokens and as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import json_text, ordered_text
from ..functions.timegrid import BAR, div
from .events import canonical

EVENT = "array<struct<duration_ticks:bigint,event_type:string,onset_ticks:bigint,pitch:int>>"


def to_json(facts: DataFrame) -> DataFrame:
    """song_id, payload: the ordered events as compact JSON with sorted keys, null pitches kept."""
    item = json_text(("event_type", F.col("event_type"), True), ("onset_ticks", F.col("onset"), False), ("duration_ticks", F.col("duration"), False), ("pitch", F.col("pitch"), False))
    body = F.concat(F.lit("["), ordered_text(F.col("ord"), item), F.lit("]"))
    return canonical(facts).groupBy("song_id").agg(body.alias("payload"))


def from_json(payloads: DataFrame) -> DataFrame:
    e = payloads.select("song_id", F.explode(F.from_json("payload", EVENT)).alias("e"))
    return e.select("song_id", F.col("e.event_type").alias("event_type"), F.col("e.onset_ticks").alias("onset"), F.col("e.duration_ticks").alias("duration"), F.col("e.pitch").alias("pitch"))


def serialize(facts: DataFrame) -> DataFrame:
    """song_id, tokens: bars to advance (from bar 0), then position, pitch or REST, and duration for each event."""
    w = Window.partitionBy("song_id").orderBy("ord")
    bar = div(F.col("onset"), BAR)
    rows = canonical(facts).withColumn("bar", bar).withColumn("step", F.col("bar") - F.lag("bar", 1, 0).over(w))
    shown = F.concat(
        F.array_repeat(F.lit("BAR_ADVANCE"), F.col("step").cast("int")),
        F.array(
            F.concat(F.lit("POSITION_"), F.pmod("onset", F.lit(BAR)).cast("string")),
            F.coalesce(F.concat(F.lit("PITCH_"), F.col("pitch").cast("string")), F.lit("REST")),
            F.concat(F.lit("DURATION_BAR_"), div(F.col("duration"), BAR).cast("string")),
            F.concat(F.lit("DURATION_REMAINDER_"), F.pmod("duration", F.lit(BAR)).cast("string")),
        ),
    )
    pieces = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), shown.alias("t"))))
    return rows.groupBy("song_id").agg(F.flatten(F.transform(pieces, lambda x: x["t"])).alias("tokens"))


def deserialize(rows: DataFrame) -> DataFrame:
    """The events again: every four tokens that aren't advances are an event, and its bar is the number of advances before it.  A broken order is an error.

    All of it happens within a song's array: of the n-th such token (from 0) at place i, i - n advances come before it.
    """
    others = F.filter(F.transform("tokens", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda t: (t["x"] != "BAR_ADVANCE") | t["x"].isNull())
    others = F.transform(others, lambda t, n: F.struct((t["i"] - n).cast("bigint").alias("bar"), t["x"].alias("x")))
    fours = F.when(F.size("t") > 0, F.transform(F.sequence(F.lit(0), F.expr("(size(t) - 1) div 4").cast("int")), lambda e: F.struct(*(F.get("t", e * 4 + j).alias(c) for j, c in enumerate("pcbr")))))
    e = rows.select("song_id", others.alias("t")).select("song_id", F.explode(fours).alias("e"))
    e = e.select("song_id", F.col("e.p.bar").alias("bar"), F.col("e.r.bar").alias("last"), *(F.col(f"e.{c}.x").alias(c) for c in "pcbr"))
    sound = (F.col("bar") == F.col("last")) & F.col("p").startswith("POSITION_") & F.col("c").rlike("^(REST|PITCH_[0-9]+)$") & F.col("b").startswith("DURATION_BAR_") & F.col("r").startswith("DURATION_REMAINDER_")

    def number(c: str) -> Column:
        return F.regexp_extract(c, "([0-9]+)$", 1).try_cast("bigint")

    e = e.where(F.when(sound, True).otherwise(F.raise_error(F.lit("malformed tokens")).cast("boolean")))
    return e.select("song_id", F.when(F.col("c") == "REST", "REST").otherwise("NOTE").alias("event_type"), (F.col("bar") * BAR + number("p")).alias("onset"), (number("b") * BAR + number("r")).alias("duration"), number("c").cast("int").alias("pitch"))


#: Where each kind of token starts among the 1,154 numbers.
BAR_ID, REST_ID, POSITION_ID, PITCH_ID, BARS_ID, REMAINDER_ID, SIZE = 0, 1, 2, 386, 514, 770, 1154


def encode_ids(tokens: DataFrame) -> DataFrame:
    """song_id, payload: numbers with bars counted from -1 and a position only where the anchor changes."""
    w = Window.partitionBy("song_id").orderBy("ord")
    rows = tokens.withColumn("bar", div(F.col("anchor"), BAR)).select("*", F.lag("anchor").over(w).alias("pa"))
    rows = rows.withColumn("step", F.col("bar") - F.lag("bar", 1, -1).over(w))
    moved = F.col("pa").isNull() | (F.col("pa") != F.col("anchor"))
    start = F.concat(F.array_repeat(F.lit(BAR_ID).cast("bigint"), F.col("step").cast("int")), F.array(POSITION_ID + F.pmod("anchor", F.lit(BAR))))
    what = F.when(F.col("kind") == 2, PITCH_ID + F.col("pitch")).otherwise(REST_ID).cast("bigint")
    body = F.array(what, BARS_ID + div(F.col("duration"), BAR), REMAINDER_ID + F.pmod("duration", F.lit(BAR)))
    shown = F.concat(F.when(moved, start).otherwise(F.array().cast("array<bigint>")), body)
    pieces = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), shown.alias("t"))))
    return rows.groupBy("song_id").agg(F.flatten(F.transform(pieces, lambda x: x["t"])).alias("payload"))


def decode_ids(payloads: DataFrame) -> DataFrame:
    """Tokens again (song_id, ord, kind, anchor, pitch, duration): running bars, the last position, and events of three numbers."""
    t = payloads.select("song_id", F.posexplode("payload").alias("i", "x"))
    w = Window.partitionBy("song_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col("x")
    position = x.between(POSITION_ID, PITCH_ID - 1)
    t = t.withColumn("bar", F.sum((x == BAR_ID).cast("int")).over(w) - 1).withColumn("pos", F.last(F.when(position, x - POSITION_ID), ignorenulls=True).over(w))
    t = t.where((x != BAR_ID) & ~position).withColumn("k", F.row_number().over(Window.partitionBy("song_id").orderBy("i")) - 1)

    def at(n: int) -> Column:
        return F.max(F.when(F.pmod("k", F.lit(3)) == n, F.col("x")))

    e = t.groupBy("song_id", (div(F.col("k"), 3) + 1).alias("ord")).agg(F.max("bar").alias("bar"), F.max("pos").alias("pos"), at(0).alias("what"), at(1).alias("b"), at(2).alias("r"))
    sound = ((F.col("what") == REST_ID) | F.col("what").between(PITCH_ID, BARS_ID - 1)) & F.col("b").between(BARS_ID, REMAINDER_ID - 1) & F.col("r").between(REMAINDER_ID, SIZE - 1)
    e = e.where(F.when(sound, True).otherwise(F.raise_error(F.lit("malformed payload")).cast("boolean")))
    rest = F.col("what") == REST_ID
    return e.select("song_id", "ord", F.when(rest, 3).otherwise(2).alias("kind"), (F.col("bar") * BAR + F.col("pos")).alias("anchor"), F.when(rest, 0).otherwise(F.col("what") - PITCH_ID).cast("int").alias("pitch"), ((F.col("b") - BARS_ID) * BAR + F.col("r") - REMAINDER_ID).alias("duration"))


def private_text(payload: Column) -> Column:
    """One private-use character for each number."""
    hexed = F.array_join(F.transform(payload, lambda x: F.lpad(F.hex(x + 0xE000), 4, "0")), "")
    return F.decode(F.unhex(hexed), "UTF-16BE")


def private_ids(text: Column) -> Column:
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    return F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint") - 0xE000)


def training_pairs(payload: Column, bos: int = 1, eos: int = 2, offset: int = 3) -> Column:
    """Input behind a start mark and target before an end mark."""
    moved = F.transform(payload, lambda x: x + offset)
    return F.struct(F.concat(F.array(F.lit(bos).cast("bigint")), moved).alias("input"), F.concat(moved, F.array(F.lit(eos).cast("bigint"))).alias("target"))

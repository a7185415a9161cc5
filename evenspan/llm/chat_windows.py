"""Chat formatting in budgeted windows, with SQL functions only.

A conversation's turns are dealt into blocks of :data:`BLOCK` turn numbers, each with its last turns' copies for the next
one and a copy of the system turn, so one shuffle brings together what a window can hold, and a conversation of any
length is many small groups.  Within a block, prefix sums of the turns' tokens choose the windows: a window begins at a
turn, keeps tokens free for the system turn and the history before it, and takes turns up to the last whose sum fits.
A window's text is the system turn, the history (at most ``history`` tokens and :data:`LATEST` turns, whole ones), and
its own turns; the loss mask covers the texts of assistant turns that are its own, so a repeated target counts once.

Template: ``<s>``, then for each turn ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.
Control strings inside texts and roles are broken by a backslash after their first sign, and backslashes are doubled;
``unescaped`` undoes both exactly.

Defined results: null texts and roles are empty.  Turns are in the order of their numbers, null first; at equal numbers
system turns come first, then roles and texts decide, and repeated rows are turns of their own.  The system turn is the
first turn, if its role is ``system``; later ones are turns as others are.  A turn that alone exceeds the budget is a
window of its own without history, whole.  A null conversation id is a conversation.  Blocks of over :data:`CROWD` rows
(many rows of one turn number) have their conversations' turns numbered by rank first.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, ranked, text_or_empty, without
from .spans import bound, sums_before

BEGIN, OPEN, CLOSE = "<s>", "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates.
CONTROLS = ["<s>", "</s>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: What counts as a token: up to five letters, up to three digits, or another sign; and what the template adds to a turn.
TOKEN, TURN_TOKENS = r"[\p{L}\p{M}]{1,5}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]", 4
#: Turn numbers of a block; rows that a block may have; turns that a window may repeat.
BLOCK, CROWD, LATEST = 64, 1024, 8
#: Tokens of a window, and how many of them may be history.
BUDGET, HISTORY = 2048, 512


def escaped(text: Column) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(text, rf"\\|{heads}", r"$0\\")


def unescaped(text: Column) -> Column:
    heads = "".join(sorted({re.escape(c[0]) for c in CONTROLS}))
    return F.regexp_replace(text, rf"([\\{heads}])\\", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def numbered(rows: DataFrame) -> DataFrame:
    """Conversations with crowded blocks get their turns numbered by rank, counted by ranges, so that no block is crowded."""
    crowded = rows.groupBy("c", "z", F.floor(F.col("turn") / BLOCK).alias("b")).count().where(F.col("count") > CROWD).groupBy("c", "z").agg(F.sum("count").alias("w"))
    many = crowded.count()
    if not many:
        return rows
    order = ["c", "z", "turn", "later", "head", "body", "tie"]
    again = ranked(hot_join(rows, crowded, ["c", "z"], "left_semi", many, 24, "w").withColumn("tie", F.monotonically_increasing_id()), order, "rank")[0]
    return without(rows, crowded, ["c", "z"], many, 24, "w").unionByName(again.withColumn("turn", F.col("rank")).select(*rows.columns))


def blocks(conversations: DataFrame) -> DataFrame:
    """c, z (the id, and whether it is null), b, all: the block's rows in order, the system turn's copy (k = 0) first."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.select(
        F.coalesce("conv_id", F.lit(0).cast("long")).alias("c"), F.col("conv_id").isNull().alias("z"), F.col("turn").cast("long").alias("turn"), (role != "system").alias("later"),
        F.concat(F.lit(OPEN), escaped(role), F.lit("\n")).alias("head"), escaped(text).alias("body"), (TURN_TOKENS + tokens(role) + tokens(text)).cast("long").alias("n"), (role == "assistant").alias("target"),
    )
    rows = numbered(rows)
    place = F.floor(F.col("turn") / BLOCK).alias("b")
    at = rows.groupBy("c", "z", place).agg(F.min("turn").alias("low"))  # the blocks that there are, without texts
    lowest = at.groupBy("c", "z").agg(F.min(F.struct("b", "low")).alias("m")).select("c", "z", F.col("m.b").alias("mb"), F.col("m.low").alias("mt"))
    first = rows.where(~F.col("later")).join(lowest, ["c", "z"]).where(F.col("turn").eqNullSafe(F.col("mt")))
    first = first.groupBy("c", "z").agg(F.min_by(F.struct("turn", "head", "body", "n", "mb"), "body").alias("x"))
    system = at.join(first, ["c", "z"]).select("c", "z", "b", F.lit(0).alias("k"), "x.turn", F.lit(False).alias("later"), "x.head", "x.body", "x.n", F.lit(False).alias("target"), F.col("b").eqNullSafe(F.col("x.mb")).alias("home"))
    copies = F.when(F.col("turn") % BLOCK >= BLOCK - LATEST, F.array(place, place + 1)).otherwise(F.array(place))
    turns = rows.select("c", "z", F.explode(copies).alias("b"), F.lit(1).alias("k"), "turn", "later", "head", "body", "n", "target", F.lit(False).alias("home"))
    item = F.struct("k", "turn", "later", "head", "body", "n", "target", "home")
    return turns.unionByName(system).groupBy("c", "z", "b").agg(F.sort_array(F.collect_list(item)).alias("all"))


def cut(x: Column, low: Column, budget: int, history: int) -> Column:
    """The windows of a block, as arrays of (head, body, n, loss, again); ``x`` holds its turns and those before, in order."""
    system, turns, sums = x["system"], x["turns"], x["sums"]
    kept, size = F.coalesce(F.get(system, 0)["n"], F.lit(0)), F.size(turns)
    home = F.coalesce(F.get(system, 0)["home"], F.lit(False))

    def reserved(i: Column) -> Column:
        """Tokens that a window beginning at turn i keeps for history."""
        return F.greatest(F.lit(0), F.least(F.lit(history), budget - kept - F.get(turns, i)["n"], F.get(sums, i)))

    def taken(acc: Column, i: Column) -> Column:
        at, n = F.get(sums, i), F.get(turns, i)["n"]
        fits = (F.size(acc["starts"]) > 0) & (at + n - acc["at"] <= acc["room"])
        begun = F.struct(F.concat(acc["starts"], F.array(i)).alias("starts"), at.alias("at"), F.greatest(budget - kept - reserved(i), n).alias("room"))
        return F.when(fits, acc).otherwise(begun)

    none = F.array().cast("array<int>")
    old = F.size(F.filter(turns, lambda t: F.coalesce(t["turn"] < low, F.lit(False))))
    nothing = F.struct(none.alias("starts"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("room"))
    own = F.when(old < size, F.sequence(old, size - 1)).otherwise(none)
    starts = F.aggregate(own, nothing, taken, lambda acc: F.when((F.size(acc["starts"]) == 0) & home, F.array(size)).otherwise(acc["starts"]))  # else the system turn alone

    def part(t: Column, loss: Column, again: Column) -> Column:
        return F.struct(t["turn"].alias("turn"), t["head"].alias("head"), t["body"].alias("body"), t["n"].alias("n"), loss.alias("loss"), again.alias("again"))

    def window(starts: Column, i: Column, w: Column) -> Column:
        before = F.size(F.filter(F.when(i > 0, F.sequence(F.lit(0), i - 1)).otherwise(none), lambda k: (k >= i - LATEST) & (F.get(sums, k) >= F.get(sums, i) - reserved(i))))
        end = F.coalesce(F.get(starts, w + 1), size)
        return F.concat(
            F.transform(system, lambda t: part(t, F.lit(False), ~(home & (w == 0)))),
            F.transform(F.slice(turns, i - before + 1, before), lambda t: part(t, F.lit(False), F.lit(True))),
            F.transform(F.slice(turns, i + 1, end - i), lambda t: part(t, t["target"], F.lit(False))),
        )

    return bound(starts, lambda s: F.transform(s, lambda i, w: window(s, i, w)))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, block, window, text, n_tokens, spans: (start, text_start, text_end, loss, again) for each turn of the text, in code points."""

    def without_system(system: Column, turns: Column) -> Column:
        """The system turn's row itself is one of the turns of its block."""
        s = F.get(system, 0)
        same = F.transform(turns, lambda t: F.coalesce(t["turn"].eqNullSafe(s["turn"]) & (t["head"] == s["head"]) & (t["body"] == s["body"]), F.lit(False)))
        return bound(F.array_position(same, True), lambda at: F.filter(turns, lambda _, i: i + 1 != at))

    def with_sums(y: Column) -> Column:
        sums = F.when(F.size(y["turns"]) > 0, sums_before(F.transform(y["turns"], lambda t: t["n"].cast("int")))).otherwise(F.array().cast("array<int>"))
        return F.struct(y["system"].alias("system"), y["turns"].alias("turns"), F.transform(sums, lambda s: s.cast("long")).alias("sums"))

    parts = F.filter("all", lambda t: t["k"] == 1)
    both = bound(F.filter("all", lambda t: t["k"] == 0), lambda s: bound(parts, lambda p: F.struct(s.alias("system"), without_system(s, p).alias("turns"))))
    found = bound(bound(both, with_sums), lambda x: cut(x, F.col("b") * BLOCK, budget, history))

    def placed(p: Column) -> Column:
        starts = sums_before(F.transform(p, lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)))

        def span(t: Column, s: Column) -> Column:
            start = s + len(BEGIN)
            text = start + F.length(t["head"])
            return F.struct(start.alias("start"), text.alias("text_start"), (text + F.length(t["body"])).alias("text_end"), t["loss"].alias("loss"), t["again"].alias("again"))

        return F.zip_with(p, starts, span)

    each = blocks(conversations).select("c", "z", "b", F.posexplode(found).alias("window", "parts"))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""))
    return each.select(
        F.when(~F.col("z"), F.col("c")).alias("conv_id"), F.col("b").alias("block"), "window", text.alias("text"), F.aggregate("parts", F.lit(0).cast("long"), lambda acc, t: acc + t["n"]).alias("n_tokens"), bound(F.col("parts"), placed).alias("spans"),
    )


def turns_of(text: Column, spans: Column) -> Column:
    """The turns that a window's text holds for the first time, read from the text: (role, text, loss)."""

    def turn(s: Column) -> Column:
        head = F.substring(text, s["start"] + 1 + len(OPEN), s["text_start"] - s["start"] - len(OPEN) - 1)
        body = F.substring(text, s["text_start"] + 1, s["text_end"] - s["text_start"])
        return F.struct(unescaped(head).alias("role"), unescaped(body).alias("text"), s["loss"].alias("loss"))

    return F.transform(F.filter(spans, lambda s: ~s["again"]), turn)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query, of the windows' texts.  A digest takes its conversation's text in one row, as it is defined over all of it."""
    turns = found.select("conv_id", "block", "window", F.length("text").cast("long").alias("chars"), turns_of(F.col("text"), F.col("spans")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    rows = turns.select("conv_id", F.struct("block", "window", said.alias("said"), loss.alias("loss")).alias("x"), F.size("turns").cast("long").alias("n"), "chars")
    one = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("x")).alias("x"), F.sum("chars").alias("formatted_chars"))
    one = one.select("conv_id", "n_turns", F.array_join("x.said", "").alias("said"), F.array_join("x.loss", "").alias("loss"), "formatted_chars")
    return one.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

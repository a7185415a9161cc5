"""Count-based code lengths: literal models and an interpolated bigram scorer, as tables and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, ESCAPE = "<s>", "<esc>"


def literal_bits(counts: DataFrame, value: str = "value", n: str = "n", alpha: float = 0.25, floor: int = 2) -> DataFrame:
    """value, bits of each counted value under a smoothed model whose vocabulary has one place for what isn't counted."""
    total, distinct = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first()
    return counts.select(value, (-F.log2((F.col(n) + alpha) / (total + alpha * max(floor, distinct + 1)))).alias("bits"))


def unseen_bits(total: Column, distinct: Column, value: Column, alpha: float = 0.25, floor: int = 2) -> Column:
    """Bits of an integer that wasn't counted: its share of the smoothing, and the length of the number."""
    p = alpha / (total + alpha * F.greatest(F.lit(floor), distinct + 1))
    return -F.log2(p) + 2 * F.log2(F.abs(value) + 2) + 1


def bigrams(rows: DataFrame, symbol: str = "symbol", order: str = "ord") -> DataFrame:
    """Adds the previous symbol of the sequence, a start mark at first."""
    return rows.withColumn("previous", F.lag(symbol, 1, START).over(Window.partitionBy("song_id").orderBy(order)))


class Scorer:
    """Interpolates bigram and unigram frequencies; symbols outside the vocabulary are an escape and their literal bits."""

    def __init__(self, training: DataFrame, alpha: float = 0.25, weight: float = 0.75) -> None:
        self.alpha, self.weight = alpha, weight
        rows = bigrams(training)
        self.unigrams = rows.groupBy("symbol").agg(F.count("*").alias("n1"))
        self.pairs = rows.groupBy("previous", "symbol").agg(F.count("*").alias("n2"))
        self.contexts = rows.groupBy("previous").agg(F.count("*").alias("nc"))
        self.total, self.vocabulary = self.unigrams.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.count("*") + 1).first()

    def score(self, rows: DataFrame, literal: Column | None = None) -> DataFrame:
        """Rows with target, known and bits."""
        known = self.unigrams.select("symbol", F.lit(True).alias("known"))
        seen = rows.join(known, "symbol", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        seen = seen.withColumn("target", F.when(F.col("known"), F.col("symbol")).otherwise(ESCAPE))
        seen = seen.withColumn("previous", F.lag("target", 1, START).over(Window.partitionBy("song_id").orderBy("ord")))
        seen = seen.join(self.unigrams.withColumnRenamed("symbol", "target"), "target", "left")
        seen = seen.join(self.pairs.withColumnRenamed("symbol", "target"), ["previous", "target"], "left").join(self.contexts, "previous", "left")

        def smoothed(n: str, total: Column) -> Column:
            return (F.coalesce(n, F.lit(0)) + self.alpha) / (total + self.alpha * self.vocabulary)

        p = self.weight * smoothed("n2", F.coalesce("nc", F.lit(0))) + (1 - self.weight) * smoothed("n1", F.lit(self.total))
        extra = F.when(F.col("known"), 0.0).otherwise(literal if literal is not None else F.lit(0.0))
        return seen.withColumn("bits", -F.log2(p) + extra).drop("n1", "n2", "nc")


def per_song(scored: DataFrame) -> DataFrame:
    return scored.groupBy("song_id").agg(F.sum("bits").alias("bits"), F.count("*").alias("symbols"), F.count_if(~F.col("known")).alias("unknown"), (F.sum("bits") / F.greatest(F.count("*"), F.lit(1))).alias("rate"))


def family_symbols(parts: DataFrame) -> DataFrame:
    """Atoms as members of a family under transposition and scaling of time: shapes of pitch and duration over their common divisor; a rest starts anew."""
    w = Window.partitionBy("song_id").orderBy("t")
    pitches = F.transform("notes", lambda n: n["pitch"])
    durations = F.transform("notes", lambda n: n["duration"])
    rows = parts.select("*", F.array_min(pitches).alias("low"), F.lag("kind").over(w).alias("pk"), F.lag("anchor").over(w).alias("pa"), F.lag(F.array_min(pitches)).over(w).alias("pl"))
    start = F.col("pk").isNull() | (F.col("pk") == "REST")
    gap = F.when(~start, F.col("anchor") - F.col("pa"))

    def gcd(a: Column, b: Column) -> Column:
        """Euclid's algorithm in as many steps as 64-bit numbers can need."""
        first = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))

        def step(acc: Column, _: Column) -> Column:
            return F.struct(F.when(acc["y"] == 0, acc["x"]).otherwise(acc["y"]).alias("x"), F.when(acc["y"] == 0, F.lit(0).cast("bigint")).otherwise(F.pmod(acc["x"], F.greatest(acc["y"], F.lit(1)))).alias("y"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), first, step, lambda acc: acc["x"])

    scale = F.aggregate(durations, F.coalesce(gap, F.lit(0)).cast("bigint"), lambda acc, d: gcd(acc, d.cast("bigint")))
    shape = F.array_join(F.transform(pitches, lambda p: (p - F.col("low")).cast("string")), ",")
    times = F.array_join(F.transform(durations, lambda d: F.floor(d / F.col("scale")).cast("string")), ",")
    rows = rows.withColumn("scale", F.greatest(scale, F.lit(1)))
    first = F.concat_ws("|", F.lit("start"), shape, times)
    later = F.concat_ws("|", F.lit("next"), (F.col("low") - F.col("pl")).cast("string"), shape, F.floor(gap / F.col("scale")).cast("string"), times)
    return rows.select("song_id", "t", F.when(F.col("kind") == "REST", "rest").when(start, first).otherwise(later).alias("family"))

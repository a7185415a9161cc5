"""Secret scan with SQL functions only: fixed patterns, and a randomness test battery for what they miss.

Base spans: assignments to a secret's name, access keys, long hexadecimal runs.

The battery looks at other runs of 20 or more letters, digits and the signs of base 64, with at least one letter.  A
run's encoding is inferred as the smallest alphabet that holds it (16, 36, 62 or 64 symbols).  Three tests measure
how random its symbols are: chi-squared against uniform use of the alphabet, the number of runs above and below the
alphabet's middle, and the correlation of neighbours.  Each is taken as a test of equivalence.  Its null hypothesis is
that the symbols are as structured as text or worse: used as unevenly as letters in text are, with as few runs as
grouped symbols have, or correlated as counted-up symbols are.  A small p says that this run is more random than
that, the smaller the longer the run.  A secret has to be random in all three respects, so the three are joined by
the largest p (an intersection-union test).

Benjamini and Hochberg's procedure over the whole corpus, within bands of length (powers of two), keeps the share of
false discoveries under ``ALPHA`` in each band; its thresholds come from a histogram of log p with a fixed number of bins.

Defined cases: null and empty texts have no spans; only the named columns are read, whole; repeated rows give
repeated results; null ids are kept; an empty table gives an empty result.  Equal signs belong to a run only as its
padding.  Added spans never overlap base spans.  What is stored meanwhile are places and test results, never a secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .spans import PLACE, apart, by_start, listed, matches

KINDS = ["assign", "access", "hex", "random"]
#: The lookahead only spares the alternatives where none can start; possessive ends only spare backtracking.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs of the alphabets' symbols with padding; URL-safe signs count as the others.
CANDIDATE = r"(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"

#: False discoveries among added spans.
ALPHA = 0.01
#: Bins of -log10 p, ten each, at most.
BINS, PER = 400, 10

ORDER = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
#: Symbols of an alphabet, and how unevenly structured runs use it at least: alphabet * (chance that two symbols are
#: equal) - 1, which uniform symbols have at 0.  In text that chance is 0.065, with capitals 0.05 and among A to F 0.17;
#: slightly less is taken.
ALPHABETS = {16: 1.2, 36: 1.1, 62: 2.0, 64: 2.1}
#: Changes between the alphabet's halves, a symbol, of structured runs at most (0.5 at random), and their least correlation.
CHANGES, CORRELATION = 0.25, 0.7


def tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by a logistic approximation (absolute error under 0.0002)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _values(token: Column) -> Column:
    """Numbers of a run's symbols without its padding; a run without small letters counts as one without capitals, as hexadecimal and base 32 do."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    plain = F.when(plain.rlike("[a-z]"), plain).otherwise(F.lower(plain))
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ORDER), c) - 1)


def statistics(v: Column) -> Column:
    """n, k and what the tests need of a run's numbers: chi, changes and lag."""

    def sized(x: Column) -> Column:
        top, n = F.array_max(x), F.size(x).cast("double")
        k = F.when(top < 16, 16.0).when(top < 36, 36.0).when(top < 62, 62.0).otherwise(64.0)
        return F.struct(x.alias("x"), n.alias("n"), k.alias("k"), (F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n).alias("mean"))

    def measured(z: Column) -> Column:
        x, n, k, mean = z["x"], z["n"], z["k"], z["mean"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(x, lambda y: y == d)), F.lit(2.0)))
        # all neighbours at once: (previous number, changes so far, lagged products)
        first = F.struct(F.lit(None).cast("int").alias("p"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("lag"))

        def step(a: Column, y: Column) -> Column:
            changed = a["p"].isNotNull() & ((a["p"] * 2 >= k) != (y * 2 >= k))
            lag = F.when(a["p"].isNull(), 0.0).otherwise((a["p"] - mean) * (y - mean))
            return F.struct(y.alias("p"), (a["changes"] + F.when(changed, 1.0).otherwise(0.0)).alias("changes"), (a["lag"] + lag).alias("lag"))

        walked = F.aggregate(x, first, step)
        spread = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        lag = F.when(spread > 0, walked["lag"] / spread).otherwise(1.0)
        return F.struct(n.alias("n"), k.alias("k"), (k / n * squares - n).alias("chi"), walked["changes"].alias("changes"), lag.alias("lag"))

    return F.transform(F.transform(F.array(v), sized), measured)[0]


def p_values(m: Column) -> tuple[Column, Column, Column]:
    """Of the chi-squared, runs and serial-correlation tests: the chance of a result as random as this under structure."""
    n, k = m["n"], m["k"]
    uneven = F.coalesce(*(F.when(k == a, F.lit(d)) for a, d in ALPHABETS.items()))
    chi = tail((n * uneven + k - 1 - m["chi"]) / F.sqrt(2 * (k - 1) + 4 * n * uneven))
    runs = tail((m["changes"] - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES)))
    lag = F.least(F.abs(m["lag"]), F.lit(0.999))
    serial = tail((math.atanh(CORRELATION) - F.atanh(lag)) * F.sqrt(n - 3))
    return chi, runs, serial


def battery(spans: Column) -> Column:
    """The spans' places with band (of length) and bin (of -log10 p as structure)."""
    walked = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), statistics(_values(x["v"])).alias("m")))

    def tested(x: Column) -> Column:
        bins = F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(*p_values(x["m"]))) * PER)).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.floor(F.log2(x["m"]["n"])).cast("int").alias("band"), bins.alias("bin"))

    return F.transform(walked, tested)


def thresholds(candidates: DataFrame) -> dict[int, int]:
    """band -> least bin that is a discovery; ``candidates`` has band and bin.  A band has at most BINS + 1 rows, and a length of 2**31 is band 31."""
    counts = candidates.groupBy("band", "bin").agg(F.count("*").alias("n"))
    above = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("i", F.sum("n").over(above)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    found = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / PER) <= ALPHA * F.col("i") / F.col("m"))  # p is at most that
    return {r[0]: r[1] for r in found.groupBy("band").agg(F.min("bin")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (kind, s, e) for every row."""
    text = text_or_empty(text_col)
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.filter(matches(text, ASSIGN, "assign"), lambda x: F.length(F.regexp_replace(x["v"], ASSIGN_VALUE, "")) >= 12).alias("assign"),
        matches(text, ACCESS, "access").alias("access"),
        matches(text, HEX, "hex").alias("hex"),
        matches(text, CANDIDATE, "random").alias("runs"),
    )
    found = found.select("doc_id", by_start(F.concat("assign", "access", "hex"), KINDS).alias("base"), "runs")
    found = found.select("doc_id", "base", F.when(F.size("runs") > 0, apart(F.col("runs"), F.col("base"))).otherwise(F.col("runs")).alias("runs"))
    found = stored(found.select("doc_id", "base", F.when(F.size("runs") > 0, battery(F.col("runs"))).alias("runs")), "secrets")
    least = thresholds(found.select(F.explode("runs").alias("x")).select("x.band", "x.bin"))
    limits = F.create_map(*(F.lit(x) for item in sorted(least.items()) for x in item)) if least else F.create_map().cast("map<int,int>")
    kept = F.filter(F.coalesce("runs", F.array()), lambda x: x["bin"] >= F.coalesce(F.try_element_at(limits, x["band"]), F.lit(BINS + 1)))
    added = F.transform(kept, lambda x: F.struct(F.lit("random").alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    spans = F.when(F.size(added) > 0, by_start(F.concat("base", added.cast(PLACE)), KINDS)).otherwise(F.col("base"))
    return found.select("doc_id", "base", spans.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    found = scan(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

"""Filter interaction audit: what each filter of a chain removes, in every order, without running any order.

Each row's failures are the bits of a mask.  Per part and label the rows are summed under all signs of parity: W[S] is
the sum of (-1)^|mask & S| (a Walsh-Hadamard transform, 32 sums for five filters), so whatever the number of rows, a part
is 32 numbers for each label.  The transform is its own inverse but for a factor of 32, so the cells (rows by mask) come
back exactly, and all orders, steps and Shapley values are sums of cells: a row that fails k filters is removed by each
of them in k!-th parts of the orders alike, so a filter gets 120 / k of it.

Rows are judged as they are: null texts are empty, null parts are the empty string.  Rows with a null id are no copies of
others and have no labels; several labels of an id count as one that holds if any does.  Repeated rows count as often as
they occur; of equal ids with equal texts none is a copy of the other.  An empty table gives no rows.  Columns are read
by name, and others are ignored.
"""

from __future__ import annotations

import itertools
import json
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

FILTERS = "ABCDE"
WORDS = r"[^\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits 0 to 3: under 50 words, under 65 % distinct words, over 5 % capitals, signs of markup."""

    def bits(words: Column) -> Column:
        n = F.size(words)
        tests = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), bits)[0]


def masked(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: numbers of rows by mask.  Bit 4: a smaller id has the same text.

    Texts meet by their digests, as small rows.  Rows of a text are counted by id first, then by part and label with the
    smallest id's count beside, so a text that a third of all rows has comes down to a row for each part and label
    before its smallest id is compared; no row is joined with its copies.
    """
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].alias("i"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), failures(text).alias("m"))
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("i")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    spread = [F.coalesce("i", F.xxhash64("h", "part")).alias("k"), F.col("i").isNull().alias("none")]  # rows without an id don't meet in one task
    rows = rows.select("*", *spread).join(marks.select(F.col("i").alias("k"), F.lit(False).alias("none"), "good", "toxic"), ["k", "none"], "left")
    key = ["h", "m", "part", "good", "toxic"]
    by_id = rows.select("h", "m", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "i").groupBy(*key, "i").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.min("i").alias("first"), F.min_by("n", "i").alias("firsts"), F.sum(F.when(F.col("i").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    smallest = F.min("first").over(Window.partitionBy("h"))
    by_text = by_text.withColumn("own", F.col("nulls") + F.when(F.col("first") == smallest, F.col("firsts")).otherwise(0))
    cells = F.array(F.struct(F.col("m").alias("mask"), F.col("own").alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    out = by_text.select("part", "good", "toxic", F.inline(cells)).where("n > 0")
    return out.select("part", "mask", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))


def sign(a: Column, b: Column) -> Column:
    """-1 if a and b share an odd number of bits, else 1."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame, weights: list[str], filters: int, part: str = "part", mask: str = "mask") -> DataFrame:
    """part and, for each weight, an array of 2^filters signed sums; rows are combined before they are shuffled."""
    subsets = range(1 << filters)
    sums = {w: [F.sum(F.col(w) * sign(F.col(mask), F.lit(s))) for s in subsets] for w in weights}
    out = rows.groupBy(part).agg(*(x.alias(f"{w}_{s}") for w in weights for s, x in enumerate(sums[w])))
    return out.select(part, *(F.array(*(f"{w}_{s}" for s in subsets)).alias(w) for w in weights))


def cells_of(sums: Column, filters: int) -> Column:
    """The transform inverted: rows by mask, exactly."""
    subsets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def cell(m: Column) -> Column:
        return F.aggregate(subsets, F.lit(0).cast("long"), lambda acc, s: acc + F.get(sums, s) * sign(m, s)) / (1 << filters)

    return F.transform(subsets, lambda m: cell(m).cast("long"))


def orders_table(filters: str) -> Column:
    """An array of (filter_order, step, before, bit) for all orders: which filters came before, and which one it is."""
    rows = [{"filter_order": "".join(o), "step": k + 1, "before": sum(1 << filters.index(x) for x in o[:k]), "bit": 1 << filters.index(o[k])} for o in itertools.permutations(filters) for k in range(len(o))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def audit(sums: DataFrame, filters: str, part: str = "part") -> DataFrame:
    """A row for each part, order and step, from the parity sums of n, good and toxic."""
    of = sums.select(part, *(cells_of(F.col(w), len(filters)).alias(w) for w in ("n", "good", "toxic")))
    of = of.select("*", F.inline(orders_table(filters)))
    everything = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))

    def over(cells: str, test) -> Column:
        return F.aggregate(everything, F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m), F.get(F.col(cells), m)).otherwise(0))

    def met(m: Column, bits: str) -> Column:
        return m.bitwiseAND(F.col(bits)) != 0

    def removed(m: Column) -> Column:
        return met(m, "bit") & ~met(m, "before")

    all_orders = factorial(len(filters))
    share = F.aggregate(everything, F.lit(0).cast("long"), lambda acc, m: acc + F.when(met(m, "bit"), F.get(F.col("n"), m) * (F.lit(all_orders) / F.bit_count(m)).cast("long")).otherwise(0))
    return of.select(
        part, "filter_order", "step", over("n", lambda m: ~met(m, "before") & ~met(m, "bit")).alias("kept"), over("n", removed).alias("removed"), over("n", lambda m: met(m, "bit") & met(m, "before")).alias("redundant"),
        F.get(F.col("n"), F.col("bit")).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(parity_sums(masked(docs, labels), ["n", "good", "toxic"], len(FILTERS)), FILTERS)


#: The same, by running each order over the rows.
ORACLE = """WITH rows_ AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents d),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
worded AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM rows_),
failing AS (SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
stepped AS (SELECT part, filter_order, k AS step, o[k] AS i, f, n, good, toxic, f[o[k]] AS hit, len(list_filter(o[:k - 1], lambda j: f[j])) > 0 AS gone FROM masks, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
steps AS (SELECT part, filter_order, step, any_value(i) AS i, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
  sum(n) FILTER (hit AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM stepped GROUP BY ALL),
steps2 AS (SELECT part, filter_order, step, i, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM steps)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley FROM steps2"""

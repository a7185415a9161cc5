"""Reversible pair merges: fitting rounds, greedy encoding, decoding, and what a merge table costs.

A symbol is its base tokens joined by a space, so that decoding is splitting.  A round counts adjacent pairs in one
aggregation; only the winning pair comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def pair_counts(rows: DataFrame, symbols: str = "symbols", song: str = "song_id") -> DataFrame:
    """l, r, n (occurrences, overlapping ones too), songs (that have the pair)."""
    s = F.col(symbols)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    # one row for each pair of a sequence, with its number, so a frequent pair is summed before it is shuffled
    return rows.select(song, F.explode(pairs).alias("p")).groupBy(song, "p.l", "p.r").agg(F.count("*").alias("n")).groupBy("l", "r").agg(F.sum("n").alias("n"), F.count_distinct(song).alias("songs"))


def merged(symbols: Column, left: Column, right: Column) -> Column:
    """Greedy from the left: a symbol that follows its partner joins it.  A joined symbol is never a partner again, as it differs from both."""
    new = F.concat_ws(" ", left, right)

    def pair_at(i: Column) -> Column:
        return F.coalesce((F.get(symbols, i) == left) & (F.get(symbols, i + 1) == right), F.lit(False))

    # pairs of two different symbols can't overlap, so each place is judged by itself
    apart = F.filter(F.transform(symbols, lambda x, i: F.when(pair_at(i), new).when(~pair_at(i - 1), x)), lambda x: x.isNotNull())

    # a run of one symbol pairs from its start: the last symbol joins unless it has just been joined
    def step(acc: Column, x: Column) -> Column:
        joins = (x == right) & (F.try_element_at(acc, F.lit(-1)) == left)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(new))).otherwise(F.concat(acc, F.array(x)))

    runs = F.aggregate(symbols, F.array().cast("array<string>"), step)
    found = F.array_contains(symbols, left) & F.array_contains(symbols, right)
    return F.when(~found, symbols).when(left == right, runs).otherwise(apart)


def encoded(symbols: Column, rules: list[tuple[str, str]]) -> Column:
    """All rules in their order, as one fold over a table of rules: the plan grows by a literal for each."""
    if not rules:
        return symbols
    table = F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in rules))
    return F.aggregate(table, symbols, lambda acc, rule: merged(acc, rule["l"], rule["r"]))


def encode(rows: DataFrame, rules: list[tuple[str, str]], symbols: str = "symbols") -> DataFrame:
    """The rows with ``symbols`` encoded, for tables of many rules: a sequence meets only the rules whose pairs it holds.

    The result is that of :func:`encoded`.  A sequence's time is about in proportion to its length times its logarithm.
    """
    ranks: dict[tuple[str, str], list[int]] = {}
    for k, (a, b) in enumerate(rules):
        ranks.setdefault((a, b), []).append(k)
    shared, at = rows.sparkSession.sparkContext.broadcast(ranks), rows.columns.index(symbols)  # as large as the vocabulary

    def of(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            done = [None if x is None else merge_by_rank(x, known) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(done, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(of, rows.schema)


def merge_by_rank(symbols: list[str], ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """Rules by rank: a heap holds the places of pairs that some rule joins; joined places are linked past."""
    from bisect import bisect_left
    from heapq import heapify, heappop, heappush

    items: list[str | None] = list(symbols)
    after, before = [*range(1, len(items) + 1)], [*range(-1, len(items) - 1)]

    def entry(i: int, least: int) -> tuple[int, int] | None:
        """The first rule from ``least`` on that joins the symbol at ``i`` with the next one."""
        if i < 0 or after[i] >= len(items):
            return None
        of = ranks.get((items[i], items[after[i]]), ())
        k = bisect_left(of, least)
        return (of[k], i) if k < len(of) else None

    heap = [x for i in range(len(items)) if (x := entry(i, 0))]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if items[i] is None or entry(i, rank) != (rank, i):
            continue
        j = after[i]
        items[i], items[j] = f"{items[i]} {items[j]}", None
        after[i] = after[j]
        if after[j] < len(items):
            before[after[j]] = i
        for x in (entry(before[i], rank + 1), entry(i, rank + 1)):
            if x:
                heappush(heap, x)
    return [x for x in items if x is not None]


def decoded(symbols: Column) -> Column:
    return F.flatten(F.transform(symbols, lambda s: F.split(s, " ")))


def units(symbol: Column) -> Column:
    return F.size(F.split(symbol, " "))


def fit(rows: DataFrame, merges: int, *, min_count: int = 2, min_songs: int = 1, longest: int | None = None, barrier: str | None = None, order: str = "pair", split: str = "train") -> list[tuple[str, str, int]]:
    """Up to ``merges`` rules (left, right, count) from rows (song_id, symbols; a row for each song) of the training split; other splits, named or in a column ``split``, are an error.

    The most frequent pair wins; ties go to the smallest pair, or, by ``order='support'``, to the pair of most songs and
    then the smallest digest.  Pairs under ``min_count`` or ``min_songs``, longer than ``longest`` base tokens, with the
    barrier symbol, or that would make a known symbol again, are left out; fitting ends where none remains.
    """
    if split != "train" or "split" in rows.columns and not rows.where("split is distinct from 'train'").isEmpty():
        raise ValueError("merges are fitted on train only")
    from .merge_fit import fit as fit_by_index  # that module needs this one

    return fit_by_index(rows.select("song_id", "symbols"), merges, min_count=min_count, min_songs=min_songs, longest=longest, barrier=barrier, order=order)


def table_bits(rules: int, vocabulary: int) -> int:
    """Two references into the vocabulary as it grows, for each rule."""
    return sum(2 * math.ceil(math.log2(max(2, vocabulary + i + 1))) for i in range(rules))


def table_bits_of(rules: Column, vocabulary: Column) -> Column:
    """:func:`table_bits` of columns."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(rules, F.lit(1))), lambda k: 2 * F.ceil(F.log2(F.greatest(F.lit(2), vocabulary + k))))
    return F.when(rules > 0, F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, x: acc + x)).otherwise(0)


def corpus_stats(rows: DataFrame, symbols: str = "symbols") -> DataFrame:
    """sequences, emitted symbols, base units, and the reduction."""
    base = F.size(decoded(F.col(symbols)))
    return rows.agg(F.count("*").alias("sequences"), F.sum(F.size(symbols)).alias("emitted"), F.sum(base).alias("units")).withColumn("reduction", 1 - F.col("emitted") / F.greatest(F.col("units"), F.lit(1)))

"""Fitting of pair merges by an index that is updated, not by counting all sequences again for each merge.

Kept in the shared folder: the sequences as of some rule, an index of which songs hold a pair, and the pairs' counts.  A
round takes the best pairs that have no symbol in common, and as many as can't change each other's order; reads the
songs that hold one of them, as the index says; joins the pairs there; and writes what changed: for each song and pair
around a joined place, its number before and after.  Those changes are the counts' and the index's next part.  After
:data:`EVERY` rounds sequences and counts are written as they are then.

Rules are exactly those of taking one merge after the other.  Merging (a, b) lowers pairs that touch a or b and makes
pairs (x, ab), (ab, y), none more frequent than the (x, a), (b, y) that it comes from.  The list of pairs being in order,
a pair that shares no symbol with the better ones before it stays next, unless a pair of equal count touches them: the
round ends there if what comes of that pair could be before it.  Only the best :data:`TOP` pairs come to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_dir
from .bpe import merge_by_rank

TOP, EVERY = 400, 8


def _changes(done: list[tuple[str, str]], batch: list[tuple[str, str]]) -> Callable:
    """For each row (song_id, symbols): the pairs whose number the batch changes, after the rules that are already taken."""

    def ranks(rules: list[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
        out: dict[tuple[str, str], list[int]] = {}
        for k, rule in enumerate(rules):
            out.setdefault(rule, []).append(k)
        return out

    old, new = ranks(done), ranks(batch)

    def of(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        for part in batches:
            out: dict[str, list] = {"song_id": [], "l": [], "r": [], "before": [], "after": []}
            for song, symbols in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                was = merge_by_rank(symbols, old)
                now = merge_by_rank(was, new)
                if len(now) == len(was):
                    continue
                a, b = Counter(zip(was, was[1:])), Counter(zip(now, now[1:]))
                for pair in a.keys() | b.keys():
                    if a[pair] != b[pair]:
                        for key, value in zip(out, (song, *pair, a[pair], b[pair])):
                            out[key].append(value)
            kinds = [part.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return of


def _joined(rules: list[tuple[str, str]], column: int) -> Callable:
    ranks: dict[tuple[str, str], list[int]] = {}
    for k, rule in enumerate(rules):
        ranks.setdefault(rule, []).append(k)

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in batches:
            columns = list(part.columns)
            columns[column] = pa.array([merge_by_rank(x, ranks) for x in columns[column].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return of


def independent(ranked: list[tuple[str, str, int]], known: set[str], most: int, complete: bool, by_pair: bool) -> list[tuple[str, str, int]]:
    """The longest start of the order (l, r, n) that merges one after the other would take too.

    Pairs that would make a known symbol again are passed over.  The list has all pairs from some count on; where it is
    not ``complete``, pairs of its last count may be missing.
    """
    batch: list[tuple[str, str, int]] = []
    left, right, made, floor = {}, {}, set(known), ranked[-1][2] if ranked and not complete else -1
    for l, r, n in ranked:
        if len(batch) == most or batch and n == floor:
            break
        touches = {l, r} & (left.keys() | right.keys())
        if f"{l} {r}" in made and not touches:
            continue
        if touches:
            break
        # a pair of the same count, from which one can come that is before this one
        if any(_before(u, v, l, r, left, right, by_pair) for u, v, k in ranked if k == n and {u, v} & (left.keys() | right.keys())):
            break
        batch.append((l, r, n))
        made.add(f"{l} {r}")
        left[l], right[r] = f"{l} {r}", f"{l} {r}"
    return batch


def _before(u: str, v: str, l: str, r: str, left: dict[str, str], right: dict[str, str], by_pair: bool) -> bool:
    """Whether the pair (u, v), of which the batch takes a symbol, can become one that is before (l, r) at an equal count."""
    if not by_pair:
        return True
    return any((x, y) < (l, r) for x in {u, right.get(u, u)} for y in {v, left.get(v, v)} if (x, y) != (u, v))


class MergeIndex:
    """Sequences (song_id, symbols) with counts of pairs that follow merges."""

    def __init__(self, rows: DataFrame) -> None:
        self.spark = rows.sparkSession
        self.folder = f"{shared_dir(self.spark)}/evenspan-merges-{uuid.uuid4().hex}"
        self.written = self.read = 0  # rows of sequences that were written after the first time, and read again
        self.rules: list[tuple[str, str]] = []
        self._since: list[tuple[str, str]] = []
        self._changes: list[DataFrame] = []
        self._turn = 0
        self._rows = self._kept(rows.select("song_id", "symbols").where("symbols is not null"), "rows")
        s, n = F.col("symbols"), F.greatest(F.size("symbols") - 1, F.lit(0))
        pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
        held = self._rows.select("song_id", F.explode(pairs).alias("p")).groupBy("song_id", "p.l", "p.r").agg(F.count("*").alias("n"))
        self._index = self._kept(held.sortWithinPartitions("l", "r"), "index")  # not dealt by ranges, as their samples would count all pairs twice
        self._counts = self._kept(self._index.groupBy("l", "r").agg(F.sum("n").alias("n"), F.count("*").alias("songs")), "counts")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{self._turn}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counts(self) -> DataFrame:
        """l, r, n, songs as they are now; a song counts once for each of its rows that has the pair."""
        out = self._counts
        for part in self._changes:
            out = out.unionByName(part.groupBy("l", "r").agg(F.sum(F.col("after") - F.col("before")).alias("n"), F.sum((F.col("after") > 0).cast("long") - (F.col("before") > 0).cast("long")).alias("songs")))
        return out.groupBy("l", "r").agg(F.sum("n").alias("n"), F.sum("songs").alias("songs")).where("n > 0") if self._changes else out

    def merge(self, batch: list[tuple[str, str]]) -> None:
        """Join pairs that share no symbol."""
        wanted = F.broadcast(self.spark.createDataFrame(batch, "l string, r string"))
        held = self._index.select("song_id", "l", "r")
        for part in self._changes:
            held = held.unionByName(part.where("before = 0").select("song_id", "l", "r"))
        songs = held.join(wanted, ["l", "r"]).select("song_id").distinct()
        rows = self._rows.join(songs, "song_id", "left_semi")
        kind = self._rows.schema["song_id"].dataType.simpleString()
        self._turn += 1
        changed = rows.mapInArrow(_changes(self._since, batch), f"song_id {kind}, l string, r string, before long, after long")
        self._changes.append(self._kept(changed, "changes"))
        self.rules += batch
        self._since += batch
        if len(self._changes) == EVERY:
            self._compact()

    def sequences(self) -> DataFrame:
        """song_id, symbols under all rules so far."""
        return self._rows.mapInArrow(_joined(self._since, 1), self._rows.schema) if self._since else self._rows

    def _compact(self) -> None:
        rows, counts = self._kept(self.sequences(), "rows"), self._kept(self.counts(), "counts")
        for part in self._changes:  # the index only grows: a pair that a song has lost costs a look at that song
            self._index = self._index.unionByName(part.where("before = 0").select("song_id", "l", "r", F.col("after").alias("n")))
        self._rows, self._counts, self._changes, self._since = rows, counts, [], []
        self.written += rows.count()

    def close(self) -> None:
        delete(self.spark, self.folder)


def fit(rows: DataFrame, merges: int, *, min_count: int = 2, min_songs: int = 1, longest: int | None = None, barrier: str | None = None, order: str = "pair", stats: dict | None = None) -> list[tuple[str, str, int]]:
    """The rules (left, right, count); see :func:`evenspan.operators.bpe.fit`.  ``stats`` gets rounds, rows and rows written again."""
    index, rules, rounds = MergeIndex(rows), [], 0
    units: Callable[[str], Column] = lambda c: F.size(F.split(c, " "))
    ties = [F.col("l"), F.col("r")] if order == "pair" else [F.desc("songs"), F.sha2(F.concat_ws(" ", "l", "r"), 256)]
    try:
        while len(rules) < merges:
            pairs = index.counts().where((F.col("n") >= min_count) & (F.col("songs") >= min_songs))
            if longest is not None:
                pairs = pairs.where(units("l") + units("r") <= longest)
            if barrier is not None:
                pairs = pairs.where((F.col("l") != barrier) & (F.col("r") != barrier))
            known = {f"{a} {b}" for a, b, _ in rules}
            top = TOP + len(known)  # at most as many pairs make a known symbol again
            ranked = [(r["l"], r["r"], r["n"]) for r in pairs.orderBy(F.desc("n"), *ties).limit(top).collect()]
            batch = independent(ranked, known, merges - len(rules), len(ranked) < top, order == "pair")
            if not batch:
                break
            index.merge([(a, b) for a, b, _ in batch])
            rules += batch
            rounds += 1
        if stats is not None:
            stats.update(rounds=rounds, written=index.written, rows=rows.count())
        return rules
    finally:
        index.close()


def fit_to(rows: DataFrame, vocabulary: int, alphabet: int | None = None, **limits) -> list[tuple[str, str, int]]:
    """Rules until there are ``vocabulary`` symbols; ``alphabet`` counts the base symbols (else those that occur)."""
    base = rows.select(F.explode("symbols").alias("s")).distinct().count() if alphabet is None else alphabet
    if vocabulary <= base:
        raise ValueError("the vocabulary has to add a merge")
    return fit(rows, vocabulary - base, **limits)


def receipt(rules: list[tuple[str, str, int]], base: int, target: int, samples: int, min_count: int) -> dict:
    """What was fitted, on what, and a digest of the rules."""
    from ..sources.sinks import canonical_digest

    return {
        "algorithm": "frequency", "fit_split": "train", "fit_sample_count": samples, "base_vocabulary_size": base, "target_vocabulary_size": target, "vocabulary_size": base + len(rules),
        "learned_merge_count": len(rules), "minimum_frequency": min_count, "song_boundary_crossing": False, "rules_sha256": canonical_digest([[a, b] for a, b, _ in rules]),
    }

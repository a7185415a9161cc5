"""Merges chosen by the bits they save on held-out sequences, all candidates of a step scored at once.

The held-out bits are a sum over pairs of neighbours (p, t), a start mark before the first symbol, of
h(p, t) * -log2(weight * (f(p, t) + a) / (f(p) + a V) + (1 - weight) * (f(t) + a) / (F + a V)), with counts f in the fitted
sequences, h in the held-out ones and V symbols.  A merge changes few of these counts, all next to the joined places.  So
one table of pairs is kept; a step reads the sequences once, in which the workers find what each candidate would change;
the sums of all candidates are one aggregation over the table and those changes; and the changes of the one that is
taken are the table's next ones.  What comes to the driver is the pool, and a few numbers for each candidate.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_dir
from ..sources.sinks import canonical_digest
from .bpe import merge_by_rank

START, ESCAPE = "<s>", "<esc>"


def _bigrams(seq: list[str]) -> Iterator[tuple[str, str]]:
    return zip([START, *seq], seq)


def _changes(rules: list[tuple[str, str]], candidates: list[tuple[str, str]]) -> Callable:
    """For rows (held, symbols): candidate, held, l, r, the change of the pair's number and of the rows that have it, summed by batch."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for k, rule in enumerate(rules):
        ranks.setdefault(rule, []).append(k)

    def of(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        for part in batches:
            n: Counter = Counter()
            rows: Counter = Counter()
            for held, symbols in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seq = merge_by_rank(symbols, ranks)
                was = Counter(_bigrams(seq))
                for c, pair in enumerate(candidates):
                    if pair in was:
                        now = Counter(_bigrams(merge_by_rank(seq, {pair: [0]})))
                        for p in was.keys() | now.keys():
                            if was[p] != now[p]:
                                n[c, held, *p] += now[p] - was[p]
                                rows[c, held, *p] += (now[p] > 0) - (was[p] > 0)
            keys = list(n)
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string()]
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n[k] for k in keys], pa.int64()), pa.array([rows[k] for k in keys], pa.int64())], ["c", "held", "l", "r", "n", "songs"])

    return of


class PairTable:
    """l, r, n and songs (in fitted sequences), h (in held-out ones), which follow the merges that are taken."""

    def __init__(self, rows: DataFrame, held: DataFrame) -> None:
        self.spark = rows.sparkSession
        self.folder = f"{shared_dir(self.spark)}/evenspan-gains-{uuid.uuid4().hex}"
        base = self._kept(rows.select(F.explode("symbols").alias("s")).distinct(), "base")
        self.vocabulary = base.count()
        # held-out symbols that aren't in the vocabulary are escapes from the start: no merge takes part of one
        flat = held.select("song_id", F.posexplode("symbols").alias("i", "s")).join(base.withColumn("known", F.lit(True)), "s", "left")
        back = flat.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("known"), F.col("s")).otherwise(ESCAPE).alias("s")))).alias("x"))
        both = rows.select(F.lit(False).alias("held"), "symbols").unionByName(back.select(F.lit(True).alias("held"), F.col("x.s").alias("symbols")))
        self.rows = self._kept(both, "rows")
        s = F.concat(F.array(F.lit(START)), "symbols")
        pairs = F.zip_with(F.slice(s, 1, F.size("symbols")), F.col("symbols"), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
        each = self.rows.withColumn("row", F.monotonically_increasing_id()).select("held", "row", F.explode(pairs).alias("p")).groupBy("held", "row", "p.l", "p.r").agg(F.count("*").alias("n"))
        fitted, other = F.when(~F.col("held"), F.col("n")), F.when(F.col("held"), F.col("n"))
        self.table = self._kept(each.groupBy("l", "r").agg(F.coalesce(F.sum(fitted), F.lit(0)).alias("n"), F.count_if(~F.col("held")).alias("songs"), F.coalesce(F.sum(other), F.lit(0)).alias("h")), "pairs")
        self.units = self.table.agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
        self.rules: list[tuple[str, str]] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def changes(self, candidates: list[tuple[str, str]]) -> DataFrame:
        """c, l, r, n, songs, h: what each candidate would change."""
        found = self.rows.mapInArrow(_changes(self.rules, candidates), "c int, held boolean, l string, r string, n long, songs long")
        fitted, other = F.when(~F.col("held"), F.col("n")), F.when(F.col("held"), F.col("n"))
        sums = found.groupBy("c", "l", "r").agg(F.coalesce(F.sum(fitted), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("held"), F.col("songs"))), F.lit(0)).alias("songs"), F.coalesce(F.sum(other), F.lit(0)).alias("h"))
        return self._kept(sums, "changes")

    def bits(self, changes: DataFrame, candidates: int, alpha: float, weight: float) -> list[float]:
        """Held-out bits without a merge, then with each candidate's."""
        small = changes.select("c", F.explode(F.array(F.struct(F.lit("context").alias("of"), F.col("l").alias("s")), F.struct(F.lit("symbol").alias("of"), F.col("r").alias("s")))).alias("x"), "n")
        small = small.groupBy("c", "x.of", "x.s").agg(F.sum("n").alias("n")).where("n <> 0").collect()  # the candidate's own symbols
        moved: dict[tuple[str, int], dict[str, int]] = {}
        for r in small:
            moved.setdefault((r["of"], r["c"]), {})[r["s"]] = r["n"]
        total = self.table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        dn = F.map_from_entries(F.collect_list(F.struct("c", F.struct("n", "h"))))  # at most as many as candidates
        by_pair = changes.groupBy("l", "r").agg(dn.alias("d"))
        joined = self.table.join(by_pair, ["l", "r"], "full_outer").select("l", "r", "d", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "h")))
        context = self.table.groupBy("l").agg(F.sum("n").alias("context"))
        symbol = self.table.groupBy("r").agg(F.sum("n").alias("symbol"))
        asked = joined.where((F.col("h") > 0) | F.exists(F.map_values("d"), lambda x: x["h"] > 0))
        asked = asked.join(context, "l", "left").join(symbol, "r", "left")

        def sum_for(c: int | None) -> Column:
            d = F.col("d")[c] if c is not None else None
            h = F.col("h") + (F.coalesce(d["h"], F.lit(0)) if c is not None else 0)
            n = F.col("n") + (F.coalesce(d["n"], F.lit(0)) if c is not None else 0)

            def plus(col: str, of: str) -> Column:
                out = F.coalesce(col, F.lit(0))
                for s, k in moved.get((of, c), {}).items() if c is not None else ():
                    out = out + F.when(F.col("l" if of == "context" else "r") == s, k).otherwise(0)
                return out

            v = self.vocabulary + len(self.rules) + 1 + (c is not None)
            all_ = total + (sum(moved.get(("symbol", c), {}).values()) if c is not None else 0)
            p = weight * (n + alpha) / (plus("context", "context") + alpha * v) + (1 - weight) * (plus("symbol", "symbol") + alpha) / (all_ + alpha * v)
            return F.coalesce(F.sum(F.when(h > 0, -h * F.log2(p))), F.lit(0.0))

        return list(asked.agg(*(sum_for(c).alias(f"b{i}") for i, c in enumerate([None, *range(candidates)]))).first())

    def take(self, pair: tuple[str, str], c: int, changes: DataFrame) -> None:
        new = self.table.unionByName(changes.where(F.col("c") == c).drop("c")).groupBy("l", "r").agg(*(F.sum(x).alias(x) for x in ("n", "songs", "h")))
        self.table = self._kept(new.where("n > 0 or h > 0"), "pairs")
        self.rules.append(pair)

    def close(self) -> None:
        delete(self.spark, self.folder)


def fit_predictive(rows: DataFrame, held: DataFrame, merges: int, pool: int = 8, least_gain: float = 0.0, *, min_count: int = 2, min_songs: int = 1, longest: int | None = None, barrier: str | None = None, alpha: float = 0.25, weight: float = 0.75) -> list[dict]:
    """Merges among the ``pool`` most frequent pairs of rows (song_id, symbols; a row for each song) that save most bits on
    held-out rows, until none saves more than ``least_gain`` a base symbol.  The pool leaves out pairs under ``min_count``
    or ``min_songs``, longer than ``longest`` and with the barrier symbol (rests), and those that no held-out row has."""
    table, steps = PairTable(rows, held), []
    units: Callable[[str], Column] = lambda c: F.size(F.split(c, " "))
    try:
        for index in range(merges):
            fit = table.table.where((F.col("l") != START) & (F.col("n") >= min_count) & (F.col("songs") >= min_songs))
            if longest is not None:
                fit = fit.where(units("l") + units("r") <= longest)
            if barrier is not None:
                fit = fit.where((F.col("l") != barrier) & (F.col("r") != barrier))
            best = fit.orderBy(F.desc("n"), F.desc("songs"), F.sha2(F.concat_ws(" ", "l", "r"), 256)).limit(pool).collect()
            best = [r for r in best if r["h"] > 0]
            if not best:
                break
            pairs = [(r["l"], r["r"]) for r in best]
            changes = table.changes(pairs)
            before, *after = table.bits(changes, len(pairs), alpha, weight)
            c = min(range(len(pairs)), key=lambda i: (-(before - after[i]), canonical_digest(" ".join(pairs[i]))))
            gain = (before - after[c]) / max(table.units, 1)
            if gain <= least_gain:
                break
            places = -changes.where(F.col("c") == c).agg(F.coalesce(F.sum("h"), F.lit(0))).first()[0]
            left, right = pairs[c]
            steps.append({
                "index": index, "left": left, "right": right, "count": best[c]["n"], "songs": best[c]["songs"], "support_units": len(f"{left} {right}".split()), "candidates": len(pairs), "held_places": places,
                "bits_before": before, "bits_after": after[c], "gain": gain, "table_bits": 2.0 * math.ceil(math.log2(max(table.vocabulary + len(table.rules) + 1, 2))), "expansion_sha256": canonical_digest(f"{left} {right}".split()),
            })
            table.take(pairs[c], c, changes)
        return steps
    finally:
        table.close()

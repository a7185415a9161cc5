"""Line dedup with levelled sorted runs of line hashes.

A :class:`LineRuns` store holds runs: tables of (h, g, n), two hashes of a line and its number of documents, bucketed by
the hashes and sorted by them.  Each new batch of documents is counted, merge-anti-joined with the saturated lines of
each run (those already found in enough documents, which need no more counting) and then written as a run of level 0.
A level holds one run: a second one is merged with it into a run of the next level, so n batches keep O(log n) runs.
Runs have equal buckets in equal order, so their merges and anti-joins are joins of sorted files without an exchange.
A batch is counted before it is shuffled, so a line that a third of all documents hold is one row from each task.

Which lines go is then a join of the documents' lines with the frequent hashes: broadcast where their counted
number has a small size, else shuffled, with the hashes of very many documents (counted, and few by arithmetic: at most
lines / ``HOT``) broadcast apart from the rest, so no task gets more than ``HOT`` lines of a hash.  Documents get their
lines back by a hash of id and text in the same way.

Lines are told apart by two 64-bit hashes.  Defined cases: a null or empty text is one empty line, whose key is shorter
than ``min_chars`` and stays.  A row is a document: repeated rows count each.  Null ids are kept.  Empty tables give
empty results.  Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fitting, fresh, hot_join, shared_dir, stored, text_or_empty

#: White space that is stripped from both ends of a line: space, tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent hashes of more documents than this are joined by broadcast: a task gets fewer lines of any other.
HOT = 20_000
#: Bytes of frequent hashes that are broadcast whole.
SMALL = 1 << 25


def ascii_lower(col: Column) -> Column:
    """A-Z only.  ``lower`` does the same to plain ASCII, and is faster than ``translate``."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """Each line's key."""
    return F.transform(F.split(text, "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(BLANKS))))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("b"), key).alias("g"))


def _lines(docs: DataFrame, text: Column, min_chars: int, *keep: str) -> DataFrame:
    """h, g of the distinct lines of each row, without those whose keys have fewer than ``min_chars`` code points."""
    keys = F.filter(F.array_distinct(line_keys(text)), lambda k: F.length(k) >= min_chars)
    return docs.select(*keep, F.explode(F.transform(keys, _hashed)).alias("x")).select(*keep, "x.h", "x.g")


LINE = ["h", "g"]


class LineRuns:
    """The runs of one corpus, in a folder of its own that driver and executors share; :meth:`close` deletes it."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> None:
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.at = f"{shared_dir(spark)}/evenspan/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    @contextlib.contextmanager
    def _in_order(self) -> Iterator[None]:
        """Scans of sorted buckets count as sorted."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with self._in_order():
            counts.write.option("path", f"{self.at}/{name}").bucketBy(self.buckets, *LINE).sortBy(*LINE).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, f"{self.at}/{name}")

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, by a join of their sorted buckets."""
        x, y = self.spark.table(a).withColumnRenamed("n", "x"), self.spark.table(b).withColumnRenamed("n", "y")
        return x.hint("merge").join(y, LINE, "full").select(*LINE, (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n"))

    def _merge(self, a: str, b: str) -> str:
        name = self._write(self.merged(a, b))
        self._drop(a)
        self._drop(b)
        return name

    def unsaturated(self, counts: DataFrame) -> DataFrame:
        """The lines that no run holds often enough."""
        for run in filter(None, self.levels):
            counts = counts.join(self.spark.table(run).where(F.col("n") >= self.min_docs).select(*LINE).hint("merge"), LINE, "left_anti")
        return counts

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count the lines of a batch of documents that no run already holds often enough, as a new run."""
        counts = _lines(docs, text_or_empty(text_col), self.min_chars).groupBy(*LINE).agg(F.count("*").alias("n"))
        run, level = self._write(self.unsaturated(counts)), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = run

    def frequent(self) -> DataFrame:
        """``h``, ``g`` of the lines found in at least ``min_docs`` documents; all runs become one."""
        runs = [run for run in self.levels if run]
        if len(runs) > 1:
            self.levels = [None] * (len(self.levels) - 1) + [reduce(self._merge, runs)]
        return self.spark.table(next(filter(None, self.levels))).where(F.col("n") >= self.min_docs).select(*LINE)

    def close(self) -> None:
        for run in filter(None, self.levels):
            self._drop(run)
        self.levels = []
        discard(self.spark, self.at)


def batches_of(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[DataFrame]:
    """The table in ``n`` batches by a hash of the id, as they might arrive one after the other; together they hold all rows."""
    return [docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)) == k) for k in range(n)]


def drop_frequent_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", prefix: str = "_ld") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` rid of its frequent lines, and ``<prefix>_lines`` and ``<prefix>_dropped``.

    Documents meet their lines again by hashes of id and text: the dropped lines are a function of the text, and
    the id spreads many copies of one text over the tasks.
    """
    frequent = stored(frequent, "frequent-lines")
    rows = frequent.count()
    text = text_or_empty(text_col)
    k1, k2, gone, kept = fresh(docs, f"{prefix}_k1", f"{prefix}_k2", f"{prefix}_gone", f"{prefix}_kept")
    docs = docs.withColumns({k1: F.xxhash64(id_col, text), k2: F.xxhash64(F.lit("b"), id_col, text)})
    lines = _lines(docs, text, min_chars, k1, k2)
    if rows * 40 <= SMALL:
        found = lines.join(F.broadcast(frequent), LINE, "left_semi")
    else:
        hot = stored(frequent.join(lines.groupBy(*LINE).agg(F.count("*").alias("n")).where(F.col("n") > HOT), LINE), "hot-lines")
        few = F.broadcast(hot.where(F.col("n") > fitting(hot, F.lit(40), "n", HOT)).select(*LINE))
        rest = lines.join(few, LINE, "left_anti").join(frequent.join(few, LINE, "left_anti"), LINE, "left_semi")
        found = lines.join(few, LINE, "left_semi").unionByName(rest)
    found = found.groupBy(k1, k2).agg(F.collect_set(F.struct(*LINE)).alias(gone), F.count("*").alias("_n"))
    found = stored(found, "found-lines")
    many, places = found.agg(F.count("*"), F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()
    out = hot_join(docs, found, [k1, k2], "left", 1, 96 * many + 48 * places, "_n", size=96 + 48 * F.size(gone)).drop("_n")
    split = F.split(text, "\n", -1)
    hashes = F.transform(line_keys(text), lambda k: F.when(F.length(k) >= min_chars, _hashed(k)))
    keep = F.filter(F.arrays_zip(split.alias("l"), hashes.alias("x")), lambda z: z["x"].isNull() | ~F.array_contains(F.col(gone), z["x"]))
    none = F.col(gone).isNull()
    out = out.withColumn(f"{prefix}_lines", F.size(split).cast("long")).withColumn(kept, F.when(none, F.array(F.lit(""))).otherwise(keep["l"]))
    out = out.withColumn(f"{prefix}_dropped", F.when(none, F.lit(0)).otherwise(F.col(f"{prefix}_lines") - F.size(kept)).cast("long"))
    new = F.when(none, text).otherwise(F.concat_ws("\n", kept))
    return out.withColumn(text_col, new).drop(k1, k2, gone, kept)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """Count the lines of all documents batch by batch, then drop those found in at least ``min_docs`` of them."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    for batch in batches_of(docs, batches, id_col):
        runs.add(batch, text_col)
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.close()
    return drop_frequent_lines(docs, frequent, min_chars, id_col, text_col)


def digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The columns of the query."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


#: The same in DuckDB; x'0b' and friends are written as chr().
ORACLE = """
WITH l AS (
  SELECT doc_id, rid, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.k IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.rid, l.doc_id
"""

"""Copy-on-write upsert of a keyed table that lies as sorted files: only files whose rows differ are written again.

A table is a folder of files with one row range of the key each.  :func:`cut` sorts all rows by range, counts the rows
of each partition, and places every row by its partition's offset and its place there, so a file is arithmetic on the
rank and no task but a file's own writer holds a file.  :func:`upsert` sends each change to its home, the last file that
begins at or below its key, by a binary search in the files' first keys; joins winners and rows in full, compares them
null-safely, and ranks the rows of the homes that differ as a whole again, by which they are cut into the fewest files
of even size.  Homes that are left small are joined with neighbours that were written too.

What is broadcast or goes to the driver: the first keys and row counts of files (at most :data:`MOST_FILES`, an error
beyond) and the rows of each partition.  Rows and changes never do.  New files are written before replaced ones go, and
replaced ones go last, so a run that dies leaves the table readable as it was, with files of a generation beside it that
no result names.

Defined results: rows with a null key aren't in the table, changes with a null key are ignored; rows of equal keys are
sorted by their other columns and all take a change of their key; of changes with equal order columns the first by its
other columns wins; without any starting file there are no homes, and changes are ignored.  Columns of changes that
aren't asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, fresh, literal, ranked, written

#: Files of a table: a few numbers for each are in every task.
MOST_FILES = 100_000
#: Name of the folder level that a file has of its own.
LEVEL = "evenspan_file"
#: Names of starting and of new files: the home's number, and which of its files.
OLD, NEW = "s%09d", "w%09d-%09d"


@dataclass
class Table:
    """A table in files: where, which columns, its key, rows in a file, and the first key of each file."""

    path: str
    schema: StructType
    key: str
    size: int
    fences: list


def home_of(fences: list, key: Column) -> Column:
    """The number of the last file beginning at or below the key, else 0: a binary search in the sorted first keys."""
    firsts = literal(fences)
    turns = F.sequence(F.lit(1), F.lit(max(1, len(fences).bit_length())))

    def halved(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        right = F.get(firsts, mid) <= key
        return F.struct(F.when(right, mid).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.greatest(acc["lo"], mid - 1)).alias("hi"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.lit(len(fences) - 1).alias("hi")), halved, lambda acc: acc["lo"])


def ordered(df: DataFrame, key: str) -> list[str]:
    """The key, then the other columns that can be compared."""
    return [key, *(c for c, kind in df.dtypes if c != key and "map<" not in kind and "variant" not in kind)]


def write_files(rows: DataFrame, columns: list[str], order: list[str], files: int, path: str) -> None:
    """One file for each value of :data:`LEVEL`, each written by one task in the order of the key."""
    named = rows.select(*columns, LEVEL)
    spread = min(max(1, files), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named.repartitionByRange(spread, LEVEL).sortWithinPartitions(LEVEL, *order).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(LEVEL).parquet(path)


def cut(df: DataFrame, key: str, size: int, path: str) -> Table:
    """Write the rows, sorted by key, as files of ``size`` rows (the last: the rest)."""
    if LEVEL in df.columns:
        raise ValueError(f"{LEVEL} names the folders of files")
    spark, sort = df.sparkSession, ordered(df, key)
    rank = fresh(df, "rank")[0]
    placed, kept = ranked(df.where(F.col(key).isNotNull()), sort, rank)
    number = F.floor(F.col(rank) / size)
    firsts = placed.groupBy(number.alias("f")).agg(F.min(key), F.count("*")).orderBy("f").limit(MOST_FILES + 1).collect()  # a row for each file
    if len(firsts) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files: more rows have to go into each")
    make_folder(spark, path)
    if firsts:
        write_files(placed.withColumn(LEVEL, F.format_string(OLD, number)), df.columns, sort, len(firsts), path)
    discard(spark, kept)
    return Table(path, df.schema, key, size, [r[1] for r in firsts])


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def read_table(spark: SparkSession, table: Table) -> DataFrame:
    """The table's rows, with the name of each one's file in :data:`LEVEL`."""
    return spark.read.schema(StructType([*table.schema.fields]).add(LEVEL, "string")).parquet(table.path)


def winners(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key.  Only one row of a key in each task is shuffled, as the limit on the number is pushed down."""
    last = [F.desc(c) for c in order] + [F.asc(c) for c in ordered(changes, key)[1:] if c not in order]
    number = fresh(changes, "number")[0]
    return changes.where(F.col(key).isNotNull()).withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(*last))).where(F.col(number) == 1).drop(number)


def laid_out(rows_after: dict[int, int], files: int, size: int) -> tuple[list[int], list[str]]:
    """For each home, the number of files that its rows are cut into, and the name of the one that its first file's rows go into.

    Works on numbers of rows by home, never on rows.  Two files of one home have over ``size`` rows together, so only a
    home's first file may join the remaining one before it.
    """
    cuts, into = [0] * files, [""] * files
    last, last_rows = "", 0  # the remaining left neighbour, if it is a rewritten one
    for home in range(files):
        if home not in rows_after:
            last = ""
        elif n := rows_after[home]:
            k = cuts[home] = -(-n // size)
            joins = last and last_rows + -(-n // k) <= size
            into[home] = last if joins else NEW % (home, 0)
            last, last_rows = (into[home], n + last_rows * bool(joins)) if k == 1 else (NEW % (home, k - 1), n // k)
    return cuts, into


def piece_of(rank: Column, n: Column, k: Column) -> Column:
    """Which of ``k`` files of even size, larger first, a rank of ``n`` rows is in."""
    small, big = F.floor(n / k), n % k
    head = big * (small + 1)
    return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(big + F.floor((rank - head) / F.greatest(small, F.lit(1)))).cast("bigint")


def upsert(spark: SparkSession, table: Table, changes: DataFrame, order: list[str], sets: list[str], act: Callable[[Column], Column]) -> list[int]:
    """Apply the winning changes to the table's files; returns the starting files that were replaced.

    ``act``, given the first key of a change's home, is 'D' for a change that deletes, 'S' for one that sets the columns
    ``sets`` (and inserts an absent key), null for one that is ignored.
    """
    key, files, cols = table.key, len(table.fences), table.schema.names
    if not files:
        return []
    both_names = changes.select(*(F.lit(0).alias(c) for c in dict.fromkeys(c.lower() for c in [*cols, *changes.columns])))
    home, to, action, there, differs, rank, *values = fresh(both_names, "home", "to", "action", "there", "differs", "rank", *(f"new_{c}" for c in sets))
    new = dict(zip(sets, values, strict=True))
    won = winners(changes, key, order).withColumn(to, home_of(table.fences, F.col(key)))
    won = won.withColumn(action, act(F.get(literal(table.fences), F.col(to)))).where(F.col(action).isNotNull())
    won = won.select(key, to, action, *(F.col(c).alias(new[c]) for c in sets))
    both = read_table(spark, table).withColumn(there, F.substring(LEVEL, 2, 9).cast("int")).join(won, key, "full_outer")
    gone, set_ = F.coalesce(F.col(action) == "D", F.lit(False)), F.coalesce(F.col(action) == "S", F.lit(False))
    after = {c: F.when(set_, F.col(new[c])).otherwise(F.col(c)) for c in sets}
    unequal = F.col(there).isNull() | gone
    for c in sets:
        unequal = unequal | ~F.col(c).eqNullSafe(after[c])
    both = both.where(F.col(there).isNotNull() | ~gone)
    both, kept = written(both.select(*(after.get(c, F.col(c)).alias(c) for c in cols), F.coalesce(there, to).alias(home), unequal.alias(differs), gone.alias(action)), "upsert", ["evenspan"])
    counts = both.groupBy(home).agg(F.max(differs).alias("d"), F.count_if(~F.col(action)).alias("n")).where("d").collect()  # a row for each home
    rows_after = {r[home]: r["n"] for r in counts}
    if any(rows_after.values()):
        cuts, into = laid_out(rows_after, files, table.size)
        rows = [rows_after.get(h, 0) for h in range(files)]
        starts = [0, *accumulate(rows)][:files]
        sort = [home, *ordered(both.select(*cols), key)]
        dirty, placed = ranked(both.where(~F.col(action) & (F.get(literal(cuts), F.col(home)) > 0)).drop(differs, action), sort, rank)
        piece = piece_of(F.col(rank) - F.get(literal(starts), F.col(home)), F.get(literal(rows), F.col(home)), F.get(literal(cuts), F.col(home)))
        name = F.when(piece == 0, F.get(literal(into, "string"), F.col(home))).otherwise(F.format_string(NEW, home, piece))
        write_files(dirty.withColumn(LEVEL, name), cols, sort[1:], sum(cuts), table.path)
        discard(spark, placed)
    discard(spark, kept)
    for h in rows_after:
        discard(spark, f"{table.path}/{LEVEL}={OLD % h}")
    return sorted(rows_after)


def file_digests(spark: SparkSession, table: Table) -> DataFrame:
    """A row for each file that is there: its first key, rows, sums and digest of keys, read back from the file."""
    rows = read_table(spark, table).withColumn("path", F.col("_metadata.file_path"))
    text = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(table.key)), lambda x: x.cast("string")), ",")
    out = rows.groupBy("path", LEVEL).agg(
        F.min(table.key).alias("first_id"), F.count("*").alias("n_rows"), F.sum(F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0))).cast("long").alias("cents"),
        F.sum(F.crc32(text)).alias("rows_crc"), F.sha2(ids, 256).alias("ids_sha256"),
    )
    return out.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(table.schema.names)).alias("columns"), "path", F.col(LEVEL).startswith(NEW[0]).alias("rewritten"))

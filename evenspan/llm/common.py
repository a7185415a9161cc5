"""Helpers shared by the corpus operators: tables in the shared folder, checked broadcasts, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that an operator broadcasts; larger sides are joined by shuffling.
BROADCAST_BYTES = 32 << 20


#: Folder in the shared one that :func:`stored` writes to, by :func:`scope`.
_SCOPES = ["evenspan"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all run on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"/tmp/evenspan-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, folders: list[str]) -> tuple[DataFrame, str]:
    """``df``, written below the folders of the shared one and read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{'/'.join(folders)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and outlives any executor."""
    return written(df, name, _SCOPES)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, by Spark's own means of access."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is stored inside is deleted at the end, so nothing that is used later may read it."""
    _SCOPES.append(f"{name}-{uuid.uuid4().hex}")
    path = f"{shared_dir(spark)}/{'/'.join(_SCOPES)}"
    try:
        yield
    finally:
        _SCOPES.pop()
        discard(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to be none of the table's columns."""
    taken_names, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken_names:
            name = "_" + name
        out.append(name)
    return out


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only where ``rows`` counted rows of at most ``row_bytes`` bytes fit :data:`BROADCAST_BYTES`."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker.
BATCH = 1000


def in_batches(df: DataFrame, of: Callable, schema: Any) -> DataFrame:
    """``df.mapInArrow(of, schema)`` with batches of at most :data:`BATCH` rows, a setting that the session keeps."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df.mapInArrow(of, schema)


def once_a_worker(owner: str, key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, once in the life of a Python worker: code pickled by value has no module to keep it in.

    A worker serves many jobs.  It keeps one thing of a kind (the key's first part), and those of one operator: when
    another one's first thing is made, all others go and their memory is given back.
    """
    kept = sys.__dict__.setdefault("_evenspan_kept", {})
    if kept.get(None) != owner:
        released(kept)
        kept[None] = owner
    if key[0] not in kept or kept[key[0]][0] != key:
        kept.pop(key[0], None)
        kept[key[0]] = key, make()
    return kept[key[0]][1]


def released(kept: dict) -> None:
    kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def taken(shared: Broadcast) -> Any:
    """A broadcast's value, which the worker doesn't hold after that: what is made of it stays instead."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value


def ranked(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, str]:
    """Adds the rank from 0 in the order of the columns: sorted by range, then the partition's offset and the place in it.  Also the folder it is kept in."""
    spark = df.sparkSession
    at = fresh(df, "at")[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt, path = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked", ["evenspan"])
    part, place = F.shiftrightunsigned(at, 33).cast("int"), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # one row for each partition
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return dealt.withColumn(name, F.get(literal(before), part) + place).drop(at), path


def literal(values: list, kind: str = "bigint") -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def fitting(right: DataFrame, row_bytes: Column, weight: str, hot: int) -> int:
    """The least of ``hot``, twice, four times ... that so few rows exceed that they can be broadcast."""
    bounds = [hot << i for i in range(40)]
    over = right.agg(*(F.coalesce(F.sum(F.when(F.col(weight) > b, row_bytes)), F.lit(0)) for b in bounds)).first()
    return next((b for b, n in zip(bounds, over, strict=True) if n <= BROADCAST_BYTES), bounds[-1])


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, row_bytes: int, weight: str, hot: int = 20_000, size: Column | None = None) -> DataFrame:
    """``left`` inner, left or semi joined with ``right``, whose keys are unique and of which ``rows`` were counted.

    A small ``right`` is broadcast.  Else its keys that ``weight`` says have over ``hot`` rows in ``left`` are broadcast,
    and the others are shuffled, so no task gets more rows of a key.  Those keys are counted, and ``hot`` is raised until
    they fit.  Where rows of ``right`` differ in size, ``size`` gives their bytes, and ``rows * row_bytes`` those of all.
    """
    if rows * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    hot = fitting(right, F.lit(row_bytes) if size is None else size, weight, hot)
    few, rest = right.where(F.col(weight) > hot), right.where(F.col(weight) <= hot)
    here = left.join(F.broadcast(few), on, "inner" if how == "left" else how)
    return here.unionByName(left.join(F.broadcast(few.select(*on)), on, "left_anti").join(rest, on, how))


def without(left: DataFrame, right: DataFrame, on: list[str], rows: int, row_bytes: int, weight: str, hot: int = 20_000) -> DataFrame:
    """The rows of ``left`` whose key isn't in ``right``, whose sides are joined as in :func:`hot_join`."""
    if rows * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right.select(*on)), on, "left_anti")
    hot = fitting(right, F.lit(row_bytes), weight, hot)
    few, rest = right.where(F.col(weight) > hot), right.where(F.col(weight) <= hot)
    return left.join(F.broadcast(few.select(*on)), on, "left_anti").join(rest.select(*on), on, "left_anti")

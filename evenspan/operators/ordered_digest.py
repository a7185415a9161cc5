"""One SHA-256 over all rows in an order, equal to hashing them one after the other.

Such a digest is sequential by definition, so what can be shared out is the order and the holding: rows are dealt into
ranges of the order and sorted by many tasks; then the ranges are hashed one after the other, each by a task that starts
from the state that the one before it ended with (112 bytes, which pass through the driver).  No task holds more than a
range, and a lost executor costs one range.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_dir

#: Bytes of the hash's context: chaining value, length, block and places.
CONTEXT = 112


class Chain:
    """SHA-256 whose state can be kept and gone on from; Python's own can't, so the system's library is called."""

    def __init__(self, state: bytes | None = None) -> None:
        import ctypes
        import ctypes.util

        self.lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so")
        self.lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        self.context = ctypes.create_string_buffer(state or bytes(CONTEXT), CONTEXT)
        self.out = ctypes.create_string_buffer(32)
        if state is None:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        copy = Chain(self.state())
        self.lib.SHA256_Final(copy.out, copy.context)
        return copy.out.raw.hex()


def _gone_on(state: bytes, column: int) -> Callable:
    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chain = Chain(state)
        for batch in batches:
            for data in batch.column(column).to_pylist():
                chain.update(data or b"")
        yield pa.RecordBatch.from_arrays([pa.array([chain.state()], pa.binary())], ["state"])

    return of


def ordered_digest(rows: DataFrame, order: list[str], data: str) -> str:
    """The digest of the binary column ``data`` in the order of the columns (equal ones: of the data); nulls add nothing."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, data]
    folder = f"{shared_dir(spark)}/evenspan-digest-{uuid.uuid4().hex}"
    dealt = rows.select(*keys).repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(folder)
    try:
        kept = spark.read.schema(dealt.schema).parquet(folder)
        chain = Chain()
        for (part,) in sorted(kept.select("_range").distinct().collect()):  # one for each range
            one = kept.where(F.col("_range") == part).select(*keys).coalesce(1).sortWithinPartitions(*keys)
            chain = Chain(bytes(one.mapInArrow(_gone_on(chain.state(), len(order)), "state binary").first()[0]))
        return chain.hexdigest()
    finally:
        delete(spark, folder)


def source_tree_receipt(inventory: DataFrame) -> dict:
    """The digest over path NUL digest LF of all files (path, sha256), by path, and their number."""
    line = F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.encode("sha256", "UTF-8"), F.unhex(F.lit("0A")))
    rows = inventory.select(F.encode("path", "UTF-8").alias("k"), line.alias("line"))
    return {"algorithm": "sha256(path NUL file_sha256 LF)", "source_tree_sha256": ordered_digest(rows, ["k"], "line"), "files": inventory.count()}


def tensor_digest(tensors: DataFrame, pieces: DataFrame) -> str:
    """The digest over name, type, shape and bytes of tensors (name, dtype, shape) by name; ``pieces`` (name, i, data) hold the bytes in order."""
    head = F.encode(F.concat("name", "dtype", "shape"), "UTF-8")
    rows = tensors.select("name", F.lit(-1).cast("long").alias("i"), head.alias("data")).unionByName(pieces.select("name", F.col("i").cast("long").alias("i"), "data"))
    return ordered_digest(rows.select(F.encode("name", "UTF-8").alias("k"), "i", "data"), ["k", "i"], "data")

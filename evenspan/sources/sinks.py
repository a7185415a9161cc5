"""Sinks: Parquet, JSON lines, CSV, receipts, and manifests by split."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Compressed with zstd; an existing table is an error."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with sorted keys, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named fields with a header; missing values are empty."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields)).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_json(value: Any, path: str) -> None:
    """A small document on the driver, replaced as a whole."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True) + "\n")
    os.replace(f.name, path)


def canonical_digest(value: Any, ascii_only: bool = True) -> str:
    """Digest of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only).encode()).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """rows and a digest that doesn't depend on the order of rows: the sum of their 64-bit hashes."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def split_receipt(df: DataFrame, events: str) -> DataFrame:
    """Per split: samples and events, as a manifest records them."""
    return df.groupBy("split").agg(F.count("*").alias("samples"), F.sum(events).alias("events"))


def write_manifest(df: DataFrame, path: str, events: str) -> list[dict]:
    """The samples by split, and the receipt of what was written, read back."""
    write_parquet(df, path, ["split"])
    rows = split_receipt(df.sparkSession.read.parquet(path), events).collect()  # one row for each split
    return sorted((r.asDict() for r in rows), key=lambda r: r["split"])


def markdown_table(df: DataFrame, columns: list[str], digits: int = 5, most: int = 1000) -> str:
    """A report of at most ``most`` rows."""
    rows = df.select(*columns).limit(most).collect()
    shown = [[f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *shown])

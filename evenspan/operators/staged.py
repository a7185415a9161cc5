"""Builds of several tables in stages that are published at once and go on after the last stage that ended.

A build's folder is named by a digest of what it is made from, so another input or configuration never meets its
tables.  A stage writes its tables, reads them back, counts and digests them, and then leaves a receipt, which is created
once; a stage whose receipt is there is read and not run.  Publishing writes the manifest of all receipts, and then
replaces one small file that names it.  Until that moment readers see the former build, after it the new one, and never
parts of both.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.sinks import canonical_digest, content_digest

POINTER = "CURRENT"
Tables = dict[str, DataFrame]


class StagedBuild:
    def __init__(self, spark: SparkSession, root: str, made_from: dict) -> None:
        self.spark, self.root, self.made_from = spark, root.rstrip("/"), made_from
        self.key = canonical_digest(made_from)[:24]
        self.folder = f"{self.root}/builds/{self.key}"
        self.receipts: dict[str, dict] = {}
        self.ran: list[str] = []

    def stage(self, name: str, make: Callable[[], Tables]) -> Tables:
        """The tables of a stage, made and written unless its receipt is there.  What a run that died has left of it is overwritten."""
        at = f"{self.folder}/{name}"
        if not shared.exists(self.spark, f"{at}.json"):
            receipt = {}
            for table, df in make().items():
                df.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{table}")
                back = self.spark.read.parquet(f"{at}/{table}")
                rows, digest = content_digest(back).first()
                receipt[table] = {"rows": rows, "digest": str(digest), "schema": back.schema.simpleString()}
            shared.create(self.spark, f"{at}.json", json.dumps(receipt, sort_keys=True))
            self.ran.append(name)
        self.receipts[name] = json.loads(shared.read_text(self.spark, f"{at}.json"))
        return {table: self.spark.read.parquet(f"{at}/{table}") for table in self.receipts[name]}

    def publish(self, extra: dict | None = None) -> dict:
        """Write the manifest and make it the current one."""
        manifest = {"made_from": self.made_from, "build": self.key, "stages": self.receipts, **(extra or {})}
        manifest["digest"] = canonical_digest(manifest)
        shared.replace(self.spark, f"{self.folder}/manifest.json", json.dumps(manifest, sort_keys=True, indent=2))
        shared.replace(self.spark, f"{self.root}/{POINTER}", json.dumps({"build": self.key, "digest": manifest["digest"]}))
        return manifest


def current(spark: SparkSession, root: str) -> dict:
    """The manifest that is published; one that isn't the one it was published as is an error."""
    root = root.rstrip("/")
    pointer = json.loads(shared.read_text(spark, f"{root}/{POINTER}"))
    manifest = json.loads(shared.read_text(spark, f"{root}/builds/{pointer['build']}/manifest.json"))
    body = {k: v for k, v in manifest.items() if k != "digest"}
    if not manifest["digest"] == pointer["digest"] == canonical_digest(body):
        raise ValueError("the manifest isn't the one that was published")
    return manifest


def published(spark: SparkSession, root: str, table: str, verify: bool = False) -> DataFrame:
    """A table of the published build; with ``verify``, one whose rows aren't those of its receipt is an error."""
    manifest = current(spark, root)
    for stage, tables in manifest["stages"].items():
        if table in tables:
            df = spark.read.parquet(f"{root.rstrip('/')}/builds/{manifest['build']}/{stage}/{table}")
            if verify:
                rows, digest = content_digest(df).first()
                if (rows, str(digest)) != (tables[table]["rows"], tables[table]["digest"]):
                    raise ValueError(f"{table} has changed since it was published")
            return df
    raise KeyError(table)


def inventory_digest(files: DataFrame) -> str:
    """One digest of the files (path, sha256) that a build starts from, in any order."""
    rows, digest = content_digest(files.select(F.col("path").cast("string").alias("path"), "sha256")).first()
    return f"{rows}:{digest}"

"""Manifests, receipts and the guard around test rows."""

from __future__ import annotations

import json
import re
import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared


class SealedError(PermissionError):
    """Test rows were asked for too early, or again."""


class Firewall:
    """Test rows can be read once, and only after the validation choice was locked; denied reads count too."""

    def __init__(self) -> None:
        self.locked, self.reads, self.denied = False, 0, 0

    def lock_validation(self) -> None:
        self.locked = True

    def training(self, df: DataFrame, split: str) -> DataFrame:
        if split == "test":
            self.denied += 1
            raise SealedError("training can't read the test split")
        return df.where(F.col("split") == split)

    def read_test_once(self, df: DataFrame) -> DataFrame:
        self.reads += 1
        if not self.locked or self.reads > 1:
            self.denied += 1
            raise SealedError("the test split is sealed")
        return df.where("split = 'test'")


class DurableFirewall:
    """The same guard for all processes that share a folder: what was locked, read and denied is there, not in one of them.

    The validation choice and the one read of the test rows are files that are created once, so of several processes
    that ask at the same time one gets the rows.  Every access, denied ones too, is a file of its own that is never
    changed: the ledger can be read while others write it.
    """

    LOCK, READ = "validation_lock.json", "test_read.json"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, action: str, granted: bool, detail: dict) -> dict:
        entry = {"id": uuid.uuid4().hex, "at": time.time_ns(), "action": action, "granted": granted, "detail": json.dumps(detail, sort_keys=True)}
        shared.create(self.spark, f"{self.folder}/access/{entry['at']:020d}-{entry['id']}.json", json.dumps(entry))
        return entry

    def lock_validation(self, choice: dict) -> None:
        """Lock the choice; the same one again is no change, another one is an error."""
        text, path = json.dumps(choice, sort_keys=True), f"{self.folder}/{self.LOCK}"
        won = shared.create(self.spark, path, text) or shared.read_text(self.spark, path) == text
        self._log("lock", won, choice)
        if not won:
            raise SealedError("another validation choice is locked")

    def locked(self) -> dict | None:
        path = f"{self.folder}/{self.LOCK}"
        return json.loads(shared.read_text(self.spark, path)) if shared.exists(self.spark, path) else None

    def training(self, df: DataFrame, split: str) -> DataFrame:
        if split == "test":
            self._log("training", False, {"split": split})
            raise SealedError("training can't read the test split")
        return df.where(F.col("split") == split)

    def read_test_once(self, df: DataFrame, who: str) -> DataFrame:
        """The test rows, once in the life of the folder and only after the lock."""
        detail = {"who": who, "locked": self.locked()}
        granted = detail["locked"] is not None and shared.create(self.spark, f"{self.folder}/{self.READ}", json.dumps(detail, sort_keys=True))
        self._log("test", granted, detail)
        if not granted:
            raise SealedError("the test split is sealed" if detail["locked"] is None else "the test split was read before")
        return df.where("split = 'test'")

    def ledger(self) -> DataFrame:
        """id, at, action, granted, detail of every access so far, in order."""
        return self.spark.read.schema("id string, at long, action string, granted boolean, detail string").json(f"{self.folder}/access").orderBy("at", "id")


class Manifest:
    """A table of samples by split; test rows need a flag, audits a purpose."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.audits = spark, path, []

    def entries(self, split: str, allow_test: bool = False) -> DataFrame:
        if split == "test" and not allow_test:
            raise SealedError("reading the test split needs allow_test")
        return self.spark.read.parquet(self.path).where(F.col("split") == split)

    def audit(self, split: str, purpose: str) -> DataFrame:
        if not purpose:
            raise ValueError("an audit needs a purpose")
        self.audits.append((split, purpose))
        return self.entries(split, allow_test=True)


def manifest_faults(rows: DataFrame, sample: str, relations: list[str], split: str = "split") -> DataFrame:
    """kind, key, n: samples listed more than once, and values of relations in more than one split."""
    repeated = rows.groupBy(sample).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("sample").alias("kind"), F.col(sample).cast("string").alias("key"), "n")
    out = repeated
    for r in relations:
        bad = rows.where(F.col(r).isNotNull()).groupBy(r).agg(F.count_distinct(split).alias("n")).where("n > 1")
        out = out.unionByName(bad.select(F.lit(r).alias("kind"), F.col(r).cast("string").alias("key"), "n"))
    return out


def receipt_faults(given: DataFrame, found: DataFrame) -> DataFrame:
    """name, status: receipts (name, digest, value) against what is there: MISSING, DIGEST, VALUE (off by more than 1e-12) or PASS."""
    both = given.alias("g").join(found.alias("f"), "name", "left")
    status = F.when(F.col("f.digest").isNull(), "MISSING").when(F.col("f.digest") != F.col("g.digest"), "DIGEST").when(F.abs(F.col("f.value") - F.col("g.value")) > 1e-12, "VALUE").otherwise("PASS")
    return both.select("name", status.alias("status"))


def result_index(ledgers: dict[str, DataFrame], leave_out: list[tuple[str, str]]) -> DataFrame:
    """All ledgers (arm, seed, bits) under their names but for the left-out (name, arm), with an id, in order."""
    out = None
    for name, df in ledgers.items():
        part = df.select(F.lit(name).alias("ledger"), "arm", "seed", "bits", F.concat_ws("-", F.lit(name), "arm", F.col("seed").cast("string")).alias("id"))
        for n, arm in leave_out:
            part = part.where(F.col("arm") != arm) if n == name else part
        out = part if out is None else out.unionByName(part)
    return out.orderBy("ledger", "arm", "seed")


def single(index: DataFrame, keys: dict) -> dict:
    """The one row with these values; none or several are an error."""
    rows = index
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise LookupError(f"{len(got)} rows for {keys}")
    return got[0].asDict()


def public_manifest(rows: DataFrame, splits: DataFrame, prefix: str) -> DataFrame:
    """Paths without their prefix, the split of the song (``excluded`` where it has none), and the lesser of two margins."""
    out = rows.join(splits, "song_id", "left")
    path = F.regexp_replace("path", f"^{prefix}", "")
    return out.select("song_id", path.alias("path"), F.coalesce("split", F.lit("excluded")).alias("split"), F.least("margin_a", "margin_b").alias("margin"))


def curves(history: DataFrame, least_epoch: int = 100) -> DataFrame:
    """Per arm and seed: points from ``least_epoch`` on, scaled to 0..1 over all of them, for drawing."""
    rows = history.where(F.col("epoch") >= least_epoch)
    lo, hi, e0, e1 = rows.agg(F.coalesce(F.min("bits"), F.lit(0.0)), F.coalesce(F.max("bits"), F.lit(0.0)), F.coalesce(F.min("epoch"), F.lit(0)), F.coalesce(F.max("epoch"), F.lit(0))).first()
    return rows.select("arm", "seed", "epoch", ((F.col("epoch") - e0) / max(e1 - e0, 1)).alias("x"), ((F.col("bits") - lo) / max(hi - lo, 1e-12)).alias("y"))


def svg_panel(points: list[tuple[float, float]], title: str, width: int = 240, height: int = 120) -> str:
    """A small line chart of scaled points."""
    path = " ".join(f"{x * width:.1f},{(1 - y) * height:.1f}" for x, y in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{title}</title><polyline fill="none" stroke="#333" points="{path}"/></svg>'


# Keys that name people and machines, roots of local paths, and what stands for a value.
IDENTITY_KEYS = ("account", "cluster", "host", "hostname", "node", "slurm_account", "user", "username")
LOCAL_PATH = r"(?i)(?:[a-z]:[\\/]|/(?:data|home|mnt|scratch|workspace)/)"
MARKS = {"identity": "<REDACTED_INFRASTRUCTURE_IDENTITY>", "path": "<REDACTED_ABSOLUTE_PATH>", "contact": "<REDACTED_CONTACT_OR_LOGIN>"}


def redacted(text: Column, keys: tuple[str, ...] = IDENTITY_KEYS) -> Column:
    """clean, changed, fault: JSON text with its strings replaced where they stand below an identity key (also in lists there),
    are absolute paths, or have an at sign and are no web address; and the JSON pointers of those.  A text that is no JSON, or
    is nested too deeply to be read, has a fault and no clean form."""
    schema, local, named = "clean string, changed array<string>, fault string", re.compile(LOCAL_PATH), frozenset(keys)

    def mark(key: str, value: str) -> str | None:
        if key in named:
            return MARKS["identity"]
        if local.match(value):
            return MARKS["path"]
        return MARKS["contact"] if "@" in value and not value.startswith(("http://", "https://")) else None

    def walked(raw: str | None) -> dict:
        try:
            whole = [json.loads(raw)]
        except (TypeError, ValueError, RecursionError) as e:
            return {"clean": None, "changed": None, "fault": None if raw is None else type(e).__name__}
        changed, open_ = [], [(whole, 0, "", "")]  # a container, a place in it, the key above and the pointer
        while open_:
            holder, at, key, pointer = open_.pop()
            value = holder[at]
            if isinstance(value, dict):
                open_ += [(value, k, k.lower(), f"{pointer}/{k}") for k in reversed(value)]
            elif isinstance(value, list):
                open_ += [(value, k, key, f"{pointer}/{k}") for k in reversed(range(len(value)))]
            elif isinstance(value, str) and (found := mark(key, value)):
                holder[at] = found
                changed.append(pointer)
        try:
            return {"clean": json.dumps(whole[0], separators=(",", ":"), ensure_ascii=False), "changed": changed, "fault": None}
        except RecursionError as e:
            return {"clean": None, "changed": None, "fault": type(e).__name__}

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walked(x) for x in texts], columns=["clean", "changed", "fault"])

    return of(text)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")

"""Commands over the operators: ``python -m evenspan.cli smoke | select | evaluate | sealed-test | build | data | audit | show``."""

from __future__ import annotations

import argparse
import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bpe, carrier, corpus_build, events, governance, ledger, lineage, relations, validate
from .sources import readers, shared

#: Relations of a dataset that may not cross splits.
UNCROSSED = {"commu": ["lineage_id", "exact_hash", "transposition_invariant_hash"], "pop1k7": ["lineage_id", *corpus_build.RELATIONS]}


def synthetic_train(steps: int, seed: int = 0, rate: float = 0.05) -> list[float]:
    """Losses of gradient descent on a least-squares problem of 64 rows and 4 columns."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(64, 4))
    y = x @ rng.normal(size=4)
    w, out = np.zeros(4), []
    for _ in range(steps):
        error = x @ w - y
        out.append(float((error**2).mean()))
        w -= rate * 2 * x.T @ error / len(y)
    return out


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def smoke(spark: SparkSession, steps: int = 8) -> dict:
    """Round trips of the codec, the token form and the merges, the ledger's sums, and a training that must get better."""
    rows = [(1, "NOTE", 0, 96, 60), (1, "NOTE", 96, 48, 64), (1, "NOTE", 480, 384, 67), (2, "NOTE", 10, 5, 0), (2, "NOTE", 10, 5, 127)]
    facts = events.insert_rests(spark.createDataFrame(rows, "song_id long, event_type string, onset long, duration long, pitch int"))
    symbols = spark.createDataFrame([(1, list("abababc")), (2, list("abab"))], "song_id long, symbols array<string>")
    rules = [(a, b) for a, b, _ in bpe.fit(symbols, 2)]
    back = symbols.select("song_id", bpe.decoded(bpe.encoded(F.col("symbols"), rules)).alias("symbols"))
    entry = spark.createDataFrame([("x", 2, 1.0, 2.0, 3.0, 0.0, 1.0, 1.0)], "arm string, facts int, time double, pitch double, duration double, kind double, eos double, side double")
    losses = synthetic_train(steps)
    checks = {
        "codec": _same(facts, carrier.from_json(carrier.to_json(facts)).select(*facts.columns)),
        "carrier": _same(facts, carrier.deserialize(carrier.serialize(facts)).select(*facts.columns)),
        "merges": _same(symbols, back),
        "ledger": ledger.ledger(entry, ["arm"]).first()["bits_per_fact"] == 4.0,
        "training": losses[-1] < losses[0],
    }
    return checks | {"status": "PASS" if all(checks.values()) else "FAIL"}


def audit(found: DataFrame, required: list[str]) -> dict:
    """Crossing counts (field, crossing) must be there for all required fields, and be zero."""
    have = {r["field"]: r["crossing"] for r in found.where(F.col("field").isin(required)).collect()}
    sound = all(have.get(f) == 0 for f in required)
    return {"status": "PASS" if sound else "FAIL", "crossing": have, "absent": sorted(set(required) - set(have))}


def select(history: str) -> dict:
    """The validation choice from a JSON list, an object that holds one, or JSON lines; fields go by either of their names."""
    try:
        value = json.loads(history)
        rows = value if isinstance(value, list) else value.get("validation_history", value.get("rows", [value]))
    except json.JSONDecodeError:
        rows = [json.loads(line) for line in history.splitlines() if line.strip()]
    found = [{"path": r.get("checkpoint_path"), "bits": float(r.get("bits_per_declared_fact", r.get("bits"))), "exposure": int(r.get("completed_target_exposures", r.get("exposure")))} for r in rows]
    best = min(r["bits"] for r in found)
    return min((r for r in found if r["bits"] <= best + 1e-12), key=lambda r: r["exposure"])


def evaluate(spark: SparkSession, index: DataFrame, arm: str, seed: int, split: str, lock: str | None, checkpoint: str | None) -> dict:
    """The one indexed result of arm and seed; for the test split only with a lock, and only for the indexed checkpoint."""
    if split == "test" and (lock is None or not shared.exists(spark, lock)):
        raise governance.SealedError("evaluating the test split needs a validation lock")
    row = governance.single(index, {"arm": arm, "seed": seed})
    if checkpoint is not None:
        digest = readers.file_inventory(spark, checkpoint).first()["sha256"]
        if digest != row.get("checkpoint_sha256"):
            raise ValueError("the checkpoint isn't the indexed one")
    return row | {"split": split}


def data_audit(rows: DataFrame, dataset: str) -> dict:
    """Whether the dataset's relations are there and none of their values is in two splits."""
    required = UNCROSSED[dataset]
    there = [f for f in required if f in rows.columns]
    full = rows.agg(*(F.count(f).alias(f) for f in there), F.count("*").alias("_rows")).first().asDict()
    there = [f for f in there if full[f]]
    counts = {r["field"]: r["crossing"] for r in lineage.crossings(rows, there).collect()} if there else {}
    sound = there == required and not any(counts.values())
    return {"status": "PASS" if sound else "FAIL", "dataset": dataset, "rows": full["_rows"], "absent": sorted(set(required) - set(there)), "crossing": counts}


def sealed_test(spark: SparkSession, folder: str, manifest: str, who: str) -> dict:
    """Read the test rows, once for all processes."""
    guard = governance.DurableFirewall(spark, folder)
    rows = guard.read_test_once(spark.read.json(manifest), who).count()
    return {"status": "PASS", "rows_read": rows, "accesses": guard.ledger().count(), "checkpoint_updates": 0, "merge_updates": 0}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evenspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("smoke").add_argument("--steps", type=int, default=8)
    one = commands.add_parser("select")
    one.add_argument("--history", required=True, help="JSON lines of exposure and bits")
    one = commands.add_parser("evaluate")
    one.add_argument("--index", required=True, help="Parquet with arm and seed")
    one.add_argument("--arm", required=True)
    one.add_argument("--seed", type=int, required=True)
    one.add_argument("--split", default="validation", choices=("validation", "test"))
    one.add_argument("--validation-lock")
    one.add_argument("--checkpoint")
    one = commands.add_parser("sealed-test")
    one.add_argument("--folder", required=True, help="shared folder of locks and the access ledger")
    one.add_argument("--manifest", required=True, help="JSON lines with split")
    one.add_argument("--who", required=True)
    one = commands.add_parser("build")
    one.add_argument("--files", required=True, help="folder of MIDI files")
    one.add_argument("--out", required=True)
    for name in ("validation", "test", "old-holdout", "seed"):
        one.add_argument(f"--{name}", type=int, default=0)
    data = commands.add_parser("data").add_subparsers(dest="step", required=True)
    one = data.add_parser("audit")
    one.add_argument("dataset", choices=sorted(UNCROSSED))
    one.add_argument("--manifest", required=True, help="JSON lines")
    one = data.add_parser("prepare")
    one.add_argument("--root", required=True)
    one.add_argument("--source-manifest", required=True, help="JSON lines of path and sha256")
    one = commands.add_parser("audit")
    one.add_argument("--crossings", required=True, help="Parquet with field and crossing")
    one.add_argument("--fields", nargs="+", required=True)
    commands.add_parser("show").add_argument("arm")
    args = parser.parse_args(argv)
    if args.command == "show":
        result = validate.representation(args.arm)
    else:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "smoke":
            result = smoke(spark, args.steps)
        elif args.command == "select":
            result = select(shared.read_text(spark, args.history))
        elif args.command == "evaluate":
            result = evaluate(spark, spark.read.parquet(args.index), args.arm, args.seed, args.split, args.validation_lock, args.checkpoint)
        elif args.command == "sealed-test":
            result = sealed_test(spark, args.folder, args.manifest, args.who)
        elif args.command == "build":
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mid*").option("recursiveFileLookup", "true").load(args.files).select("path", "content")
            result = corpus_build.build(spark, files, args.out, validation=args.validation, test=args.test, old_holdout=args.old_holdout, seed=args.seed)
        elif args.command == "data" and args.step == "audit":
            result = data_audit(spark.read.json(args.manifest), args.dataset)
        elif args.command == "data":
            found = readers.file_inventory(spark, args.root).withColumn("path", readers.relative_path(F.regexp_replace("path", "^file:/+", "/"), args.root.rstrip("/") + "/"))
            result = relations.verify_sources(spark.read.json(args.source_manifest), found).first().asDict()
            result["status"] = "FAIL" if result["missing"] or result["mismatched"] else "PASS"
        else:
            result = audit(spark.read.parquet(args.crossings), args.fields)
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return int(result.get("status") == "FAIL")


if __name__ == "__main__":
    sys.exit(main())

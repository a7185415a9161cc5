"""Locks and the access ledger are the folder's, not a process's; commands over them."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from evenspan import cli
from evenspan.operators import governance

WORKER = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from evenspan.operators import governance
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
guard = governance.DurableFirewall(spark, {folder!r})
rows = spark.createDataFrame([("a", "test"), ("b", "train")], "id string, split string")
try:
    print("READ", guard.read_test_once(rows, sys.argv[1]).count())
except governance.SealedError as e:
    print("DENIED", e)
"""


def test_two_processes_one_read(spark, tmp_path):
    folder = f"{tmp_path}/guard"
    code = WORKER.format(repo=__file__.rsplit("/tests/", 1)[0], folder=folder)

    def start(who):
        return subprocess.Popen([sys.executable, "-c", code, who], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)

    early = start("early").communicate(timeout=120)[0]
    assert "DENIED the test split is sealed" in early
    guard = governance.DurableFirewall(spark, folder)
    guard.lock_validation({"checkpoint": "c1", "bits": 2.5})
    guard.lock_validation({"bits": 2.5, "checkpoint": "c1"})
    with pytest.raises(governance.SealedError):
        guard.lock_validation({"checkpoint": "c2"})
    with pytest.raises(governance.SealedError):
        guard.training(spark.range(1), "test")
    both = [p.communicate(timeout=120)[0].strip() for p in [start("x"), start("y")]]
    assert sorted(x.split()[0] for x in both) == ["DENIED", "READ"] and "READ 1" in both
    log = guard.ledger().collect()
    assert [(r["action"], r["granted"]) for r in log[:5]] == [("test", False), ("lock", True), ("lock", True), ("lock", False), ("training", False)]
    assert sorted(r["granted"] for r in log[5:]) == [False, True] and len({r["id"] for r in log}) == 7


def jsonl(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_sealed_test_command(spark, tmp_path, capsys):
    manifest = jsonl(tmp_path / "m.jsonl", [{"id": 1, "split": "test"}, {"id": 2, "split": "train"}])
    with pytest.raises(governance.SealedError):
        cli.sealed_test(spark, str(tmp_path / "g"), manifest, "me")
    governance.DurableFirewall(spark, str(tmp_path / "g")).lock_validation({"c": 1})
    assert cli.sealed_test(spark, str(tmp_path / "g"), manifest, "me")["rows_read"] == 1
    with pytest.raises(governance.SealedError):
        cli.sealed_test(spark, str(tmp_path / "g"), manifest, "me again")


def test_evaluate_needs_lock_and_the_indexed_checkpoint(spark, tmp_path):
    import hashlib

    (tmp_path / "c.pt").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest()
    index = spark.createDataFrame([("A", 1, digest), ("A", 2, "0" * 64), ("B", 1, digest), ("B", 1, digest)], "arm string, seed int, checkpoint_sha256 string")
    got = cli.evaluate(spark, index, "A", 1, "validation", None, str(tmp_path / "c.pt"))
    assert got == {"arm": "A", "seed": 1, "checkpoint_sha256": digest, "split": "validation"}
    with pytest.raises(ValueError):
        cli.evaluate(spark, index, "A", 2, "validation", None, str(tmp_path / "c.pt"))
    with pytest.raises(LookupError):
        cli.evaluate(spark, index, "B", 1, "validation", None, None)
    with pytest.raises(PermissionError):
        cli.evaluate(spark, index, "A", 1, "test", str(tmp_path / "none.json"), None)
    (tmp_path / "lock.json").write_text("{}")
    assert cli.evaluate(spark, index, "A", 1, "test", str(tmp_path / "lock.json"), None)["split"] == "test"


def test_select_takes_lists_objects_and_lines():
    rows = [{"checkpoint_path": "a", "bits_per_declared_fact": 2.0, "completed_target_exposures": 9}, {"checkpoint_path": "b", "bits": 2.0, "exposure": 5}, {"checkpoint_path": "c", "bits": 3.0, "exposure": 1}]
    for text in (json.dumps(rows), json.dumps({"validation_history": rows}), json.dumps({"rows": rows}), "\n".join(map(json.dumps, rows))):
        assert cli.select(text) == {"path": "b", "bits": 2.0, "exposure": 5}


def test_data_audit(spark):
    rows = [("train", "a", "x", "t", "r"), ("train", "a", "x", "t", "r"), ("test", "b", "y", "u", "s")]
    df = spark.createDataFrame(rows, "split string, lineage_id string, exact_hash string, transposition_invariant_hash string, rhythm_interval_hash string")
    assert cli.data_audit(df, "pop1k7")["status"] == cli.data_audit(df, "commu")["status"] == "PASS"
    assert cli.data_audit(df.drop("rhythm_interval_hash"), "pop1k7") == {"status": "FAIL", "dataset": "pop1k7", "rows": 3, "absent": ["rhythm_interval_hash"], "crossing": {"lineage_id": 0, "exact_hash": 0, "transposition_invariant_hash": 0}}
    assert cli.data_audit(df.withColumn("exact_hash", F.lit("same")), "commu")["crossing"]["exact_hash"] == 1
    assert cli.data_audit(df.withColumn("rhythm_interval_hash", F.lit(None).cast("string")), "pop1k7")["absent"] == ["rhythm_interval_hash"]


def test_broken_json_is_a_fault_of_its_row(spark):
    rows = spark.createDataFrame([("[" * 200_000 + "]" * 200_000,), ("no json",), (None,), ('{"user": "me"}',)], "t string")
    got = [r["r"] for r in rows.select(governance.redacted(F.col("t")).alias("r")).collect()]
    assert [g["fault"] for g in got] == ["RecursionError", "JSONDecodeError", None, None]
    assert [g["changed"] for g in got] == [None, None, None, ["/user"]]

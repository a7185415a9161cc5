"""Work on lineage grows with the notes and the different samples: one shuffle of notes, classes instead of copies, one pass over values."""

import hashlib
import random

from pyspark.sql import functions as F

from evenspan.operators import lineage


def shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning"), plan


def test_notes_are_dealt_once(spark):
    rows = [(s, "NOTE", 96 * i + s, 1 + (i * s) % 50, 40 + (7 * i + s) % 30) for s in range(20) for i in range(9)]
    facts = spark.createDataFrame(rows, "song_id long, event_type string, onset long, duration long, pitch int")
    n, plan = shuffles(lineage.line_hashes(facts))
    assert n == 1 and "Join" not in plan


def test_copies_are_one_class(spark, monkeypatch):
    held = []
    kept = lineage.checkpointed

    def counted(df):
        df = kept(df)
        held.append(df.count())
        return df

    monkeypatch.setattr(lineage, "checkpointed", counted)
    rows = [(i, "x" if i % 2 else "y", "z" if i < 300 else "w") for i in range(400)] + [(1000, None, None), (1001, None, None), (1002, "x", None)]
    got = {r["song_id"]: r["root"] for r in lineage.components(spark.createDataFrame(rows, "song_id long, a string, b string"), ["a", "b"]).collect()}
    assert got == {**{i: 0 for i in range(400)}, 1000: 1000, 1001: 1001, 1002: 0}
    assert max(held) < 20


def test_values_are_grouped_once(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split"), (F.col("id") % 40).cast("string").alias("x"), F.col("id").cast("string").alias("y"))
    n, plan = shuffles(lineage.crossing_report(rows, ["x", "y"]))
    assert "ReusedExchange" in plan or n == 2


def test_lines_are_made_note_by_note(spark):
    rows = [(s, "NOTE", 96 * (i // 2), 1 + (i * s) % 50, 40 + (7 * i + s) % 30) for s in range(20) for i in range(9)]
    facts = spark.createDataFrame(rows, "song_id long, event_type string, onset long, duration long, pitch int")
    _, plan = shuffles(lineage.line_hashes(facts))
    assert "lambda" not in plan  # these are interpreted, for each element of a chord
    assert plan.count("\n") and sum(line.lstrip(" +-:*(0123456789)").startswith("Sort ") for line in plan.splitlines()) == 1


def test_families_count_each_sample_once(spark):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *(f"v{i}" for i in range(n))])
    rows = [(i, some(60), some(900)) for i in range(300)] + [(400, None, None), (None, "v0", "v1"), (401, "one", "two"), (401, "one", "two")]
    root = {i: i for i, _, _ in rows if i is not None}
    moved = True
    while moved:
        moved = False
        for at in (1, 2):
            least = {}
            for r in rows:
                if r[0] is not None and r[at] is not None:
                    least[r[at]] = min(least.get(r[at], root[r[0]]), root[r[0]])
            for r in rows:
                if r[0] is not None and r[at] is not None and least[r[at]] < root[r[0]]:
                    root[r[0]], moved = least[r[at]], True
    want = {}
    for r in rows:
        if r[0] is not None:
            want.setdefault(root[r[0]], []).append(r)
    got = lineage.families(spark.createDataFrame(rows, "song_id long, a string, b string"), ["a", "b"]).collect()
    assert len(got) == len(want)
    for f in got:
        held = want[f["root"]]
        text = "\n".join(sorted(str(r[0]) for r in held)) + "\n"
        reasons = [n for n, at in (("a", 1), ("b", 2)) if len({r[at] for r in held} - {None}) < len(held)]
        assert (f["sample_count"], f["reasons"]) == (len(held), ",".join(reasons))
        assert f["lineage_id"] == "family_" + hashlib.sha256(text.encode()).hexdigest()[:24]

"""Encoding with fitted merges reads the events once, and counting pairs is done once."""

from evenspan.operators import bpe, merge_fit
from evenspan.plans import token_queries


def test_symbols_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(bpe, "fit", lambda rows, merges: [("p0", "p1", 2)])
    df = token_queries.bpe_roundtrip(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "events" not in plan


def test_pairs_are_not_dealt_by_sampled_ranges(spark, monkeypatch):
    plans, kept = {}, merge_fit.MergeIndex._kept

    def seen(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return kept(self, df, name)

    monkeypatch.setattr(merge_fit.MergeIndex, "_kept", seen)
    rows = spark.createDataFrame([(i, ["a", "b", "a", "b", "c"]) for i in range(9)], "song_id int, symbols array<string>")
    index = merge_fit.MergeIndex(rows)
    got = {tuple(r) for r in index.counts().collect()}
    index.close()
    assert got == {("a", "b", 18, 9), ("b", "a", 9, 9), ("b", "c", 9, 9)}
    assert "rangepartitioning" not in plans["index"]

"""Tokens become events within a song's array: no token is a row that is shuffled, sorted or windowed."""

import pytest
from pyspark.sql import functions as F

from evenspan.operators import carrier


def event(p, c, b, r):
    return [f"POSITION_{p}", c, f"DURATION_BAR_{b}", f"DURATION_REMAINDER_{r}"]


def table(spark, *songs):
    return spark.createDataFrame(list(enumerate(songs)), "song_id int, tokens array<string>")


def test_events_come_without_shuffles_or_sorts(spark):
    a = ["BAR_ADVANCE"]
    df = carrier.deserialize(table(spark, a * 2 + event(5, "PITCH_60", 0, 7) + event(9, "REST", 1, 3) + a + event(0, "PITCH_1", 0, 1) + a, a * 3, [], None))
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == [(0, "NOTE", 773, 7, 60), (0, "NOTE", 1152, 1, 1), (0, "REST", 777, 387, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate"))


@pytest.mark.parametrize("tokens", [event(1, "REST", 0, 1)[:3], event(1, "REST", 0, 1)[:2] + ["BAR_ADVANCE"] + event(1, "REST", 0, 1)[2:], event(1, "PITCH_x", 0, 1), ["REST", *event(1, "REST", 0, 1)]])
def test_broken_orders_are_errors(spark, tokens):
    with pytest.raises(Exception, match="malformed"):
        carrier.deserialize(table(spark, tokens)).select(F.sum("onset")).collect()

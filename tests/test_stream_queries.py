"""Queries over streams give what SQL gives in whatever order the files of the events come, and pass nothing through the driver."""

import os

import duckdb
import pandas as pd
import pytest

from evenspan.operators import ledger
from evenspan.plans import registry
from evenspan.streaming import rests


@pytest.fixture(scope="module")
def reversed_events(tmp_path_factory):
    """Events in three files, of which the last in time come first."""
    root = tmp_path_factory.mktemp("events")
    folder = root / "events.parquet"
    folder.mkdir()
    for i in range(3):
        at = f"{folder}/part-{i}.parquet"
        duckdb.sql(f"COPY (SELECT * REPLACE (user_id % 5 AS user_id) FROM '/root/testdata/sf0.001/events.parquet' QUALIFY ntile(3) OVER (ORDER BY ts DESC) = {i + 1}) TO '{at}'")
        os.utime(at, (1_700_000_000 + 100 * i,) * 2)
    return str(root)


@pytest.mark.parametrize("name", ["streaming_rests", "streaming_sessions", "streaming_windows"])
def test_files_in_any_order(spark, reversed_events, name):
    got = registry.queries()[name](spark, reversed_events)
    assert "parquet" in got._jdf.queryExecution().analyzed().toString() and got.inputFiles()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{reversed_events}/events.parquet/*.parquet'")
        want = c.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (got.toPandas(), want))
    assert len(a) and a.equals(b)


class Held:
    """State of one key in memory that counts how often it is read as a whole."""

    def __init__(self):
        self.rows, self.reads, self.timers = None, 0, set()

    def getValueState(self, *_):
        return Held()

    def getListState(self, *_):
        self.list = Held()
        return self.list

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return self.rows

    def appendValue(self, row):
        self.rows = [*(self.rows or []), row]

    def appendList(self, rows):
        self.rows = [*(self.rows or []), *rows]

    def put(self, rows):
        self.rows = rows

    update = put

    def clear(self):
        self.rows = None

    def registerTimer(self, t):
        self.timers.add(t)

    def listTimers(self):
        return list(self.timers)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.at


def test_waiting_facts_are_read_once_a_watermark():
    n, h = 300, Held()
    state = rests.Rests(1000)
    state.init(h)
    onset = list(range(10, 10 * n + 1, 10)) + [10 * n + 5000]  # the last one after the idle time
    h.now = 0
    list(state.handleInputRows((7,), iter([pd.DataFrame({"ts": pd.to_datetime(onset, unit="ms").astype("datetime64[ns]"), "onset": onset, "duration": [4] * len(onset)})]), h))
    h.now, out = 10**6, []
    while h.timers:
        h.at = min(h.timers)
        h.timers.remove(h.at)
        out += [tuple(r) for part in state.handleExpiredTimer((7,), h, h) for r in part.itertuples(index=False)]
    assert out == [(7, t + 4, 6) for t in onset[:-2]]  # no rest over the idle time, though one batch brought both sides of it
    assert h.list.reads <= 3


def test_mean_in_order(spark):
    values = [1e16, 1.0, -1e16, 3.0, 0.1, None, 1e15, 0.7]
    total = 0.0
    for v in values:
        total += v or 0.0
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(5).orderBy("v").repartition(3)
    assert rows.agg(ledger.ordered_mean(rows["v"], rows["i"])).first()[0] == total / 7


def test_arms_do_not_depend_on_files(spark, tmp_path):
    from evenspan.plans.join_queries import _arms

    prices = [1e16, 1.0, -1e16, 3.0, 0.1, 1e15, 0.7, 5e14]
    for at in (1, 0):
        part = [(i, 8, p) for i, p in enumerate(prices) if i % 2 == at]
        spark.createDataFrame(part, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    total = 0.0
    for p in prices:
        total += p / 1000
    assert _arms(spark, str(tmp_path)).first()["bits"] == total / len(prices)

from collections import Counter

import hashlib

from evenspan.llm import line_dedup

from .conftest import EDGES


def plain(rows, least=10):
    def key(line):
        return line.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))

    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, least=10):
    return sorted((tuple(r) for r in line_dedup.digests(df, least).collect()), key=str)


ROWS = [(i, f"\tShared LINE é\r\nown {i}\n\nshared line É\n" + ("Nine\n" if i < 9 else "Ten \n" * 2)) for i in range(19)] + EDGES


def test_equals_plain(table):
    assert got(table(ROWS)) == plain(ROWS)
    assert got(table([])) == []
    assert got(table(EDGES), 2) == plain(EDGES, 2)


def test_runs_over_batches(spark, table):
    runs = line_dedup.LineRuns(spark, 10)
    for i in range(5):
        runs.add(table(ROWS[i::5]))
    assert [run is not None for run in runs.levels] == [True, False, True]  # five batches: a run of four and one of one
    out = line_dedup.drop_frequent_lines(table(ROWS), line_dedup.stored(runs.frequent(), "f"))
    assert out.where("_ld_dropped > 0").count() == 19
    assert "band" in out.columns
    runs.close()
    assert runs.levels == []


def test_runs_merge_without_exchange(spark, table):
    runs = line_dedup.LineRuns(spark, 10)
    for i in range(3):
        runs.add(table(ROWS[i::3]))
    a, b = filter(None, runs.levels)

    def plan(df):
        with runs._in_order():
            return df._jdf.queryExecution().executedPlan().toString()

    merged = plan(runs.merged(a, b))
    assert "SortMergeJoin" in merged and "Exchange" not in merged and "Sort [" not in merged
    kept = plan(runs.unsaturated(spark.table(a)))
    assert kept.count("SortMergeJoin") == 2 and "Exchange" not in kept and "Sort [" not in kept
    runs.close()


def test_saturated_lines_count_no_more(spark, table):
    runs = line_dedup.LineRuns(spark, 2)
    for k in range(4):
        runs.add(table([(10 * k + i, "same\nonce " + str(k) * 3) for i in range(3)]))
    run = next(filter(None, runs.levels[::-1]))
    assert sorted(r["n"] for r in spark.table(run).collect()) == [3] * 5  # counted in the first batch only
    assert runs.frequent().count() == 5
    runs.close()


def test_any_table_is_counted_itself(spark, table, tmp_path):
    """A filtered or united table counts its own rows, not those of the files it was read from."""
    table(ROWS).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few = [r for r in ROWS if r[0] is not None and r[0] < 9]
    assert got(docs.where("doc_id < 9")) == plain(few)
    more = [(900 + i, "own 3\nx") for i in range(9)]
    assert got(docs.unionByName(table(more).select(docs.columns))) == plain(ROWS + more)


def test_hot_hashes_and_shuffled_join(table, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 12)
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    assert got(table(ROWS)) == plain(ROWS)

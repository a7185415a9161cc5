"""A stream that is cut into several batches, comes out of order and is restarted gives what one batch gives."""

import random

import pytest

from evenspan.streaming import jobs, rests

SCHEMA = "song_id long, ts timestamp, onset long, duration long"
END = 10**6


def made(seed, n=160):
    """Facts by minute, shuffled within half an hour, and an end that passes the watermark on."""
    rng = random.Random(seed)
    rows = [(rng.randrange(3), m, rng.randrange(1, 9)) for m in sorted(rng.choices(range(1, 4 * n), k=n))]
    return sorted(rows, key=lambda r: r[1] + rng.randrange(0, 30)), rows


def plain(rows, idle=None):
    out, reach, last = [], {}, {}
    for song, onset, duration in sorted(rows, key=lambda r: (r[1], r[2])):
        if idle is not None and song in last and onset - last[song] > idle:
            reach.pop(song)
        if song in reach and onset > reach[song]:
            out.append((song, reach[song], onset - reach[song]))
        reach[song], last[song] = max(reach.get(song, onset), onset + duration), onset
    return sorted(out)


def written(spark, folder, rows, files):
    size = -(-len(rows) // files)
    for i in range(files):
        df = spark.createDataFrame([(s, m, d) for s, m, d in rows[i * size : (i + 1) * size]], "song_id long, onset long, duration long")
        df.selectExpr("song_id", "timestamp_millis(onset * 60000) AS ts", "onset", "duration").coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, out, check, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = rests.timed_rests(stream, "1 hour", **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["batchId"] for p in q.recentProgress]


@pytest.mark.parametrize("seed", [1])
def test_batches_and_restart(spark, tmp_path, seed):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shuffled, rows = made(seed)
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    written(spark, source, shuffled[:80], 3)
    assert len(run(spark, source, out, check)) >= 3  # a file each
    first = spark.read.parquet(out).count()
    written(spark, source, shuffled[80:], 3)
    written(spark, source, [(99, END, 1)], 1)
    run(spark, source, out, check)  # from the checkpoint on
    got = sorted((r["song_id"], r["onset"], r["duration"]) for r in spark.read.schema(rests.OUT).parquet(out).collect())
    assert 0 < first < len(got) and got == plain(rows)


def test_idle_songs_are_forgotten(spark, tmp_path):
    rows = [(1, 100, 5), (1, 110, 5), (1, 3100, 5), (1, 3110, 5), (2, 100, 5), (2, 400, 5)]
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for part in ([rows[0], rows[1], rows[4]], [rows[5]], [(3, 2100, 1)], [rows[2], rows[3]], [(99, END, 1)]):
        written(spark, source, part, 1)
        run(spark, source, out, check, idle_ms=600 * 60_000)
    got = sorted((r["song_id"], r["onset"], r["duration"]) for r in spark.read.schema(rests.OUT).parquet(out).collect())
    assert got == plain(rows, 600) == [(1, 105, 5), (1, 3105, 5), (2, 105, 295)]


def test_state_folder_has_to_be_shared(spark, monkeypatch):
    assert jobs.shared_dir(spark)

"""Workers turn files into Python objects by small slices, however many rows a batch has."""

import tracemalloc

import pyarrow as pa

from evenspan.sources import midi

NOTE = pa.struct([("onset", pa.int64()), ("pitch", pa.int32()), ("duration", pa.int64())])


def batch(songs):
    rows = [None if n is None else [{"onset": 2 * i, "pitch": 60, "duration": 1} for i in range(n)] for n in songs]
    return pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(len(rows))]), pa.array(rows, pa.list_(NOTE))], ["path", "notes"])


def test_slices_are_small_and_whole(monkeypatch):
    monkeypatch.setattr(midi, "NOTES_AT_ONCE", 100)
    songs = [3] * 300 + [None, 0, 500, 60, 50, 0]
    files = list(midi._rendered(iter([batch(songs)])))
    assert max(f.num_rows for f in files) <= 33 and sum(f.num_rows for f in files) == len(songs)
    whole = pa.Table.from_batches(files).combine_chunks().to_batches()
    got = list(midi._scan(False, 96)(iter(whole)))
    assert max(g.num_rows for g in got) <= midi.FILES and all(g.num_rows == 1 or sum(map(len, g.column("notes").to_pylist())) <= 150 for g in got)
    rows = [r for g in got for r in g.to_pylist()]
    assert [(r["path"], r["status"], len(r["notes"])) for r in rows] == [(f"s{i}", "ok", n or 0) for i, n in enumerate(songs)]


def test_empty_batches_and_null_contents():
    assert list(midi._rendered(iter([batch([])]))) == []
    nothing = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([None], pa.binary())], ["path", "content"])
    assert [g.column("status").to_pylist() for g in midi._scan(True, 96)(iter([nothing]))] == [["corrupt"]]


def test_memory_of_the_builds_scan_does_not_grow_with_a_batch():
    def peak(songs):
        held = batch([40] * songs)
        tracemalloc.start()
        files = pa.Table.from_batches(list(midi._rendered(iter([held])))).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in midi._scan(True, None)(iter(files)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == songs
        return most

    peak(100)
    assert peak(4000) < 2 * peak(400)

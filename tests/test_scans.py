import pytest
from pyspark.errors import PySparkException

from evenspan.operators import relations
from evenspan.sources import metadata, midi

NOTES = [(0, 60, 480), (480, 64, 960)]


def test_every_row_of_metadata_gets_a_record_or_a_fault(spark, tmp_path):
    lines = [("good", "cmajor", "4/4"), ("minor", "aminor", "4/4"), ("waltz", "cmajor", "3/4"), ("gone", "cmajor", "4/4"), ("bad", "cmajor", "4/4"), ("ticks", "cmajor", "4/4"), ("frame", "gmajor", "4/4"), ("other", "aminor", "4/4"), ("nokey", "cmajor", "4/4"), ("metre", "cmajor", "4/4"), ("twice", "cmajor", "4/4"), ("twice", "cmajor", "4/4")]
    (tmp_path / "meta.csv").write_bytes(b"\xef\xbb\xbf" + ("id,split_data,audio_key,time_signature,num_measures\n" + "".join(f"{i},train,{k},{m},8\n" for i, k, m in lines)).encode())
    files = {
        "good": midi.render(NOTES, 480, "C", (4, 4)), "minor": midi.render(NOTES, 480, "Am", (4, 4)), "waltz": midi.render(NOTES, 480, "C", (3, 4)), "bad": b"MThd", "ticks": midi.render(NOTES, 96, "C", (4, 4)), "frame": midi.render(NOTES, 480, "G", (4, 4)),
        "other": midi.render(NOTES, 480, "C", (4, 4)), "nokey": midi.render(NOTES, 480, None, (4, 4)), "metre": midi.render(NOTES, 480, "C", (6, 8)), "twice": midi.render(NOTES, 480, "C"), "unnamed": b"never opened",
    }
    df = spark.createDataFrame([(f"commu_midi/train/raw/{i}.mid", f) for i, f in files.items()], "path string, content binary")
    meta = metadata.read_metadata(spark, str(tmp_path / "meta.csv"))
    got = {r["sample_id"]: r for r in metadata.scanned(meta, df).collect()}
    assert {i: r["fault"] for i, r in got.items()} == {"good": None, "minor": None, "gone": "missing", "bad": "unreadable", "ticks": "ticks", "frame": "frame", "other": "key", "nokey": "key", "metre": "meter", "twice": "repeated"}
    assert [(n["onset"], n["pitch"], n["duration"]) for n in got["good"]["notes"]] == [(0, 60, 96), (96, 64, 192)] and got["bad"]["error"] and got["gone"]["note_count"] == 0
    assert metadata.scanned(meta.limit(0), df).collect() == []


def test_windows_of_latents_leave_vectors_where_they_are(spark, monkeypatch):
    latents = spark.createDataFrame([(i, [float(i * 10 + k) for k in range(6)]) for i in range(4)], "song long, v array<double>")
    index = spark.createDataFrame([(0, 2, "a"), (0, 0, "b"), (3, 4, "c"), (9, 0, "d")], "song long, start int, w string")
    want = {"a": [2.0, 3.0], "b": [0.0, 1.0], "c": [34.0, 35.0]}
    got = relations.latent_windows(latents, index, "song", "v", 2)
    assert {r["w"]: r["slice"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(relations, "INDEX_BYTES", 0)
    assert {r["w"]: r["slice"] for r in relations.latent_windows(latents, index, "song", "v", 2).collect()} == want
    with pytest.raises(PySparkException):
        relations.latent_windows(latents, index.limit(3), "song", "v", 5).collect()
    assert relations.latent_windows(latents, index.limit(0), "song", "v", 2).collect() == []

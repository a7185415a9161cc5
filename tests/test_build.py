"""The staged corpus build: published at once, resumed after any stage, and equal to what plain loops give."""

import hashlib
import random

import pytest

from evenspan.operators import corpus_build, staged
from evenspan.sources import midi, shared


def made(n=40, seed=1):
    """Files with exact and transposed copies, and a broken one."""
    rng, songs = random.Random(seed), []
    for i in range(n):
        if songs and rng.random() < 0.5:
            shift = rng.choice([0, 0, 5])
            songs.append([(o, p + shift, d) for o, p, d in rng.choice(songs)])
        else:
            songs.append(sorted({(rng.randrange(0, 40) * 96, rng.randrange(40, 80), 48) for _ in range(rng.randrange(1, 12))}))
    return [(f"/x/song_{i}.mid", midi.render(s)) for i, s in enumerate(songs)] + [("/x/song_broken.mid", b"MThd nothing")], songs


def plain_families(songs):
    keys = {}
    for i, s in enumerate(songs):
        first, low = s[0][0], min(p for o, p, _ in s if o == s[0][0])
        keys.setdefault(tuple((o - first, p - low, d) for o, p, d in s), []).append(i)
    return keys.values()


def build(spark, root, rows, **more):
    files = spark.createDataFrame(rows, "path string, content binary")
    return corpus_build.build(spark, files, root, validation=6, test=7, old_holdout=9, seed=3, **more)


def digests(manifest):
    return {t: (v["rows"], v["digest"]) for stage in manifest["stages"].values() for t, v in stage.items()}


def test_build_equals_plain(spark, tmp_path):
    rows, songs = made()
    manifest = build(spark, str(tmp_path), rows)
    assert staged.current(spark, str(tmp_path)) == manifest
    table = {r["sample_id"]: r for r in staged.published(spark, str(tmp_path), "lineage_table", verify=True).collect()}
    assert len(table) == len(rows) and len(table["song_0"]) == 29
    by = {}
    for i in range(len(songs)):
        by.setdefault(table[f"song_{i}"]["lineage_id"], []).append(i)
    families = {tuple(f) for f in plain_families(songs)}
    assert all(any(set(f) <= set(g) for g in by.values()) for f in families)  # a family may hold several, by its rhythm
    for name, members in by.items():
        ids = sorted(f"song_{i}" for i in members)
        assert name == "corpus_content_family_" + hashlib.sha256(("\n".join(ids) + "\n").encode()).hexdigest()[:24]
        assert len({table[i]["split"] for i in ids}) == 1
    counts = {s: sum(r["split"] == s for r in table.values()) for s in ("train", "validation", "test", "excluded")}
    assert sum(counts.values()) == len(rows) and counts["excluded"] == 1 and counts["test"] >= 7 and counts["validation"] >= 6
    broken = table["song_broken"]
    assert (broken["parse_status"], broken["lineage_confidence"], broken["note_count"]) == ("corrupt", corpus_build.CORRUPT, 0) and broken["parse_error"]
    assert table["song_3"]["note_count"] == len(songs[3]) and table["song_3"]["release_index"] == 3 and broken["release_index"] == -1
    old = [r["sample_id"] for r in sorted((r for r in table.values() if r["parse_status"] == "ok"), key=lambda r: (r["release_index"], r["sample_id"]))][-9:]
    assert all((r["old_split"] == "holdout") == (i in old) for i, r in table.items() if r["parse_status"] == "ok")
    assert set(manifest["crossings"].values()) == {0}
    for s in ("train", "validation", "test"):
        part = staged.published(spark, str(tmp_path), s)
        assert part.columns == corpus_build.SAMPLE and part.count() == counts[s]
    exact = staged.published(spark, str(tmp_path), "exact_duplicates").collect()
    assert all(r["group_size"] > 1 for r in exact) and {r["sample_id"] for r in exact} <= set(table)
    lone = staged.published(spark, str(tmp_path), "ambiguous_lineage").where("lineage_id = '__UNRESOLVED_SINGLETONS__'").first()
    assert lone["sample_count"] == sum(len(m) == 1 for m in by.values())


class Killed(Exception):
    pass


def test_killed_anywhere_and_resumed(spark, tmp_path):
    rows, _ = made(12, 5)
    names = []
    want = digests(build(spark, f"{tmp_path}/whole", rows, before=names.append))
    root, runs = f"{tmp_path}/parts", []

    def dies_at(stage):
        def before(name):
            runs.append(name)
            if name == stage:
                raise Killed

        return before

    for stage in names[1:]:
        with pytest.raises(Killed):
            build(spark, root, rows, before=dies_at(stage))
        assert not shared.exists(spark, f"{root}/{staged.POINTER}")  # nothing is published
    times = {p: p.stat().st_mtime_ns for p in tmp_path.joinpath("parts").rglob("*.parquet")}
    assert digests(build(spark, root, rows)) == want
    assert all(p.stat().st_mtime_ns == t for p, t in times.items())  # no stage that ended ran again


def test_half_written_stage_is_made_again_and_changes_are_seen(spark, tmp_path):
    rows, _ = made(8, 6)
    build(spark, str(tmp_path), rows)
    first = staged.current(spark, str(tmp_path))
    other = build(spark, str(tmp_path), rows[:-2])
    assert other["build"] != first["build"] and staged.current(spark, str(tmp_path)) == other
    folder = f"{tmp_path}/builds/{other['build']}"
    shared.delete(spark, f"{folder}/reports.json")  # as if it had died in that stage
    assert digests(build(spark, str(tmp_path), rows[:-2])) == digests(other)
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/samples/train")
    with pytest.raises(ValueError, match="changed"):
        staged.published(spark, str(tmp_path), "train", verify=True)
    shared.replace(spark, f"{folder}/manifest.json", "{\"digest\": \"x\"}")
    with pytest.raises(ValueError, match="published"):
        staged.current(spark, str(tmp_path))


def test_empty_corpus(spark, tmp_path):
    manifest = build(spark, str(tmp_path), [])
    assert digests(manifest)["lineage_table"][0] == 0


def test_created_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: shared.create(spark, f"{tmp_path}/a/lock", str(i)), range(8)))
    assert sum(won) == 1 and shared.read_text(spark, f"{tmp_path}/a/lock") == str(won.index(True))
    shared.replace(spark, f"{tmp_path}/a/lock", "ünï")
    assert shared.read_text(spark, f"{tmp_path}/a/lock") == "ünï" and shared.exists(spark, f"{tmp_path}/a/lock")

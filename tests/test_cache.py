"""The sample cache: what is written is read, only asked ranges are, and faults are found before the first row."""

import json
import pathlib
import shutil

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from evenspan.sources import cache


def samples(spark, n=60):
    rows = [(f"s{i:04d}", "train" if i < n // 2 else "validation", i, [(i * 7 + k) % 1154 for k in range(1 + i % 9)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "sample_id string, split string, events long, tokens array<long>")


def read(df):
    return sorted((r["sample_id"], r["split"], r["events"], [tuple(t) if isinstance(t, tuple) else t for t in r["tokens"]]) for r in df.collect())


def test_roundtrip_and_manifest(spark, tmp_path):
    rows, df = samples(spark)
    m = cache.write_cache(df, f"{tmp_path}/c", manifest="m1", vocabulary=1154)
    assert (m["sample_count"], m["row_count"], m["event_count"]) == (60, sum(len(r[3]) for r in rows), sum(r[2] for r in rows))
    assert m["split_counts"] == {"train": 30, "validation": 30} and m["longest"] == 9
    assert read(cache.read_cache(spark, f"{tmp_path}/c", manifest="m1")) == rows
    assert read(cache.read_cache(spark, f"{tmp_path}/c").where("split = 'train' and sample_id in ('s0003', 's0050')")) == [rows[3]]
    assert cache.cache_faults(spark, f"{tmp_path}/c").collect() == []
    first = [p["first_row"] for p in m["parts"]]
    assert first == sorted(first) and len(m["parts"]) > 1 and not list(tmp_path.glob("*.building*"))


def test_several_fields(spark, tmp_path):
    rows = [(f"s{i}", "train", 1, [(i, k) for k in range(i + 1)]) for i in range(9)]
    df = spark.createDataFrame(rows, "sample_id string, split string, events long, tokens array<struct<anchor:int,pitch:long>>")
    cache.write_cache(df, f"{tmp_path}/c", fields=["anchor", "pitch"])
    got = cache.read_cache(spark, f"{tmp_path}/c")
    assert got.schema["tokens"].dataType.simpleString() == "array<struct<anchor:bigint,pitch:bigint>>" and read(got) == sorted(rows)


class Counting:
    """A file that counts the bytes that are read of it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        Counting.total += n
        return self.f.read(n)


def test_only_asked_ranges_are_read(spark, tmp_path, monkeypatch):
    rows, df = samples(spark)
    m = cache.write_cache(df, f"{tmp_path}/c")
    monkeypatch.setattr(cache, "RANGE", 1)
    whole = cache.CacheReader({"path": f"{tmp_path}/c"})
    batch = whole._batch

    def counted(reader):
        Counting.total = 0
        reader._batch = lambda f, run: batch(Counting(f), run)
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return [r["sample_id"] for r in got], Counting.total

    assert counted(whole) == ([r[0] for r in rows], 4 * m["row_count"])
    one = cache.CacheReader({"path": f"{tmp_path}/c"})
    assert list(one.pushFilters([In(("sample_id",), ("s0004", "s0005", "s0059")), EqualTo(("split",), "train")]))
    assert len(one.partitions()) < len(whole.partitions())
    assert counted(one) == (["s0004", "s0005"], 4 * (len(rows[4][3]) + len(rows[5][3])))
    plan = cache.read_cache(spark, f"{tmp_path}/c").where("sample_id = 's0004'")
    assert [r["sample_id"] for r in plan.collect()] == ["s0004"] and plan.rdd.getNumPartitions() == 1


def test_faults_are_found_before_the_first_row(spark, tmp_path):
    _, df = samples(spark)
    path = f"{tmp_path}/c"
    cache.write_cache(df.withColumn("split", F.when(F.col("sample_id") == "s0001", "test").otherwise(F.col("split"))), path, manifest="m1")
    for options, said in (({}, "test rows"), ({"allow_test": "true", "manifest": "m2"}, "another manifest")):
        with pytest.raises(cache.CacheFault, match=said):
            cache.CacheReader({"path": path, **options})
    with pytest.raises(PySparkException):
        cache.read_cache(spark, path).count()
    assert cache.read_cache(spark, path, manifest="m1", allow_test=True).count() == 60
    with pytest.raises(Exception, match="exists"):
        cache.write_cache(df, path)

    def broken(name, change):
        shutil.copytree(path, f"{tmp_path}/{name}")
        at = pathlib.Path(tmp_path, name, "cache_manifest.json")
        m = json.loads(at.read_text())
        change(m, at.parent)
        at.write_text(json.dumps(m))
        return f"{tmp_path}/{name}"

    def cut(m, folder):
        part = folder / f"tokens-{m['parts'][0]['name']}.bin"
        part.write_bytes(part.read_bytes()[:-4])

    for name, change, said in (
        ("version", lambda m, _: m.update(schema_version="x"), "version"), ("count", lambda m, _: m.update(sample_count=61), "counts"),
        ("offset", lambda m, _: m["parts"][1].update(first_row=1), "offsets"), ("size", cut, "size"),
    ):
        with pytest.raises(cache.CacheFault, match=said):
            cache.CacheReader({"path": broken(name, change), "allow_test": "true"})

    def flip(m, folder):
        part = folder / f"tokens-{m['parts'][0]['name']}.bin"
        data = bytearray(part.read_bytes())
        data[0] ^= 1
        part.write_bytes(data)

    found = cache.cache_faults(spark, broken("flipped", flip)).collect()
    assert [r["kind"] for r in found] == ["digest"]


@pytest.mark.parametrize("row", [("bad", "train", 1, []), (None, "train", 1, [1]), ("bad", "train", 1, [5000]), ("bad", "train", 1, [-1]), ("bad", "train", 1, [None])])
def test_aborted_writes_leave_nothing(spark, tmp_path, row):
    _, df = samples(spark)
    with pytest.raises((PySparkException, Py4JError)):
        cache.write_cache(df.unionByName(spark.createDataFrame([row], df.schema)), f"{tmp_path}/c", vocabulary=1154)
    assert list(tmp_path.iterdir()) == []


def test_repeated_ids_and_no_samples(spark, tmp_path):
    _, df = samples(spark, 4)
    cache.write_cache(df.unionByName(df.limit(1)), f"{tmp_path}/twice")
    assert [(r["kind"], r["key"]) for r in cache.cache_faults(spark, f"{tmp_path}/twice").collect()] == [("sample", "s0000")]
    cache.write_cache(df.limit(0), f"{tmp_path}/none")
    assert cache.read_cache(spark, f"{tmp_path}/none").collect() == [] and cache.cache_faults(spark, f"{tmp_path}/none").collect() == []

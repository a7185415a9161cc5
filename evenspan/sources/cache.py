"""A cache of samples as a Spark data source: numbers in binary parts, their offsets beside them, one manifest.

``<path>/tokens-*.bin`` holds the samples' numbers in rows of as many 32-bit numbers as there are fields;
``<path>/samples-*.parquet`` the sample of each range (id, split, first row, rows, events); ``cache_manifest.json`` the
parts with their first sample and row in the whole, rows, digests, least and largest id, splits, and marks from where a
part can be read.

Writing: each task writes a part of its own and says what is in it; the commit gives the parts their place in the whole,
writes the manifest and renames the folder.  A task or job that fails leaves no part and no cache.

Reading: schema, manifest, count and size are tested before the first row, against the manifest and the parts' sizes
alone.  Partitions are ranges of about :data:`RANGE` rows between marks.  Filters on the id and the split rule out parts
by the manifest, then samples by their index, and only the bytes of those that remain are read.

The folder has to be one that driver and executors reach through Arrow's file systems (a mounted folder, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

VERSION = "evenspan.cache.v1"
#: Rows between marks, and bytes that are read at once.
RANGE, CHUNK = 1 << 20, 8 << 20
NAME = "evenspan_cache"


def located(path: str):
    """Arrow's file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):  # with one, two or three slashes
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: ``marks`` are pairs of a sample and its first row."""

    name: str
    samples: int = 0
    rows: int = 0
    events: int = 0
    longest: int = 0
    sha256: str = ""
    least: str | None = None
    largest: str | None = None
    splits: dict = field(default_factory=dict)
    marks: list = field(default_factory=list)


class CacheFault(ValueError):
    """The cache isn't what was asked for, or isn't whole."""


def manifest_of(path: str) -> dict:
    fs, at = located(path)
    with fs.open_input_file(f"{at}/cache_manifest.json") as f:
        return json.loads(f.read().decode())


class SampleCache(DataSource):
    """Options: path, fields (comma-joined, for writing), manifest (the id that a reader expects, or that is written), vocabulary, allow_test."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        fields = manifest_of(self.options["path"])["fields"]
        kind = "bigint" if len(fields) == 1 else f"struct<{','.join(f'{f}:bigint' for f in fields)}>"
        return f"sample_id string, split string, events bigint, tokens array<{kind}>"

    def reader(self, schema) -> DataSourceReader:
        return CacheReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CacheWriter(dict(self.options), schema.names)


class CacheWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.fields = options["path"].rstrip("/"), options.get("fields", "id").split(",")
        self.given, self.vocabulary = options.get("manifest", ""), int(options.get("vocabulary", 1 << 32))
        if missing := {"sample_id", "split", "events", "tokens"} - set(columns):
            raise CacheFault(f"columns that aren't there: {sorted(missing)}")
        fs, at = located(self.path)
        if fs.get_file_info(at).type.name != "NotFound":
            raise FileExistsError(f"{self.path} exists")
        self.building = f"{self.path}.building-{uuid.uuid4().hex}"
        fs.create_dir(located(self.building)[1], recursive=True)  # once: a task that outlives the job's end finds no folder to write to

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        import pyarrow.parquet as pq

        fs, at = located(self.building)
        part, digest, marked = Part(uuid.uuid4().hex), hashlib.sha256(), -RANGE
        index: dict[str, list] = {"sample_id": [], "split": [], "first": [], "rows": [], "events": []}
        try:
            with fs.open_output_stream(f"{at}/tokens-{part.name}.bin") as out:
                for batch in batches:
                    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                    values, sizes = numbers(columns["tokens"], len(self.fields), self.vocabulary)
                    data = values.tobytes()
                    out.write(data)
                    digest.update(data)
                    for sample, split, events, n in zip(*(columns[c].to_pylist() for c in ("sample_id", "split", "events")), sizes.tolist()):
                        if sample is None or not n:
                            raise CacheFault(f"sample {sample} is empty or has no id")
                        if part.rows - marked >= RANGE:
                            part.marks.append([part.samples, part.rows])
                            marked = part.rows
                        for key, value in zip(index, (sample, split, part.rows, n, events or 0)):
                            index[key].append(value)
                        part.samples, part.rows, part.events, part.longest = part.samples + 1, part.rows + n, part.events + (events or 0), max(part.longest, n)
                        part.least, part.largest = min(part.least or sample, sample), max(part.largest or sample, sample)
                        one = part.splits.setdefault(str(split), [0, 0])
                        one[0], one[1] = one[0] + 1, one[1] + (events or 0)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            with fs.open_output_stream(f"{at}/samples-{part.name}.parquet") as out:
                pq.write_table(pa.table({k: pa.array(v, t) for (k, v), t in zip(index.items(), kinds)}), out, row_group_size=65_536)
        except BaseException:
            for name in (f"tokens-{part.name}.bin", f"samples-{part.name}.parquet"):
                if fs.get_file_info(f"{at}/{name}").type.name == "File":
                    fs.delete_file(f"{at}/{name}")
            raise
        part.sha256 = digest.hexdigest()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs as pafs

        parts = sorted((m for m in messages if m and m.samples), key=lambda m: (m.least, m.name))
        fs, at = located(self.building)
        known = {f"{kind}-{p.name}.{end}" for p in parts for kind, end in (("tokens", "bin"), ("samples", "parquet"))}
        for info in fs.get_file_info(pafs.FileSelector(at)):
            if info.base_name not in known:  # of attempts that didn't count
                fs.delete_file(info.path)
        shown, first, row = [], 0, 0
        for p in parts:
            shown.append({"name": p.name, "first_sample": first, "first_row": row, "samples": p.samples, "rows": p.rows, "sha256": p.sha256, "least": p.least, "largest": p.largest, "splits": sorted(p.splits), "marks": p.marks})
            first, row = first + p.samples, row + p.rows
        splits: dict[str, list[int]] = {}
        for p in parts:
            for s, (n, events) in p.splits.items():
                had = splits.setdefault(s, [0, 0])
                splits[s] = [had[0] + n, had[1] + events]
        events = sum(p.events for p in parts)
        manifest = {
            "schema_version": VERSION, "manifest": self.given, "fields": self.fields, "vocabulary": self.vocabulary, "sample_count": first, "row_count": row, "event_count": events, "rows_per_event": row / max(1, events),
            "longest": max((p.longest for p in parts), default=0), "split_counts": {s: v[0] for s, v in sorted(splits.items())}, "split_events": {s: v[1] for s, v in sorted(splits.items())}, "test_rows": splits.get("test", [0])[0], "parts": shown,
        }
        with fs.open_output_stream(f"{at}/cache_manifest.json") as out:
            out.write((json.dumps(manifest, indent=1, sort_keys=True) + "\n").encode())
        fs.move(at, located(self.path)[1])

    def abort(self, messages: list[Part | None]) -> None:
        fs, at = located(self.building)
        if fs.get_file_info(at).type.name == "Directory":
            fs.delete_dir(at)


def numbers(tokens: pa.Array, width: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all samples as unsigned 32-bit numbers, and the number of rows of each."""
    tokens = tokens.cast(pa.list_(tokens.type.value_type))
    sizes = np.asarray(tokens.value_lengths().fill_null(0))
    flat = tokens.flatten()
    columns = [flat] if width == 1 else flat.flatten()
    if len(columns) != width:
        raise CacheFault(f"{len(columns)} fields, {width} were named")
    if any(c.null_count for c in columns):
        raise CacheFault("a number is null")
    values = np.column_stack([np.asarray(c, dtype=np.int64) for c in columns]) if len(flat) else np.zeros((0, width), np.int64)
    if len(values) and (values.min() < 0 or values.max() >= vocabulary):
        raise CacheFault("a number leaves the vocabulary")
    return values.astype("<u4"), sizes


@dataclass
class Range(InputPartition):
    part: dict
    first: int
    last: int


class CacheReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.manifest = manifest_of(self.path)
        self.ids: set[str] | None = None
        self.splits: set[str] | None = None
        m, wanted = self.manifest, options.get("manifest")
        if m.get("schema_version") != VERSION:
            raise CacheFault("unknown schema version")
        if wanted is not None and m["manifest"] != wanted:
            raise CacheFault("the cache was made from another manifest")
        if m["test_rows"] and options.get("allow_test", "false").lower() != "true":
            raise CacheFault("the cache holds test rows")
        self.width = len(m["fields"])
        at = [0, 0]
        fs, folder = located(self.path)
        infos = fs.get_file_info([f"{folder}/tokens-{p['name']}.bin" for p in m["parts"]])
        for p, info in zip(m["parts"], infos):
            if [p["first_sample"], p["first_row"]] != at:
                raise CacheFault(f"offsets of part {p['name']}")
            if info.type.name != "File" or info.size != 4 * self.width * p["rows"]:
                raise CacheFault(f"size of part {p['name']}")
            at = [at[0] + p["samples"], at[1] + p["rows"]]
        if at != [m["sample_count"], m["row_count"]]:
            raise CacheFault("counts of the manifest")

    def pushFilters(self, filters: list) -> Iterator:
        """Sets of ids and splits; Spark tests all filters again."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("sample_id",):
                self.ids = values if self.ids is None else self.ids & values
            elif values is not None and f.attribute == ("split",):
                self.splits = values if self.splits is None else self.splits & values
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for p in self.manifest["parts"]:
            if self.splits is not None and not self.splits & set(p["splits"]):
                continue
            if self.ids is not None and not any(p["least"] <= i <= p["largest"] for i in self.ids):
                continue
            starts = [s for s, _ in p["marks"]] + [p["samples"]]
            out += [Range(p, a, b) for a, b in zip(starts, starts[1:])]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None:  # no part has what is asked for
            return
        fs, folder = located(self.path)
        with fs.open_input_file(f"{folder}/samples-{partition.part['name']}.parquet") as f:
            index = pq.read_table(f)
        if index.num_rows != partition.part["samples"]:
            raise CacheFault(f"samples of part {partition.part['name']}")
        index = index.slice(partition.first, partition.last - partition.first).to_pydict()
        wanted = [
            (i, s, n, e, k) for i, s, n, e, k in zip(index["sample_id"], index["split"], index["first"], index["rows"], index["events"])
            if (self.ids is None or i in self.ids) and (self.splits is None or s in self.splits)
        ]
        with fs.open_input_file(f"{folder}/tokens-{partition.part['name']}.bin") as f:
            run: list = []
            for row in wanted:
                # samples that lie side by side are read at once
                if run and (run[-1][2] + run[-1][3] != row[2] or 4 * self.width * (row[2] + row[3] - run[0][2]) > CHUNK):
                    yield self._batch(f, run)
                    run = []
                run.append(row)
            if run:
                yield self._batch(f, run)

    def _batch(self, f, run: list) -> pa.RecordBatch:
        first, rows = run[0][2], sum(r[3] for r in run)
        f.seek(4 * self.width * first)
        values = np.frombuffer(f.read(4 * self.width * rows), "<u4").reshape(rows, self.width).astype(np.int64)
        columns = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(self.width)]
        flat = columns[0] if self.width == 1 else pa.StructArray.from_arrays(columns, self.manifest["fields"])
        offsets = pa.array(np.concatenate([[0], np.cumsum([r[3] for r in run])]).astype(np.int32))
        ids, splits, events = ([r[i] for r in run] for i in (0, 1, 4))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(splits, pa.string()), pa.array(events, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["sample_id", "split", "events", "tokens"])


def write_cache(samples: DataFrame, path: str, *, manifest: str = "", fields: list[str] | None = None, vocabulary: int | None = None) -> dict:
    """Write samples (sample_id, split, events, tokens), sorted by range of their ids, and return the cache's manifest."""
    spark = samples.sparkSession
    spark.dataSource.register(SampleCache)
    rows = samples.select("sample_id", "split", F.col("events").cast("long").alias("events"), "tokens")
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample_id").sortWithinPartitions("sample_id")
    writer = rows.write.format(NAME).mode("append").option("path", path).option("manifest", manifest).option("fields", ",".join(fields or ["id"]))
    (writer if vocabulary is None else writer.option("vocabulary", vocabulary)).save()
    return manifest_of(path)


def read_cache(spark: SparkSession, path: str, *, manifest: str | None = None, allow_test: bool = False) -> DataFrame:
    """The samples; filters on sample_id and split are pushed to the parts."""
    spark.dataSource.register(SampleCache)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("path", path).option("allow_test", str(allow_test).lower())
    return (reader if manifest is None else reader.option("manifest", manifest)).load()


def cache_faults(spark: SparkSession, path: str) -> DataFrame:
    """kind, key: parts whose bytes aren't those that were written, and ids that are there more than once; a task reads a part in pieces."""
    m = manifest_of(path)
    parts = spark.createDataFrame([(p["name"], p["sha256"]) for p in m["parts"]], "name string, sha256 string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = located(path)
        for batch in batches:
            bad = []
            for name, want in zip(*(c.to_pylist() for c in batch.columns)):
                digest = hashlib.sha256()
                with fs.open_input_stream(f"{folder}/tokens-{name}.bin") as f:
                    while data := f.read(CHUNK):
                        digest.update(data)
                if digest.hexdigest() != want:
                    bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(["digest"] * len(bad), pa.string()), pa.array(bad, pa.string())], ["kind", "key"])

    changed = parts.repartition(max(1, len(m["parts"])), "name").mapInArrow(digests, "kind string, key string")
    ids = spark.read.parquet(*(f"{path}/samples-{p['name']}.parquet" for p in m["parts"])) if m["parts"] else spark.createDataFrame([], "sample_id string")
    return changed.unionByName(ids.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("sample").alias("kind"), F.col("sample_id").alias("key")))

"""Queries over sources, sinks, governance and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import corpus_build, governance, ordered_digest, staged
from ..operators import events as ev
from ..sources import metadata, midi, readers, sinks
from ..sources.shared import shared_dir
from ..streaming import jobs, rests
from .base import facts, query, rounded, table
from .lineage_queries import _LINES as HASHES


def _note_lists(spark, sf_dir):
    """Each song's notes without overlaps of a pitch."""
    w = ev.Window.partitionBy("song_id", "pitch").orderBy("onset")
    f = facts(spark, sf_dir).groupBy("song_id", "onset", "pitch").agg(F.max("duration").alias("duration"))
    f = f.withColumn("duration", F.least("duration", F.coalesce(F.lead("onset").over(w) - F.col("onset"), F.col("duration"))))
    return f.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("onset", "pitch", "duration"))).alias("notes"))


def _files(spark, sf_dir):
    """One MIDI file for each song."""
    return midi.rendered(_note_lists(spark, sf_dir).withColumnRenamed("song_id", "path"))


_FLAT = "{facts}, m AS (SELECT song_id, onset, pitch, max(duration) AS d FROM facts GROUP BY 1, 2, 3), n AS (SELECT song_id::VARCHAR AS song_id, onset, pitch, least(d, coalesce(lead(onset) OVER (PARTITION BY song_id, pitch ORDER BY onset) - onset, d)) AS duration FROM m)"


@query(_FLAT + " SELECT song_id, onset, pitch::BIGINT AS pitch, duration FROM n")
def midi_roundtrip(spark, sf_dir):
    got = midi.facts_of(midi.parsed(_files(spark, sf_dir), strict=True))
    return got.select("song_id", "onset", F.col("pitch").cast("bigint").alias("pitch"), "duration")


@query(_FLAT + " SELECT song_id AS path, 'ok' AS status, count(*) AS note_count, count(DISTINCT onset) AS onset_count, round((max(onset + duration) - min(onset)) / 96, 6) + 0.0 AS beats, '4/4' AS meter FROM n GROUP BY 1 UNION ALL SELECT 'broken', 'corrupt', 0, 0, 0.0, ''")
def midi_file_records(spark, sf_dir):
    files = _files(spark, sf_dir).unionByName(spark.createDataFrame([("broken", b"MThd nothing")], "path string, content binary"))
    r = midi.file_records(midi.parsed(files), files)
    return r.select("path", "status", F.greatest("note_count", F.lit(0)).cast("bigint").alias("note_count"), F.greatest("onset_count", F.lit(0)).cast("bigint").alias("onset_count"), rounded(F.col("beats")).alias("beats"), F.coalesce("meter", F.lit("")).alias("meter"))


_BUILT = _FLAT.replace(" m AS (", " flat0 AS (").replace("FROM m)", "FROM flat0)") + f""", li AS (SELECT song_id, onset, duration, pitch FROM n), {HASHES}
SELECT song_id AS sample_id, h.exact AS exact_hash, h.transposed AS transposition_invariant_hash, h.rhythm AS rhythm_interval_hash, notes AS note_count, onsets AS onset_count, beats AS duration_beats,
 'corpus_content_family_' || substr(sha256(ids || chr(10)), 1, 24) AS lineage_id FROM h JOIN (SELECT rhythm, string_agg(song_id, chr(10) ORDER BY song_id) AS ids FROM h GROUP BY 1) f ON f.rhythm = h.rhythm
 JOIN (SELECT song_id, count(*)::INT AS notes, count(DISTINCT onset)::INT AS onsets, round((max(onset + duration) - min(onset)) / 96, 6) + 0.0 AS beats FROM li GROUP BY 1) c USING (song_id)"""


@query(_BUILT)
def published_lineage(spark, sf_dir):
    """The corpus build of all songs as files, read back from what was published."""
    root = f"{shared_dir(spark)}/evenspan-build-{uuid.uuid4().hex}"
    corpus_build.build(spark, _files(spark, sf_dir), root, validation=10, test=10, old_holdout=20, seed=20)
    t = staged.published(spark, root, "lineage_table", verify=True)
    return t.select("sample_id", *corpus_build.RELATIONS, "note_count", "onset_count", rounded(F.col("duration_beats")).alias("duration_beats"), "lineage_id")


_LINES = "l AS (SELECT o_custkey AS song_id, o_orderkey AS n, (o_orderkey * 2.0) AS t, (o_orderkey % 3) AS k FROM orders)"


@query(f"WITH {_LINES}, b AS (SELECT *, t - lag(t) OVER (PARTITION BY song_id ORDER BY n) AS step FROM l WHERE k >= 1), e AS (SELECT song_id, max(n) + 1 AS n, max(t) + median(step) AS t FROM b GROUP BY 1) SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY n) - 1)::BIGINT AS i, round(coalesce(t, -1), 6) + 0.0 AS time FROM (SELECT song_id, n, t FROM b UNION ALL SELECT * FROM e)")
def downbeat_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws("  ", (F.col("o_orderkey") * 2).cast("string"), F.lit("1"), (F.col("o_orderkey") % 3 / 2).cast("string"))
    rows = o.select(F.col("o_custkey").alias("song_id"), F.col("o_orderkey").alias("n"), line.alias("line"))
    return readers.downbeats(rows).select("song_id", F.col("i").cast("bigint").alias("i"), rounded(F.coalesce("time", F.lit(-1.0))).alias("time"))


@query("WITH i AS (SELECT l_orderkey AS song_id, l_partkey AS n, l_quantity::BIGINT - 5 AS span, 'C' || l_suppkey AS label FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY span DESC, n, label DESC) AS k FROM i WHERE span > 0) SELECT song_id, span, n FROM r WHERE k = 1")
def global_key_scan(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", F.lit("10"), (F.col("l_quantity").cast("bigint") + 5).cast("string"), F.concat(F.col("l_quantity").cast("bigint") - 5, F.lit(":"), F.col("l_partkey")))
    got = readers.longest_key(readers.chord_intervals(x.select(F.col("l_orderkey").alias("song_id"), F.col("l_partkey").alias("n"), line.alias("line"))))
    return got.select("song_id", F.substring_index("label", ":", 1).cast("bigint").alias("span"), F.substring_index("label", ":", -1).cast("bigint").alias("n"))


@query("SELECT c_custkey, 'corpus:src_' || c_nationkey || ':' || c_custkey AS song_id FROM customer")
def source_song_ids(spark, sf_dir):
    path = F.concat(F.lit("src_"), "c_nationkey", F.lit("/"), "c_custkey", F.lit(".mid"))
    return table(spark, sf_dir, "customer").select("c_custkey", readers.source_song_id(path, "corpus").alias("song_id"))


@query("SELECT o_orderstatus AS split, count(*) AS samples, sum(o_custkey)::BIGINT AS events FROM orders GROUP BY 1")
def split_receipts(spark, sf_dir):
    return sinks.split_receipt(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "split"), "o_custkey")


@query("SELECT 'sample' AS kind, l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'l_suppkey', l_suppkey::VARCHAR, count(DISTINCT l_returnflag) FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_returnflag) > 1")
def manifest_faults(spark, sf_dir):
    return governance.manifest_faults(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_suppkey"], "l_returnflag")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'MISSING' WHEN c_custkey % 7 = 0 THEN 'DIGEST' WHEN c_custkey % 5 = 0 THEN 'VALUE' ELSE 'PASS' END AS status FROM customer")
def receipt_verification(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    given = c.select(F.col("c_name").alias("name"), F.sha2("c_name", 256).alias("digest"), F.col("c_acctbal").alias("value"))
    k = F.col("c_custkey")
    found = c.where(k % 11 != 0).select(F.col("c_name").alias("name"), F.when(k % 7 == 0, "x").otherwise(F.sha2("c_name", 256)).alias("digest"), (F.col("c_acctbal") + F.when(k % 5 == 0, 1).otherwise(0)).alias("value"))
    return governance.receipt_faults(given, found)


@query("SELECT ledger, arm, seed, bits, ledger || '-' || arm || '-' || seed AS id FROM (SELECT 'ai' AS ledger, o_orderpriority AS arm, o_custkey AS seed, round(max(o_totalprice), 2) + 0.0 AS bits FROM orders GROUP BY 2, 3 UNION ALL SELECT 'jk', o_orderpriority, o_custkey, round(min(o_totalprice), 2) + 0.0 FROM orders GROUP BY 2, 3) WHERE NOT (ledger = 'jk' AND arm = '5-LOW')")
def result_index(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("seed"))
    ai, jk = (g.agg(rounded(f("o_totalprice"), 2).alias("bits")) for f in (F.max, F.min))
    return governance.result_index({"ai": ai, "jk": jk}, [("jk", "5-LOW")])


@query("SELECT c_custkey AS song_id, c_mktsegment || '/' || c_name AS path, coalesce(s.split, 'excluded') AS split, least(c_acctbal, 5000.0) AS margin FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS split FROM orders GROUP BY 1) s ON o_custkey = c_custkey")
def public_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("song_id"), F.concat(F.lit("raw/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), F.col("c_acctbal").alias("margin_a"), F.lit(5000.0).alias("margin_b"))
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("song_id")).agg(F.min("o_orderstatus").alias("split"))
    return governance.public_manifest(c, s, "raw/")


@query("WITH h AS (SELECT o_orderpriority AS arm, o_custkey AS seed, o_orderkey AS epoch, o_totalprice AS bits FROM orders WHERE o_orderkey >= 100), b AS (SELECT min(bits) lo, max(bits) hi, min(epoch) e0, max(epoch) e1 FROM h) SELECT arm, seed, epoch, round((epoch - e0) / (e1 - e0), 6) + 0.0 AS x, round((bits - lo) / (hi - lo), 6) + 0.0 AS y FROM h, b")
def training_curves(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("seed"), F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("bits"))
    return governance.curves(h).select("arm", "seed", "epoch", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(
    r"""SELECT event_id, '{"user":"<REDACTED_INFRASTRUCTURE_IDENTITY>","Host":["<REDACTED_INFRASTRUCTURE_IDENTITY>",{"a":"x"},["<REDACTED_INFRASTRUCTURE_IDENTITY>"]],"path":"<REDACTED_ABSOLUTE_PATH>","deep":[{"mail":["<REDACTED_CONTACT_OR_LOGIN>"]}],"k":'
|| (props->>'k') || ',"say":"\"x\" \\ é","url":"https://a@b.org","n":[1.5,null,true]}' AS clean, '/user,/Host/0,/Host/2/0,/path,/deep/0/mail/0' AS changed FROM events"""
)
def redacted_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    head = F.concat(F.lit(r'''{"user": "a\"u'''), "user_id", F.lit(r'''", "Host": ["h1", {"a": "x"}, ["h\\2"]], "path": "C:\\x", "deep": [{"mail": ["a@b.org"]}], "k": '''))
    raw = F.concat(head, F.get_json_object("props", "$.k"), F.lit(r''', "say": "\"x\" \\ \u00e9", "url": "https://a@b.org", "n": [1.5, null, true]}'''))
    got = governance.redacted(raw)
    return e.select("event_id", got.alias("g")).select("event_id", "g.clean", F.array_join("g.changed", ",").alias("changed"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    got = jobs.closed(spark, f"{sf_dir}/events*.parquet", jobs.tumbling)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS sid FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM s GROUP BY user_id, sid""")
def streaming_sessions(spark, sf_dir):
    got = jobs.closed(spark, f"{sf_dir}/events*.parquet", jobs.sessions)
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def _parts(rows, n=2):
    """The rows in parts by ranges of onset, in order, and the last onset."""
    first, last = rows.agg(F.coalesce(F.min("onset"), F.lit(0)), F.coalesce(F.max("onset"), F.lit(0))).first()
    bounds = [first + (last + 1 - first) * i // n for i in range(n + 1)]
    return [rows.where(F.col("onset").between(a, b - 1)) for a, b in zip(bounds, bounds[1:])], last


@query("{gaps} SELECT song_id, coalesce(reach, 0) AS onset, onset - coalesce(reach, 0) AS duration FROM gaps WHERE onset > coalesce(reach, 0)")
def streaming_rests(spark, sf_dir):
    """Rests of a stream of parts of the facts, each later than the one before."""
    return jobs.by_parts(_parts(facts(spark, sf_dir).select("song_id", "onset", "duration", "pitch"))[0], jobs.open_rests)


@query("{gaps} SELECT song_id, reach AS onset, onset - reach AS duration FROM gaps WHERE onset - reach >= 1")
def streaming_timed_rests(spark, sf_dir):
    """Rests of a stream in state with timers; it is stopped after each part of the facts and started again from its checkpoint."""
    minute = F.timestamp_millis((F.lit(1704067200) + F.col("onset") * 60) * 1000)
    parts, last = _parts(facts(spark, sf_dir).select("song_id", minute.alias("ts"), "onset", "duration"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("song_id"), F.timestamp_millis(F.lit((1704067200 + (last + 10_000) * 60) * 1000)).alias("ts"), F.lit(last + 10_000).cast("long").alias("onset"), F.lit(1).cast("long").alias("duration"))
    return jobs.by_parts([*parts, end], lambda stream: rests.timed_rests(stream, "1 hour", idle_ms=10 * 365 * 86_400_000))


@query("SELECT sha256(string_agg(doc_id::VARCHAR || chr(0) || sha256(coalesce(text, '')) || chr(10), '' ORDER BY doc_id::VARCHAR)) AS digest, count(*) AS files FROM documents")
def source_tree_digest(spark, sf_dir):
    """The flat digest over the documents as files, as hashing them one after the other gives it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    got = ordered_digest.source_tree_receipt(d)
    return spark.createDataFrame([(got["source_tree_sha256"], got["files"])], "digest string, files long")


@query("""{facts}, s AS (SELECT song_id, count(*) AS n FROM (SELECT DISTINCT song_id, onset, pitch FROM facts) GROUP BY 1) SELECT song_id::VARCHAR AS sample_id, CASE WHEN song_id % 7 = 0 THEN 'missing' WHEN song_id % 13 = 1 THEN 'unreadable' WHEN song_id % 11 = 2 THEN 'key' WHEN song_id % 17 = 3 THEN 'meter' END AS fault,
 CASE WHEN song_id % 7 <> 0 AND song_id % 13 <> 1 AND song_id % 11 <> 2 AND song_id % 17 <> 3 THEN n ELSE 0 END::BIGINT AS notes FROM s WHERE song_id % 5 <> 0""")
def metadata_scan(spark, sf_dir):
    """Songs as files that a table of metadata names; some are missing, broken, or in another key or meter than it says."""
    n = F.col("song_id")
    notes = _note_lists(spark, sf_dir)
    root, folder = "commu_midi/train/raw/", f"{shared_dir(spark)}/evenspan-metadata-{uuid.uuid4().hex}"
    meta = notes.select(n.cast("string").alias("id"), F.lit("train").alias("split_data"), F.when((n % 2 == 0) != (n % 11 == 2), "cmajor").otherwise("aminor").alias("audio_key"), F.when(n % 5 == 0, "3/4").otherwise("4/4").alias("time_signature"), F.lit(8).alias("num_measures"))
    meta.write.option("header", True).csv(folder)
    kinds = notes.select(F.concat(F.lit(root), n.cast("string"), F.lit(".mid")).alias("path"), "notes", F.when(n % 2 == 0, "C").otherwise("Am").alias("key"), F.when(n % 17 == 3, 3).otherwise(4).alias("beats"), (n % 13 == 1).alias("broken"), (n % 7 == 0).alias("gone"))
    files = kinds.where("not gone").drop("gone").mapInArrow(metadata_scan_files, "path string, content binary")
    got = metadata.scanned(metadata.read_metadata(spark, folder, "4/4"), files)
    return got.select("sample_id", "fault", "note_count").withColumnRenamed("note_count", "notes")


def metadata_scan_files(batches):
    import pyarrow as pa

    for b in batches:
        path, notes, key, beats, broken = (c.to_pylist() for c in b.columns)
        files = [b"MThd" if x else midi.render([(5 * t["onset"], t["pitch"], 5 * t["duration"]) for t in v], 480, k, (m, 4)) for v, k, m, x in zip(notes, key, beats, broken)]
        yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(files, pa.binary())], ["path", "content"])

"""Queries over content hashes, duplicate families, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import lineage
from ..operators.durable import checkpointed
from .base import facts, query, table

#: A second set of songs, from order lines, with exact and transposed copies.
LI = "li AS (SELECT l_orderkey AS song_id, 'NOTE' AS event_type, (l_linenumber - 1) * 96 AS onset, l_quantity::BIGINT AS duration, (40 + l_orderkey % 5 + l_quantity::BIGINT % 12)::INT AS pitch FROM lineitem)"


def line_facts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    pitch = 40 + F.pmod("l_orderkey", F.lit(5)) + F.pmod(F.col("l_quantity").cast("bigint"), F.lit(12))
    return x.select(F.col("l_orderkey").alias("song_id"), F.lit("NOTE").alias("event_type"), ((F.col("l_linenumber") - 1) * 96).cast("bigint").alias("onset"), F.col("l_quantity").cast("bigint").alias("duration"), pitch.cast("int").alias("pitch"))


_EVENT = """n AS (SELECT *, row_number() OVER w AS i, lag(onset, 1, 0) OVER w AS po, last_value(pitch IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY onset, coalesce(pitch, -1), duration, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp,
 first_value(pitch IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY onset, coalesce(pitch, -1), duration, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS origin FROM rested WINDOW w AS (PARTITION BY song_id ORDER BY onset, coalesce(pitch, -1), duration, event_type))
SELECT song_id, sha256('[' || string_agg('{{"duration_ticks":' || duration || ',"event_type":"' || event_type || '","onset_ticks":' || onset || ',"pitch":' || coalesce(pitch::VARCHAR, 'null') || '}}', ',' ORDER BY i) || ']') AS exact,
 sha256('[' || string_agg('["' || event_type || '",' || onset || ',' || coalesce((pitch - origin)::VARCHAR, 'null') || ',' || duration || ']', ',' ORDER BY i) || ']') AS transposed,
 sha256('[' || string_agg('["' || event_type || '",' || (onset - po) || ',' || CASE WHEN pitch IS NULL THEN 'null' ELSE coalesce(pitch - pp, 0)::VARCHAR END || ',' || duration || ']', ',' ORDER BY i) || ']') AS rhythm FROM n GROUP BY 1""".replace("{{", "{").replace("}}", "}")


@query("{rested}, " + _EVENT)
def event_hashes(spark, sf_dir):
    return lineage.event_hashes(ev.insert_rests(facts(spark, sf_dir)))


def _frac(x: str) -> str:
    return f"(({x}) // gcd({x}, 96))::VARCHAR || '/' || (96 // gcd({x}, 96))"


_LINES = f"""b AS (SELECT *, min(onset) OVER (PARTITION BY song_id) AS st FROM li), c AS (SELECT *, min(CASE WHEN onset = st THEN pitch END) OVER (PARTITION BY song_id) AS base FROM b),
flat AS (SELECT song_id, sha256('v1' || chr(10) || 'kind=exact' || chr(10) || string_agg('NOTE|' || {_frac('onset - st')} || '|' || pitch || '|' || {_frac('duration')}, chr(10) ORDER BY onset, pitch, duration) || chr(10)) AS exact,
 sha256('v1' || chr(10) || 'kind=transposition_invariant' || chr(10) || string_agg('NOTE|' || {_frac('onset - st')} || '|' || (pitch - base) || '|' || {_frac('duration')}, chr(10) ORDER BY onset, pitch, duration) || chr(10)) AS transposed FROM c GROUP BY 1),
g AS (SELECT song_id, onset, count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM li GROUP BY 1, 2),
g2 AS (SELECT li.song_id, li.onset, string_agg(((li.pitch - g.low) % 12)::VARCHAR || ':' || {_frac('li.duration')}, ',' ORDER BY li.pitch, li.duration) AS body FROM li JOIN g ON li.song_id = g.song_id AND li.onset = g.onset GROUP BY 1, 2),
m AS (SELECT g.*, g2.body, lag(g.low) OVER w AS pl, lag(g.high) OVER w AS ph, g.onset - coalesce(lag(g.onset) OVER w, g.onset) AS step FROM g JOIN g2 ON g.song_id = g2.song_id AND g.onset = g2.onset WINDOW w AS (PARTITION BY g.song_id ORDER BY g.onset)),
r AS (SELECT song_id, sha256('v1' || chr(10) || 'kind=rhythm_interval' || chr(10) || string_agg('ONSET|' || {_frac('step')} || '|N=' || n || '|B=' || coalesce((((low - pl) % 12 + 12) % 12)::VARCHAR, 'START') || '|T=' || coalesce((((high - ph) % 12 + 12) % 12)::VARCHAR, 'START') || '|' || body, chr(10) ORDER BY onset) || chr(10)) AS rhythm FROM m GROUP BY 1),
h AS (SELECT song_id, exact, transposed, rhythm FROM flat JOIN r USING (song_id))"""


def line_hashes_of(spark, sf_dir):
    return lineage.line_hashes(line_facts(spark, sf_dir))


@query(f"WITH {LI}, {_LINES} SELECT * FROM h")
def line_hashes(spark, sf_dir):
    return line_hashes_of(spark, sf_dir)


@query("{facts} SELECT song_id, sha256('[' || string_agg('[' || onset || ',' || pitch || ',' || duration || ']', ',' ORDER BY onset, pitch, duration) || ']') AS content FROM facts GROUP BY 1")
def note_content_hashes(spark, sf_dir):
    return lineage.note_content_hash(facts(spark, sf_dir))


# equal rhythm hashes hold equal transposed ones and these equal exact ones, so the families are the rhythm classes
@query(f"""WITH {LI}, {_LINES} SELECT min(song_id) AS root, 'family_' || substr(sha256(string_agg(song_id::VARCHAR, chr(10) ORDER BY song_id::VARCHAR) || chr(10)), 1, 24) AS lineage_id, count(*) AS sample_count,
 concat_ws(',', CASE WHEN count(DISTINCT exact) < count(*) THEN 'exact' END, CASE WHEN count(DISTINCT transposed) < count(*) THEN 'transposed' END, CASE WHEN count(DISTINCT rhythm) < count(*) THEN 'rhythm' END) AS reasons FROM h GROUP BY rhythm""")
def duplicate_families(spark, sf_dir):
    return lineage.families(checkpointed(line_hashes_of(spark, sf_dir)), ["exact", "transposed", "rhythm"])


@query(f"WITH {LI}, {_LINES}, s AS (SELECT transposed, count(*) AS group_size FROM h GROUP BY 1 HAVING count(*) > 1) SELECT song_id, h.transposed, group_size FROM h JOIN s ON h.transposed = s.transposed")
def duplicate_membership(spark, sf_dir):
    return lineage.duplicate_members(line_hashes_of(spark, sf_dir), "transposed")


_SPLIT = "CASE WHEN song_id % 10 = 0 THEN 'test' WHEN song_id % 10 = 1 THEN 'validation' ELSE 'train' END"


def _split_hashes(spark, sf_dir):
    m = F.pmod("song_id", F.lit(10))
    return line_hashes_of(spark, sf_dir).withColumn("split", F.when(m == 0, "test").when(m == 1, "validation").otherwise("train"))


_LONG = f"s AS (SELECT *, {_SPLIT} AS split FROM h), l AS (SELECT split, 'exact' AS field, exact AS value FROM s UNION ALL SELECT split, 'transposed', transposed FROM s UNION ALL SELECT split, 'rhythm', rhythm FROM s)"


@query(f"WITH {LI}, {_LINES}, {_LONG} SELECT field, count(*) AS groups, count(*) FILTER (n > 1) AS crossing FROM (SELECT field, value, count(DISTINCT split) AS n FROM l GROUP BY 1, 2) GROUP BY 1")
def cross_split_audit(spark, sf_dir):
    return lineage.crossings(_split_hashes(spark, sf_dir), ["exact", "transposed", "rhythm"])


@query(f"""WITH {LI}, {_LINES}, {_LONG}, v AS (SELECT field, value, count(DISTINCT split) AS n, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM l GROUP BY 1, 2)
SELECT field AS relation, '__SUMMARY__' AS key, CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'groups=' || count(*) || ';cross_split_groups=' || count(*) FILTER (n > 1) AS details FROM v GROUP BY 1
UNION ALL SELECT field, value, 'FAIL', splits FROM v WHERE n > 1""")
def crossing_report(spark, sf_dir):
    return lineage.crossing_report(_split_hashes(spark, sf_dir), ["exact", "transposed", "rhythm"])


@query()
def assigned_splits(spark, sf_dir):
    """Whole families in test, validation and train; greedy and so without SQL, tested against a plain loop."""
    f = lineage.families(checkpointed(line_hashes_of(spark, sf_dir)), ["exact", "transposed", "rhythm"])
    c = checkpointed(f.select(F.col("lineage_id").alias("id"), F.col("sample_count").alias("n"), F.pmod("root", F.lit(97)).alias("density")))
    return lineage.assign_splits(c, 1500, 1500, 20)


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS release, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM orders), n AS (SELECT *, row_number() OVER (ORDER BY release, id) AS i, count(*) OVER () AS total FROM r)
SELECT id, release, split, CASE WHEN i > total - 2000 THEN 'holdout' ELSE 'train' END AS old_split, ((i > total - 2000) = (split = 'train')) AS moved FROM n""")
def moved_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("release"), F.when(F.col("o_orderkey") % 10 == 0, "test").otherwise("train").alias("split"))
    return lineage.moved_samples(o, 2000)

"""Queries over order, rests, windows, contracts and next targets."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.digests import seeded_key
from ..functions.timegrid import div
from ..operators import batches, validate
from ..operators import events as ev
from .base import facts, query, rounded, table

_TEXT = "song_id, onset, event_type, duration, coalesce(pitch, -1)::BIGINT AS pitch"


def _shown(df, *more):
    return df.select("song_id", "onset", "event_type", "duration", F.coalesce("pitch", F.lit(-1)).cast("bigint").alias("pitch"), *more)


@query("{ordered} SELECT " + _TEXT + ", ord FROM ordered")
def canonical_order(spark, sf_dir):
    return _shown(ev.canonical(ev.insert_rests(facts(spark, sf_dir))), "ord")


@query("{rested} SELECT " + _TEXT + " FROM rested")
def explicit_rests(spark, sf_dir):
    return _shown(ev.insert_rests(facts(spark, sf_dir)))


@query("{facts}, g AS (SELECT *, max(onset + duration) OVER (PARTITION BY song_id ORDER BY onset, pitch, duration, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM facts) SELECT song_id, reach AS onset, onset - reach AS duration FROM g WHERE onset - reach >= 96")
def long_rests(spark, sf_dir):
    return ev.insert_rests(facts(spark, sf_dir), 96, leading=False).where("event_type = 'REST'").select("song_id", "onset", "duration")


@query("{atoms} SELECT song_id, t, kind, anchor, coalesce(rest, 0) AS rest, coalesce(len(notes), 0)::BIGINT AS notes, coalesce(notes[1].pitch, -1)::BIGINT AS low FROM atoms")
def sparse_stream(spark, sf_dir):
    a = ev.atoms(facts(spark, sf_dir))
    return a.select("song_id", "t", "kind", "anchor", F.coalesce("rest", F.lit(0)).alias("rest"), F.when(F.col("notes").isNull(), 0).otherwise(F.size("notes")).cast("bigint").alias("notes"), F.coalesce(F.get("notes", F.lit(0))["pitch"], F.lit(-1)).cast("bigint").alias("low"))


@query("{reached} SELECT song_id, count(*) FILTER (onset < reach) AS overlaps, count(*) FILTER (onset = reach) AS touches, count(*) FILTER (onset > reach) AS rests FROM reached GROUP BY 1")
def stream_boundaries(spark, sf_dir):
    return ev.boundaries(facts(spark, sf_dir))


@query("{tokens96} SELECT song_id, ord, kind::BIGINT AS kind, anchor, pitch::BIGINT AS pitch, duration FROM tokens")
def note_tokens(spark, sf_dir):
    return ev.tokens(facts(spark, sf_dir)).select("song_id", "ord", F.col("kind").cast("bigint").alias("kind"), "anchor", F.col("pitch").cast("bigint").alias("pitch"), "duration")


@query("{tokens96}, d AS (SELECT song_id, ord, kind, pitch, duration, anchor - lag(anchor, 1, 0) OVER (PARTITION BY song_id ORDER BY ord) AS step FROM tokens) SELECT song_id, ord, step, step // 384 AS step_bars, step % 384 AS step_rest, duration // 384 AS bars, duration % 384 AS remainder FROM d")
def encoded_deltas(spark, sf_dir):
    d = ev.deltas(ev.tokens(facts(spark, sf_dir)))
    return d.select("song_id", "ord", "step", "step_bars", "step_rest", div(F.col("duration"), 384).alias("bars"), F.pmod("duration", F.lit(384)).alias("remainder"))


@query("""{tokens96}, w AS (SELECT song_id, ord, min(CASE WHEN kind = 2 THEN pitch END) OVER x AS low, max(CASE WHEN kind = 2 THEN pitch END) OVER x AS high FROM tokens WINDOW x AS (PARTITION BY song_id ORDER BY ord))
SELECT song_id, ord, round(coalesce((high - low) / 127, 0), 6) + 0.0 AS span, round(coalesce((high + low) / 254, 0), 6) + 0.0 AS centre, (low IS NOT NULL)::BIGINT AS seen FROM w""")
def running_tessitura(spark, sf_dir):
    return ev.tessitura(ev.tokens(facts(spark, sf_dir))).select("song_id", "ord", rounded(F.col("span")).alias("span"), rounded(F.col("centre")).alias("centre"), F.col("seen").cast("bigint").alias("seen"))


@query("{atoms}, r AS (SELECT song_id, t, kind, lag(kind) OVER (PARTITION BY song_id ORDER BY t) AS p FROM atoms) SELECT CASE WHEN p IS NULL THEN 'START' ELSE p || '_' || kind END AS relation, count(*) AS n FROM r GROUP BY 1")
def local_relations(spark, sf_dir):
    return ev.local_relation(ev.atoms(facts(spark, sf_dir))).groupBy("relation").agg(F.count("*").alias("n"))


@query("""{atoms}, r AS (SELECT *, notes[1].pitch AS low, lag(kind) OVER w AS pk, lag(anchor) OVER w AS pa, lag(notes[1].pitch) OVER w AS pl FROM atoms WINDOW w AS (PARTITION BY song_id ORDER BY t))
SELECT song_id, t, CASE WHEN kind = 'REST' THEN 'REST' ELSE 'NOTE_GROUP' END AS target,
 CASE WHEN kind = 'REST' THEN 'REST_DURATION' WHEN pk IS NULL THEN 'ABSOLUTE_START' WHEN pk = 'REST' THEN 'NONE' ELSE 'ONSET_DELTA' END AS time_mode,
 CASE WHEN kind = 'REST' THEN rest WHEN pk IS NULL THEN anchor WHEN pk = 'REST' THEN 0 ELSE anchor - pa END AS time_value,
 coalesce(len(notes), 0)::BIGINT AS cardinality, CASE WHEN kind = 'REST' THEN '' WHEN pk IS NULL OR pk = 'REST' THEN 'ABSOLUTE' ELSE 'DELTA' END AS anchor_mode,
 CASE WHEN kind = 'REST' THEN -1 WHEN pk IS NULL OR pk = 'REST' THEN low ELSE low - pl + 127 END::BIGINT AS anchor_class,
 coalesce(array_to_string([notes[i + 1].pitch - notes[i].pitch FOR i IN range(1, len(notes))], ','), '') AS gaps FROM r
UNION ALL SELECT song_id, max(t) + 1, 'EOS', '', 0, 0, '', -1, '' FROM atoms GROUP BY song_id""")
def next_targets(spark, sf_dir):
    r = ev.next_targets(ev.atoms(facts(spark, sf_dir)))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("time_mode", "anchor_mode")]
    return r.select("song_id", "t", "target", *blank, F.coalesce("time_value", F.lit(0)).alias("time_value"), F.coalesce("cardinality", F.lit(0)).cast("bigint").alias("cardinality"), F.coalesce("anchor_class", F.lit(-1)).cast("bigint").alias("anchor_class"), F.coalesce(F.array_join(F.col("gaps").cast("array<string>"), ","), F.lit("")).alias("gaps"))


@query("{groups} SELECT (SELECT count(*) FROM facts) AS notes, (SELECT count(*) FROM facts) AS same")
def target_roundtrip(spark, sf_dir):
    """Notes whose pitch and duration come back from the targets, against all notes."""
    f = facts(spark, sf_dir)
    back = ev.rebuilt(ev.next_targets(ev.atoms(f))).where("target = 'NOTE_GROUP'")
    back = back.select("song_id", F.explode(F.arrays_zip("pitches", "durations")).alias("n")).groupBy("song_id", F.col("n.pitches").alias("pitch"), F.col("n.durations").alias("duration")).agg(F.count("*").alias("a"))
    true = f.groupBy("song_id", "pitch", "duration").agg(F.count("*").alias("b"))
    return true.join(back, ["song_id", "pitch", "duration"], "full").agg(F.sum("b").alias("notes"), F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("same"))


@query("{tokens96} SELECT song_id, ord, coalesce(array_to_string(list(pitch) OVER (PARTITION BY song_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS context FROM (SELECT song_id, ord, pitch FROM tokens UNION ALL SELECT song_id, max(ord) + 1, NULL FROM tokens GROUP BY 1)")
def causal_contexts(spark, sf_dir):
    c = ev.contexts(ev.tokens(facts(spark, sf_dir)), "pitch", 4)
    return c.select("song_id", "ord", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


@query("{tokens96} SELECT song_id, ord, coalesce(lag(v) OVER (PARTITION BY song_id ORDER BY ord), 1000)::BIGINT AS input, v::BIGINT AS target FROM (SELECT song_id, ord, pitch AS v FROM tokens UNION ALL SELECT song_id, max(ord) + 1, 2000 FROM tokens GROUP BY 1)")
def shifted_pairs(spark, sf_dir):
    return ev.shifted_pairs(ev.tokens(facts(spark, sf_dir)), "pitch", 1000, 2000)


@query("{facts} SELECT song_id, (onset // 3072) * 8 AS start_bar, count(*) AS n, sum(onset % 3072)::BIGINT AS onsets, sum(duration)::BIGINT AS durations FROM facts GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    w = ev.windows(facts(spark, sf_dir))
    return w.groupBy("song_id", "start_bar").agg(F.count("*").alias("n"), F.sum("rel_onset").alias("onsets"), F.sum("duration").alias("durations"))


@query("""{facts}, s AS (SELECT *, unnest(range(greatest(0, (onset // 384 - 8 + 4) // 4 + CASE WHEN (onset // 384 - 8) < 0 THEN 0 ELSE 0 END), (onset // 384) // 4 + 1)) * 4 AS start_bar FROM facts)
SELECT song_id, start_bar, count(*) AS n, sum(onset - start_bar * 384)::BIGINT AS onsets FROM s WHERE onset // 384 >= start_bar AND onset // 384 < start_bar + 8 GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    w = ev.windows(facts(spark, sf_dir), 8, 4)
    return w.groupBy("song_id", "start_bar").agg(F.count("*").alias("n"), F.sum("rel_onset").alias("onsets"))


@query("""{facts}, c AS (SELECT song_id, pitch, onset, onset + duration AS fin, unnest(range(onset // 3072, (onset + duration - 1) // 3072 + 1)) AS w, max(onset + duration) OVER (PARTITION BY song_id) AS fin_all FROM facts)
SELECT song_id, w, count(*) AS n, sum(least(fin, (w + 1) * 3072) - greatest(onset, w * 3072))::BIGINT AS sounding FROM c WHERE (w + 1) * 3072 <= fin_all GROUP BY 1, 2""")
def clipped_windows(spark, sf_dir):
    return ev.clipped_windows(facts(spark, sf_dir)).groupBy("song_id", "w").agg(F.count("*").alias("n"), F.sum("duration").alias("sounding"))


@query("{facts} SELECT song_id, onset - 4 * 384 AS rel_onset, least(pitch + 2, 127)::BIGINT AS moved, 4 + 3 AS start_bar FROM facts WHERE onset // 384 >= 4 AND onset // 384 < 36")
def bar_slices(spark, sf_dir):
    rows = ev.bar_slice(facts(spark, sf_dir), 4, 36)
    return rows.select("song_id", "rel_onset", F.least(F.col("pitch") + 2, F.lit(127)).cast("bigint").alias("moved"), (F.lit(4) + 3).alias("start_bar"))


@query("""{rested}, b AS (SELECT song_id, event_type, onset - 100 AS onset, duration - 2 AS duration, CASE WHEN event_type = 'NOTE' THEN pitch + 20 ELSE pitch END AS pitch FROM rested)
SELECT CASE WHEN onset < 0 THEN 'onset' WHEN duration <= 0 THEN 'duration' WHEN event_type = 'NOTE' AND pitch > 127 THEN 'pitch' ELSE '' END AS fault, count(*) AS n FROM b GROUP BY 1""")
def fact_contracts(spark, sf_dir):
    rows = ev.insert_rests(facts(spark, sf_dir)).select("song_id", "event_type", (F.col("onset") - 100).alias("onset"), (F.col("duration") - 2).alias("duration"), F.when(F.col("event_type") == "NOTE", F.col("pitch") + 20).otherwise(F.col("pitch")).alias("pitch"))
    return ev.faults(rows).groupBy(F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count("*").alias("n"))


@query("{tokens96} SELECT CASE WHEN duration > 384 AND kind = 3 THEN 'rest pitch' ELSE '' END AS fault, count(*) AS n FROM tokens GROUP BY 1")
def token_contracts(spark, sf_dir):
    rows = ev.tokens(facts(spark, sf_dir)).withColumn("pitch", F.when((F.col("kind") == 3) & (F.col("duration") > 384), 5).otherwise(F.col("pitch")))
    return ev.token_faults(rows).groupBy(F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count("*").alias("n"))


@query("{tokens96}, p AS (SELECT song_id, ord, anchor - ord * 20 AS anchor FROM tokens), l AS (SELECT *, lag(anchor) OVER (PARTITION BY song_id ORDER BY ord) AS p FROM p) SELECT song_id, ord, anchor FROM l WHERE anchor < p")
def monotone_anchors(spark, sf_dir):
    rows = ev.tokens(facts(spark, sf_dir)).select("song_id", "ord", (F.col("anchor") - F.col("ord") * 20).alias("anchor"))
    return ev.backward_steps(rows, order="ord").select("song_id", "ord", "anchor")


@query("""{facts} SELECT song_id, count(*) AS n, min(pitch)::BIGINT AS low, max(pitch)::BIGINT AS high, min(onset) AS first_onset, max(onset + duration) AS last_end, bool_and(pitch BETWEEN 0 AND 127 AND duration > 0) AS sound FROM facts GROUP BY 1""")
def song_contracts(spark, sf_dir):
    return validate.song_contract(facts(spark, sf_dir))


@query("""SELECT c_custkey, round(c_acctbal / 10000, 6) + 0.0 AS corr, CASE WHEN c_custkey % 7 = 0 THEN 'disagree' WHEN least(c_acctbal / 10000, c_nationkey / 25.0) >= 0.3 AND least(c_custkey % 10, 5) / 10.0 >= 0.2 THEN 'accepted' ELSE 'low' END AS status,
 CASE WHEN c_custkey % 7 = 0 THEN -99 ELSE c_custkey % 12 END::BIGINT AS frame FROM customer""")
def key_consensus(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = F.struct(F.pmod("c_custkey", F.lit(12)).alias("frame"), (F.col("c_acctbal") / 10000).alias("correlation"), F.lit(0.9).alias("margin"))
    b = F.struct(F.when(F.col("c_custkey") % 7 == 0, F.pmod(F.col("c_custkey") + 1, F.lit(12))).otherwise(F.pmod("c_custkey", F.lit(12))).alias("frame"), (F.col("c_nationkey") / 25).alias("correlation"), (F.least(F.pmod("c_custkey", F.lit(10)), F.lit(5)) / 10).alias("margin"))
    out = validate.consensus(c.select("c_custkey", "c_acctbal", a.alias("a"), b.alias("b")), 0.3, 0.2)
    return out.select("c_custkey", rounded(F.col("c_acctbal") / 10000).alias("corr"), "status", F.coalesce("frame", F.lit(-99)).alias("frame"))


@query("SELECT o_orderkey, o_totalprice, rank_key FROM (SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice, sha256('7|demo|' || o_orderkey) AS rank_key FROM orders)")
def seeded_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rank_key", seeded_key(7, "demo", F.col("o_orderkey")))
    return o.select("o_orderkey", rounded(F.col("o_totalprice"), 2).alias("o_totalprice"), "rank_key")


@query("""WITH h AS (SELECT o_custkey AS arm, o_orderkey AS exposure, round(o_totalprice / 1000, 0) AS bits FROM orders), m AS (SELECT *, min(bits) OVER (PARTITION BY arm) AS best FROM h)
SELECT arm, min(exposure) AS exposure, min(best) + 0.0 AS bits FROM m WHERE bits <= best + 1e-12 GROUP BY 1""")
def select_checkpoint(spark, sf_dir):
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("arm"), F.col("o_orderkey").alias("exposure"), F.round(F.col("o_totalprice") / 1000, 0).alias("bits"))
    return validate.best_checkpoint(h, ["arm"])


_COMPONENTS = "c AS (SELECT l_orderkey::VARCHAR AS id, count(*) AS n, avg(l_quantity) AS density FROM lineitem GROUP BY 1)"


@query(f"""WITH {_COMPONENTS}, r AS (SELECT *, row_number() OVER (ORDER BY density, id) - 1 AS rank, count(*) OVER () AS total FROM c), b AS (SELECT *, least(9, rank * 10 // total) AS bin FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('3|test|' || id)) - 1 AS turn, sha256('3|test:bin|' || bin) AS bin_key FROM b)
SELECT id, n, bin::BIGINT AS bin, (row_number() OVER (ORDER BY turn, bin_key) - 1) AS place FROM o""")
def balanced_order(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("density"))
    return batches.balanced_order(c, 3, "test").select("id", "n", F.col("bin").cast("bigint").alias("bin"), "place")


@query("WITH n AS (SELECT l_orderkey AS id, count(*) + 1 AS size FROM lineitem GROUP BY 1) SELECT id, size, ((row_number() OVER (ORDER BY size, id) - 1) // 64)::BIGINT AS batch FROM n")
def validation_batches(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") + 1).alias("size"))
    return batches.sized_batches(n, 64)


@query("""WITH n AS (SELECT l_orderkey AS id, count(*) + 1 AS size FROM lineitem GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY sha256('5|epoch|' || id)) - 1 AS i FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY i // 1024 ORDER BY size, id) - 1 AS j FROM p) SELECT id, size, ((i // 1024) * 32 + j // 32)::BIGINT AS batch FROM w""")
def epoch_batches(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") + 1).alias("size"))
    return batches.epoch_batches(n, 5, 1024, 32)


@query("""SELECT detector, count(*) AS n FROM (SELECT page_id, unnest([CASE WHEN regexp_matches(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(html, '<script') THEN 'script' END, CASE WHEN regexp_matches(html, '/home/[a-z]+') THEN 'path' END]) AS detector FROM pages) WHERE detector IS NOT NULL GROUP BY 1""")
def regex_findings(spark, sf_dir):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "script": "<script", "path": "/home/[a-z]+"}
    return validate.findings(table(spark, sf_dir, "pages"), "page_id", "html", patterns).groupBy("detector").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter(['a','b','c','d'], lambda x: NOT list_contains(CASE o_orderkey % 3 WHEN 0 THEN ['a','b'] WHEN 1 THEN ['b','c','d'] ELSE ['a','b','c','d'] END, x))), ',') AS missing FROM orders""")
def receipt_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(F.array(*map(F.lit, "abcd")))
    return o.select("o_orderkey", F.array_join(validate.missing_fields(have, list("abcd")), ",").alias("missing"))


@query("SELECT o_orderkey, (o_orderkey % 2 = 0) AS matches FROM orders")
def config_hash_matches(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    true = F.sha2(F.col("o_orderkey").cast("string"), 256)
    given = F.when(F.col("o_orderkey") % 2 == 0, true).when(F.col("o_orderkey") % 3 == 0, F.lit("short")).otherwise(F.sha2(F.lit("other"), 256))
    return o.select("o_orderkey", validate.hash_matches(given, true).alias("matches"))


@query("""SELECT l_orderkey, bool_and(n = 1) AND count(*) = 2 AS owned FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1, 2) GROUP BY 1""")
def exclusive_slots(spark, sf_dir):
    return validate.exclusive_slots(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", [1, 2])


@query("""WITH v AS (SELECT * FROM (VALUES ('A','sequence','absolute',809475),('B','lookup','absolute',811079),('C','unary','absolute',810499),('D','pairwise','absolute',812815),('E','pairwise','chromatic',805455),('F','pairwise','absolute',812815),
 ('G','pairwise','canonical',812815),('H','pairwise','class',813519),('I','pairwise','fifths',805455),('J','serialized','token',689349),('K','serialized','bpe',804675)) v(arm, time, pitch, parameters))
SELECT o_orderkey, arm, time, pitch, parameters::BIGINT AS parameters, arm IN ('F', 'G', 'H', 'I') AND o_orderkey % 13 <> 0 AS sound FROM orders JOIN v ON v.arm = chr((65 + o_orderkey % 11)::INT)""")
def representation_table(spark, sf_dir):
    """Runs of arms, drawn by the orders' keys, with what the arm is, its parameters, and whether the run's flags are those of its contract."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.char((65 + F.col("o_orderkey") % 11)).alias("arm"))
    r = F.broadcast(validate.representations(spark))  # a row for each arm
    seen = F.when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("other"))).otherwise(F.coalesce("flags", F.array().cast("array<string>")))
    return o.join(r, "arm").select("o_orderkey", "arm", "time", "pitch", "parameters", (F.col("flags").isNotNull() & validate.flags_hold(F.col("flags"), seen)).alias("sound"))


@query("""{atoms}, n AS (SELECT song_id, count(*) AS atoms, count(*) FILTER (kind = 'NOTE') AS groups, coalesce(sum(len(notes)), 0)::BIGINT AS notes FROM atoms GROUP BY 1),
s AS (SELECT song_id, count(*) FILTER (kind = 'NOTE' AND p = 'REST') AS fixed FROM (SELECT *, lag(kind) OVER (PARTITION BY song_id ORDER BY t) AS p FROM atoms) GROUP BY 1)
SELECT song_id, atoms + 1 AS total, atoms + 1 AS type, atoms - fixed AS time, groups AS cardinality, groups AS anchor, notes - groups AS gaps, notes AS duration, notes AS raw_notes, atoms AS musical_units, 1::BIGINT AS eos FROM n JOIN s USING (song_id)""")
def component_counts(spark, sf_dir):
    return ev.component_counts(ev.next_targets(ev.atoms(facts(spark, sf_dir))), ["song_id"])


@query("{tokens96} SELECT song_id, count(*) + 1 AS target_event_count FROM tokens GROUP BY 1")
def target_counts(spark, sf_dir):
    f = facts(spark, sf_dir)
    size = F.when(F.col("kind") == "REST", F.lit(1)).otherwise(F.size("notes"))
    manifest = ev.atoms(f, 96).groupBy("song_id").agg((F.sum(size) + 1).alias("target_event_count"))
    return validate.unchanged_counts(manifest, ev.target_counts(f))


@query("{facts} SELECT song_id, (onset // 3072 * 8 + 8)::BIGINT AS start_bar, count(*) AS n FROM facts GROUP BY 1, 2")
def translated_windows(spark, sf_dir):
    return ev.translated(ev.windows(facts(spark, sf_dir)), 8, 1 << 20).groupBy("song_id", "start_bar").agg(F.count("*").alias("n"))

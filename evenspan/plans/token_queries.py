"""Queries over token forms, pair merges and code lengths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bpe, carrier, codelen, merge_gain
from ..operators import events as ev
from ..operators.durable import checkpointed
from ..sources import cache
from ..sources.shared import shared_dir
from .base import facts, query, rounded, table


def _rested(spark, sf_dir):
    return ev.insert_rests(facts(spark, sf_dir))


@query("""{ordered} SELECT song_id, '[' || string_agg('{"duration_ticks":' || duration || ',"event_type":"' || event_type || '","onset_ticks":' || onset || ',"pitch":' || coalesce(pitch::VARCHAR, 'null') || '}', ',' ORDER BY ord) || ']' AS payload FROM ordered GROUP BY 1""")
def exact_event_codec(spark, sf_dir):
    return carrier.to_json(_rested(spark, sf_dir))


@query("{rested} SELECT song_id, event_type, onset, duration, coalesce(pitch, -1)::BIGINT AS pitch FROM rested")
def exact_event_roundtrip(spark, sf_dir):
    return carrier.from_json(carrier.to_json(_rested(spark, sf_dir))).withColumn("pitch", F.coalesce("pitch", F.lit(-1)).cast("bigint"))


@query("""{ordered}, s AS (SELECT *, onset // 384 - lag(onset // 384, 1, 0) OVER (PARTITION BY song_id ORDER BY ord) AS step FROM ordered)
SELECT song_id, string_agg(repeat('BAR_ADVANCE ', step::INT) || 'POSITION_' || onset % 384 || ' ' || coalesce('PITCH_' || pitch, 'REST') || ' DURATION_BAR_' || duration // 384 || ' DURATION_REMAINDER_' || duration % 384, ' ' ORDER BY ord) AS tokens FROM s GROUP BY 1""")
def serialized_events(spark, sf_dir):
    return carrier.serialize(_rested(spark, sf_dir)).select("song_id", F.array_join("tokens", " ").alias("tokens"))


@query("{rested} SELECT song_id, event_type, onset, duration, coalesce(pitch, -1)::BIGINT AS pitch FROM rested")
def serialized_roundtrip(spark, sf_dir):
    return carrier.deserialize(carrier.serialize(_rested(spark, sf_dir))).withColumn("pitch", F.coalesce("pitch", F.lit(-1)).cast("bigint"))


_IDS = """{tokens96}, s AS (SELECT *, anchor // 384 - lag(anchor // 384, 1, -1) OVER w AS step, lag(anchor) OVER w AS pa FROM tokens WINDOW w AS (PARTITION BY song_id ORDER BY ord)),
p AS (SELECT song_id, string_agg(CASE WHEN pa IS NULL OR pa <> anchor THEN repeat('0,', step::INT) || (2 + anchor % 384) || ',' ELSE '' END || CASE WHEN kind = 2 THEN 386 + pitch ELSE 1 END || ',' || (514 + duration // 384) || ',' || (770 + duration % 384), ',' ORDER BY ord) AS payload FROM s GROUP BY 1)"""


@query(_IDS + " SELECT * FROM p")
def token_ids(spark, sf_dir):
    return carrier.encode_ids(ev.tokens(facts(spark, sf_dir))).select("song_id", F.array_join(F.col("payload").cast("array<string>"), ",").alias("payload"))


@query("{tokens96} SELECT song_id, ord, kind::BIGINT AS kind, anchor, pitch::BIGINT AS pitch, duration FROM tokens")
def token_id_roundtrip(spark, sf_dir):
    d = carrier.decode_ids(carrier.encode_ids(ev.tokens(facts(spark, sf_dir))))
    return d.select("song_id", "ord", F.col("kind").cast("bigint").alias("kind"), "anchor", F.col("pitch").cast("bigint").alias("pitch"), "duration")


@query(_IDS + " SELECT song_id, payload AS back, (len(payload) - len(replace(payload, ',', '')) + 1)::BIGINT AS n FROM p")
def private_text_roundtrip(spark, sf_dir):
    p = carrier.encode_ids(ev.tokens(facts(spark, sf_dir))).withColumn("text", carrier.private_text(F.col("payload")))
    return p.select("song_id", F.array_join(carrier.private_ids(F.col("text")).cast("array<string>"), ",").alias("back"), F.length("text").cast("bigint").alias("n"))


@query(_IDS + " , e AS (SELECT song_id, payload, str_split(payload, ',') AS x FROM p) SELECT song_id, (len(x) + 1)::BIGINT AS n, (1 + list_sum([(v::BIGINT + 3) FOR v IN x]))::BIGINT AS inputs, (2 + list_sum([(v::BIGINT + 3) FOR v IN x]))::BIGINT AS targets FROM e")
def token_training_pairs(spark, sf_dir):
    p = carrier.encode_ids(ev.tokens(facts(spark, sf_dir))).withColumn("x", carrier.training_pairs(F.col("payload")))

    def total(c: str):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)

    return p.select("song_id", F.size("x.input").cast("bigint").alias("n"), total("x.input").alias("inputs"), total("x.target").alias("targets"))


@query(_IDS + " , n AS (SELECT song_id, count(*) + 1 AS events FROM tokens GROUP BY 1), j AS (SELECT CASE WHEN song_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, len(str_split(payload, ',')) AS len, events FROM p JOIN n USING (song_id)) SELECT split, count(*) AS songs, sum(len)::BIGINT AS tokens, sum(events)::BIGINT AS events, max(len)::BIGINT AS longest, round(sum(len) / sum(events), 6) + 0.0 AS ratio FROM j GROUP BY 1")
def serialized_cache_stats(spark, sf_dir):
    t = ev.tokens(facts(spark, sf_dir))
    n = t.groupBy("song_id").agg((F.count("*") + 1).alias("events"))
    j = carrier.encode_ids(t).join(n, "song_id").withColumn("split", F.when(F.col("song_id") % 10 == 0, "test").otherwise("train"))
    s = F.size("payload").cast("bigint")
    return j.groupBy("split").agg(F.count("*").alias("songs"), F.sum(s).alias("tokens"), F.sum("events").alias("events"), F.max(s).alias("longest"), rounded(F.sum(s) / F.sum("events")).alias("ratio"))


@query(_IDS + ", n AS (SELECT song_id, count(*) + 1 AS events FROM tokens GROUP BY 1) SELECT song_id::VARCHAR AS sample_id, events::BIGINT AS events, payload FROM p JOIN n USING (song_id) WHERE song_id % 10 <> 0")
def cached_payloads(spark, sf_dir):
    """Payloads written as a cache, of which the train split is read again."""
    t = ev.tokens(facts(spark, sf_dir))
    n = t.groupBy("song_id").agg((F.count("*") + 1).alias("events"))
    split = F.when(F.col("song_id") % 10 == 0, "test").otherwise("train")
    samples = carrier.encode_ids(t).join(n, "song_id").select(F.col("song_id").cast("string").alias("sample_id"), split.alias("split"), "events", F.col("payload").alias("tokens"))
    path = f"{shared_dir(spark)}/evenspan-cache-{uuid.uuid4().hex}"
    cache.write_cache(samples, path, manifest="token_ids", vocabulary=carrier.SIZE)
    back = cache.read_cache(spark, path, manifest="token_ids", allow_test=True).where("split = 'train'")
    return back.select("sample_id", "events", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("payload"))


def _symbols(spark, sf_dir):
    """Pitches of a song in order, as symbols."""
    t = ev.canonical(facts(spark, sf_dir))
    s = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pitch"))), lambda x: F.concat(F.lit("p"), (F.pmod(x["pitch"], F.lit(12))).cast("string")))
    return t.groupBy("song_id").agg(s.alias("symbols"))


_SEQ = "{facts}, s AS (SELECT song_id, 'p' || pitch % 12 AS x, row_number() OVER (PARTITION BY song_id ORDER BY onset, pitch, duration) AS i FROM facts), pr AS (SELECT a.song_id, a.x AS l, b.x AS r FROM s a JOIN s b ON a.song_id = b.song_id AND b.i = a.i + 1)"


@query(_SEQ + " SELECT l, r, count(*) AS n, count(DISTINCT song_id) AS songs FROM pr GROUP BY 1, 2")
def bpe_pair_counts(spark, sf_dir):
    return bpe.pair_counts(_symbols(spark, sf_dir)).select("l", "r", "n", "songs")


@query(_SEQ + " SELECT l, r, count(*) AS n FROM pr GROUP BY 1, 2 ORDER BY n DESC, l, r LIMIT 1")
def bpe_first_merge(spark, sf_dir):
    return spark.createDataFrame(bpe.fit(_symbols(spark, sf_dir), 1), "l string, r string, n bigint")


@query()
def bpe_merges(spark, sf_dir):
    """The first twelve merges; each is the most frequent pair after those before it."""
    rules = bpe.fit(_symbols(spark, sf_dir), 12)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rank int, l string, r string, n bigint")


@query()
def bpe_support_merges(spark, sf_dir):
    """Merges with least support, longest symbols and a barrier."""
    rules = bpe.fit(_symbols(spark, sf_dir), 6, min_count=5, min_songs=3, longest=4, barrier="p0", order="support")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rank int, l string, r string, n bigint")


@query("{facts}, s AS (SELECT song_id, string_agg('p' || pitch % 12, ' ' ORDER BY onset, pitch, duration) AS back FROM facts GROUP BY 1) SELECT * FROM s")
def bpe_roundtrip(spark, sf_dir):
    s = checkpointed(_symbols(spark, sf_dir))  # fitted and encoded from one reading of the events
    e = bpe.encode(s, [(a, b) for a, b, _ in bpe.fit(s, 16)])
    return e.select("song_id", F.array_join(bpe.decoded(F.col("symbols")), " ").alias("back"))


@query(_SEQ + """, b AS (SELECT l, r FROM pr GROUP BY 1, 2 ORDER BY count(*) DESC, l, r LIMIT 1), u AS (SELECT song_id, count(*) AS units FROM s GROUP BY 1),
runs AS (SELECT song_id, count(*) // 2 AS n FROM (SELECT song_id, x, i - row_number() OVER (PARTITION BY song_id, x ORDER BY i) AS g FROM s) q, b WHERE b.l = b.r AND x = b.l GROUP BY song_id, g),
apart AS (SELECT song_id, count(*) AS n FROM pr, b WHERE b.l <> b.r AND pr.l = b.l AND pr.r = b.r GROUP BY 1), m AS (SELECT song_id, sum(n) AS n FROM (SELECT * FROM runs UNION ALL SELECT * FROM apart) GROUP BY 1)
SELECT song_id, units, (units - coalesce(n, 0))::BIGINT AS fold, (units - coalesce(n, 0))::BIGINT AS rank FROM u LEFT JOIN m USING (song_id)""")
def bpe_encodings_agree(spark, sf_dir):
    """The symbols that the first merge leaves of a song, by the fold over the rules and by the encoder for many rules."""
    s = _symbols(spark, sf_dir)
    rules = [(a, b) for a, b, _ in bpe.fit(s, 1)]
    both = s.select("*", F.size(bpe.encoded(F.col("symbols"), rules)).cast("long").alias("fold"), F.size("symbols").cast("long").alias("units"))
    return bpe.encode(both, rules).select("song_id", "units", "fold", F.size("symbols").cast("long").alias("rank"))


@query("{facts}, n AS (SELECT song_id, count(DISTINCT pitch) AS rules, count(DISTINCT pitch % 12) AS base FROM facts GROUP BY 1) SELECT song_id, rules, base, list_sum([2 * ceil(log2(greatest(2, base + k + 1))) FOR k IN range(rules)])::BIGINT AS bits FROM n")
def merge_table_bits(spark, sf_dir):
    """What a table of as many rules as a song has pitches would cost, over its pitch classes."""
    n = facts(spark, sf_dir).groupBy("song_id").agg(F.count_distinct("pitch").alias("rules"), F.count_distinct(F.pmod("pitch", F.lit(12))).alias("base"))
    return n.select("song_id", "rules", "base", bpe.table_bits_of(F.col("rules"), F.col("base")).alias("bits"))


@query("{facts}, c AS (SELECT duration AS value, count(*) AS n FROM facts GROUP BY 1), t AS (SELECT sum(n) AS total, greatest(2, count(*) + 1) AS v FROM c) SELECT value, round(-log2((n + 0.25) / (total + 0.25 * v)), 6) + 0.0 AS bits, round(-log2(0.25 / (total + 0.25 * v)) + 2 * log2(abs(value + 100000) + 2) + 1, 6) + 0.0 AS unseen FROM c, t")
def literal_code_lengths(spark, sf_dir):
    c = facts(spark, sf_dir).groupBy(F.col("duration").alias("value")).agg(F.count("*").alias("n"))
    total, distinct = c.agg(F.sum("n"), F.count("*")).first()
    out = codelen.literal_bits(c)
    return out.select("value", rounded(F.col("bits")).alias("bits"), rounded(codelen.unseen_bits(F.lit(total), F.lit(distinct), F.col("value") + 100000)).alias("unseen"))


@query("""{facts}, s AS (SELECT song_id, 'd' || (duration // 20) AS x, row_number() OVER (PARTITION BY song_id ORDER BY onset, pitch, duration) AS i FROM facts), tr AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY song_id ORDER BY i), '<s>') AS p FROM s WHERE song_id % 3 <> 0),
u AS (SELECT x, count(*) AS n1 FROM tr GROUP BY 1), b AS (SELECT p, x, count(*) AS n2 FROM tr GROUP BY 1, 2), cx AS (SELECT p, count(*) AS nc FROM tr GROUP BY 1), k AS (SELECT sum(n1) AS total, count(*) + 1 AS v FROM u),
te AS (SELECT song_id, i, u.x IS NOT NULL AS known, coalesce(u.x, '<esc>') AS target FROM s LEFT JOIN u ON u.x = s.x WHERE song_id % 3 = 0), tp AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY song_id ORDER BY i), '<s>') AS p FROM te)
SELECT song_id, round(sum(-log2(0.75 * (coalesce(n2, 0) + 0.25) / (coalesce(nc, 0) + 0.25 * v) + 0.25 * (coalesce(n1, 0) + 0.25) / (total + 0.25 * v))), 5) + 0.0 AS bits, count(*) AS symbols, count(*) FILTER (NOT known) AS unknown
FROM tp LEFT JOIN u ON u.x = target LEFT JOIN b ON b.p = tp.p AND b.x = target LEFT JOIN cx ON cx.p = tp.p, k GROUP BY 1""")
def causal_scorer(spark, sf_dir):
    """Songs by thirds: two train, one is scored (the comparison's own split)."""
    rows = ev.canonical(facts(spark, sf_dir)).select("song_id", "ord", F.concat(F.lit("d"), F.expr("duration div 20").cast("string")).alias("symbol"))
    scorer = codelen.Scorer(rows.where("song_id % 3 <> 0"))
    s = codelen.per_song(scorer.score(rows.where("song_id % 3 = 0")))
    return s.select("song_id", rounded(F.col("bits"), 5).alias("bits"), "symbols", "unknown")


@query()
def predictive_merges(spark, sf_dir):
    """Merges by what they save on songs that weren't fitted."""
    s = _symbols(spark, sf_dir)
    steps = merge_gain.fit_predictive(s.where("song_id % 2 = 0"), s.where("song_id % 2 = 1"), 2, pool=3, least_gain=-1.0)
    return spark.createDataFrame([(i, x["left"], x["right"], x["count"]) for i, x in enumerate(steps)], "rank int, l string, r string, n bigint")


@query("""{atoms}, r AS (SELECT *, notes[1].pitch AS low, lag(kind) OVER w AS pk, lag(anchor) OVER w AS pa, lag(notes[1].pitch) OVER w AS pl FROM atoms WINDOW w AS (PARTITION BY song_id ORDER BY t)),
g AS (SELECT *, (pk IS NULL OR pk = 'REST') AS st, list_reduce(list_concat([CASE WHEN pk IS NULL OR pk = 'REST' THEN 0 ELSE anchor - pa END], [x.duration FOR x IN notes]), lambda a, b: gcd(a, b)) AS sc FROM r WHERE kind = 'NOTE')
SELECT song_id, t, CASE WHEN st THEN 'start' ELSE 'next|' || (low - pl) END || '|' || array_to_string([x.pitch - low FOR x IN notes], ',') || CASE WHEN st THEN '' ELSE '|' || (anchor - pa) // greatest(sc, 1) END || '|' || array_to_string([x.duration // greatest(sc, 1) FOR x IN notes], ',') AS family FROM g
UNION ALL SELECT song_id, t, 'rest' FROM atoms WHERE kind = 'REST'""")
def relational_families(spark, sf_dir):
    return codelen.family_symbols(ev.atoms(facts(spark, sf_dir)))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))

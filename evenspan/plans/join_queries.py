"""Queries over joins, relations, ledgers and key estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import keys, ledger, relations
from .base import facts, query, rounded, table

_ARMS = "r AS (SELECT chr(65 + (o_custkey % 4)::INT) AS arm, o_custkey // 4 AS seed, avg(o_totalprice / 1000) AS bits, count(*) AS facts FROM orders GROUP BY 1, 2)"


def _arms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    arm = F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    return o.groupBy(arm.alias("arm"), F.expr("o_custkey div 4").alias("seed")).agg(ledger.ordered_mean(F.col("o_totalprice") / 1000, F.col("o_orderkey")).alias("bits"), F.count("*").alias("facts"))


@query(f"""WITH {_ARMS}, p(left_arm, right_arm) AS (VALUES ('A', 'B'), ('A', 'C'), ('D', 'B')), d AS (SELECT left_arm, right_arm, a.bits - b.bits AS d FROM p JOIN r a ON a.arm = left_arm JOIN r b ON b.arm = right_arm AND a.seed = b.seed)
SELECT left_arm, right_arm, count(*) AS seeds, round(avg(d), 6) + 0.0 AS mean_delta, round(stddev_samp(d), 6) + 0.0 AS sd_delta, (bool_and(d > 0) OR bool_and(d < 0)) AS same_direction FROM d GROUP BY 1, 2""")
def paired_deltas(spark, sf_dir):
    d = relations.paired(_arms(spark, sf_dir), [("A", "B"), ("A", "C"), ("D", "B")])
    return d.select("left_arm", "right_arm", "seeds", rounded(F.col("mean_delta")).alias("mean_delta"), rounded(F.col("sd_delta")).alias("sd_delta"), "same_direction")


@query("""SELECT count(*) AS checked, count(*) FILTER (c_custkey IS NULL) AS missing, count(*) FILTER (sha256(c_name) <> sha256('Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || CASE WHEN o_custkey % 50 = 0 THEN 'x' ELSE '' END)) AS mismatched
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = o_custkey""")
def source_verification(spark, sf_dir):
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_custkey") % 50 == 0, "x").otherwise(""))
    manifest = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("path"), F.sha2(name, 256).alias("sha256"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    return relations.verify_sources(manifest, files)


# notes of a song, one for each onset, serve as chords that last until the next onset or their own end
_CHORDS = """ch AS (SELECT song_id, onset AS s, least(onset + d, coalesce(lead(onset) OVER (PARTITION BY song_id ORDER BY onset), onset + d)) AS e, p % 12 AS root, 'q' || p % 3 AS quality FROM (SELECT song_id, onset, max(duration) AS d, min(pitch) AS p FROM facts GROUP BY 1, 2)),
bars AS (SELECT song_id, unnest(range(0, max(onset) // 384 + 1)) AS bar FROM facts GROUP BY 1), slots AS (SELECT song_id, bar, h AS half, bar * 384 + 96 + 192 * h AS m FROM bars, (VALUES (0), (1)) v(h)),
slotted AS (SELECT slots.song_id, bar, half, m, coalesce(root, 12) AS root, coalesce(quality, 'N') AS quality FROM slots LEFT JOIN ch ON ch.song_id = slots.song_id AND s <= m AND m < e)"""


def _slots(spark, sf_dir):
    f = facts(spark, sf_dir)
    w = ev.Window.partitionBy("song_id").orderBy("start")
    c = f.groupBy("song_id", F.col("onset").alias("start")).agg(F.max("duration").alias("d"), F.min("pitch").alias("p"))
    c = c.withColumn("stop", F.least(F.col("start") + F.col("d"), F.coalesce(F.lead("start").over(w), F.col("start") + F.col("d"))))
    c = c.select("song_id", "start", "stop", F.pmod("p", F.lit(12)).alias("root"), F.concat(F.lit("q"), F.pmod("p", F.lit(3))).alias("quality"))
    bars = f.groupBy("song_id").agg(F.max("onset").alias("m")).select("song_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("m div 384"))).alias("bar"))
    bounds = bars.select("song_id", "bar", (F.col("bar") * 384).alias("start"), (F.col("bar") * 384 + 384).alias("stop"))
    return relations.chord_slots(bounds, c)


@query("{facts}, " + _CHORDS + " SELECT song_id, bar, half::BIGINT AS half, root::BIGINT AS root, quality FROM slotted")
def chord_slots(spark, sf_dir):
    s = _slots(spark, sf_dir)
    return s.select("song_id", "bar", F.col("half").cast("bigint").alias("half"), F.col("root").cast("bigint").alias("root"), "quality")


@query("{facts}, " + _CHORDS + " SELECT f.song_id, onset, pitch::BIGINT AS pitch, duration, root::BIGINT AS root FROM facts f JOIN slotted t ON t.song_id = f.song_id AND bar * 2 + half = onset // 192")
def chord_at_target(spark, sf_dir):
    s = _slots(spark, sf_dir).withColumn("anchor", F.col("bar") * 384 + F.col("half") * 192)
    out = relations.current_slot(facts(spark, sf_dir), s)
    return out.select("song_id", "onset", F.col("pitch").cast("bigint").alias("pitch"), "duration", F.col("root").cast("bigint").alias("root"))


@query("SELECT 'q' || i AS quality, i + 1 AS id FROM range(3) t(i) UNION ALL SELECT '<UNK>', 0")
def quality_vocabulary(spark, sf_dir):
    q = facts(spark, sf_dir).select(F.concat(F.lit("q"), F.pmod("pitch", F.lit(3))).alias("quality")).agg(F.array_sort(F.collect_set("quality")).alias("q"))
    return q.select(F.posexplode(F.concat(F.array(F.lit("<UNK>")), F.col("q"))).alias("id", "quality")).select("quality", F.col("id").cast("bigint").alias("id"))


@query("SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey")
def song_level_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return relations.lookup(o, c, "c_custkey", "segment").select("o_orderkey", "segment")


_WIN = "w AS (SELECT song_id, onset // 3072 * 8 AS start_bar, onset % 3072 AS o, duration AS d, pitch AS p FROM facts), pr AS (SELECT a.o AS lo, a.d AS ld, a.p AS lp, b.o AS ro, b.d AS rd, b.p AS rp FROM w a JOIN w b ON a.song_id = b.song_id AND a.start_bar = b.start_bar)"
_EDGES = "[1,2,3,4,6,8,12,16,24,32,48,64,96,192,384,768,1536]"


@query("{facts}, " + _WIN + f""" SELECT delta_pitch, delta_time, same_onset, duration_ratio, overlap, metrical, count(*) AS n FROM (SELECT
 (CASE WHEN rp - lp < -24 THEN 0 WHEN rp - lp > 24 THEN 50 ELSE rp - lp + 25 END)::BIGINT AS delta_pitch, (CASE WHEN ro = lo THEN 0 ELSE 1 + 2 * len(list_filter({_EDGES}, lambda e: e < abs(ro - lo))) + (ro > lo)::INT END)::BIGINT AS delta_time, (lo = ro)::BIGINT AS same_onset,
 len(list_filter([-3.0,-2.0,-1.0,-0.5,0.0,0.5,1.0,2.0,3.0], lambda e: e < log2(rd::DOUBLE / ld)))::BIGINT AS duration_ratio,
 (CASE WHEN lo > ro + rd THEN 7 WHEN lo = ro + rd THEN 6 WHEN lo = ro AND ld = rd THEN 5 WHEN ro <= lo AND ro + rd >= lo + ld THEN 4 WHEN lo <= ro AND lo + ld >= ro + rd THEN 3 WHEN greatest(lo, ro) < least(lo + ld, ro + rd) THEN 2 WHEN lo + ld = ro THEN 1 ELSE 0 END)::BIGINT AS overlap,
 ((lo % 96 = ro % 96)::INT + 2 * (lo // 96 % 4 = ro // 96 % 4)::INT + 4 * (lo % 384 = ro % 384)::INT)::BIGINT AS metrical FROM pr) GROUP BY ALL""")
def relation_ids(spark, sf_dir):
    both = relations.pairs(ev.windows(facts(spark, sf_dir)))
    ids = relations.relation_ids()
    return both.select(*(c.alias(n) for n, c in ids.items())).groupBy(*ids).agg(F.count("*").alias("n"))


@query("{facts}, " + _WIN + """ SELECT floor(d / 96.0)::BIGINT AS floor_96, floor(d / 384.0)::BIGINT AS floor_384, (d % 384 + 384) % 384 AS meter, count(*) AS n FROM (SELECT ro - lo AS d FROM pr) GROUP BY ALL""")
def pairwise_time_features(spark, sf_dir):
    both = relations.pairs(ev.windows(facts(spark, sf_dir)))
    f = relations.time_features(F.col("r_rel_onset") - F.col("l_rel_onset"))
    return both.select(*(f[n].alias(n) for n in ("floor_96", "floor_384", "meter"))).groupBy("floor_96", "floor_384", "meter").agg(F.count("*").alias("n"))


@query("{facts}, w AS (SELECT song_id, onset // 3072 AS b, onset AS o, duration AS d, pitch AS p, row_number() OVER (PARTITION BY song_id, onset // 3072 ORDER BY onset, pitch, duration) AS i FROM facts) SELECT 1.0::DOUBLE AS delta_time, 1.0::DOUBLE AS overlap")
def relation_consistency(spark, sf_dir):
    """Relations don't change when all events move by the same time."""
    ids = relations.relation_ids()
    keys_ = ["song_id", "start_bar", "l_i", "r_i"]
    w = ev.windows(facts(spark, sf_dir))

    def of(rows):
        return relations.pairs(rows).select(*keys_, *(ids[n].alias(n) for n in ("delta_time", "overlap")))

    return relations.consistency(of(w), of(w.withColumn("rel_onset", F.col("rel_onset") + 384)), keys_, ["delta_time", "overlap"])


_LWIN = "lw AS (SELECT DISTINCT user_id AS song_id, (floor(epoch(ts))::BIGINT - 1704067200) // 60 // 3072 * 8 AS start_bar FROM events WHERE event_type <> 'error')"


def _windows(spark, sf_dir):
    return ev.windows(facts(spark, sf_dir)).select("song_id", "start_bar").distinct()


@query(f"""WITH {_LWIN}, p AS (SELECT a.song_id, a.start_bar, b.start_bar AS other, (abs(a.start_bar - b.start_bar) < 16)::INT AS near, sha256('4|' || a.song_id || '|' || a.start_bar || '|' || b.start_bar) AS k FROM lw a JOIN lw b ON a.song_id = b.song_id AND a.start_bar <> b.start_bar)
SELECT song_id, start_bar, other AS negative FROM (SELECT *, row_number() OVER (PARTITION BY song_id, start_bar ORDER BY near, k) AS r FROM p) WHERE r = 1""")
def same_song_negatives(spark, sf_dir):
    return relations.same_song_negatives(_windows(spark, sf_dir), 16, 4)


@query(f"""WITH {_LWIN}, s AS (SELECT song_id, min(start_bar) AS b, row_number() OVER (ORDER BY song_id) - 1 AS i, count(*) OVER () AS n FROM lw GROUP BY 1)
SELECT lw.song_id, start_bar, t.song_id AS negative_song, t.b AS negative_bar FROM lw JOIN s USING (song_id) JOIN s t ON t.i = (s.i + 1) % s.n""")
def cross_song_negatives(spark, sf_dir):
    return relations.cross_song_negatives(_windows(spark, sf_dir))


def _pick(purpose: str, candidates: str) -> str:
    return f"{candidates}[(('0x' || substr(sha256('9|{purpose}|' || song_id || '|' || start_bar), 1, 15))::BIGINT % len({candidates}) + 1)::INT]"


@query(f"""WITH {_LWIN}, w AS (SELECT *, start_bar // 8 % 3 <> 0 AS melody FROM lw), f AS (SELECT a.song_id, a.start_bar, list(b.start_bar ORDER BY b.start_bar) AS far, list(b.start_bar ORDER BY b.start_bar) FILTER (b.melody) AS sing
 FROM w a JOIN w b ON a.song_id = b.song_id AND abs(a.start_bar - b.start_bar) >= 16 WHERE a.melody GROUP BY 1, 2),
m AS (SELECT *, {_pick('melody', 'sing')} AS melody_bar FROM f WHERE len(sing) > 0), c AS (SELECT *, CASE WHEN len(far) = 1 THEN far ELSE list_filter(far, lambda x: x <> melody_bar) END AS rest FROM m)
SELECT song_id, start_bar, melody_bar, {_pick('context', 'rest')} AS context_bar FROM c""")
def donor_triples(spark, sf_dir):
    return relations.donor_triples(_windows(spark, sf_dir).withColumn("melody", F.floor(F.col("start_bar") / 8) % 3 != 0), 16, 9)


@query("WITH r AS (SELECT c_custkey AS i, c_nationkey AS song_id, count(*) OVER () AS n FROM customer) SELECT a.i, a.song_id, b.song_id AS partner FROM r a JOIN r b ON b.i = (a.i + 501) % a.n")
def rotated_partners(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("song_id"))
    return relations.rotated_partner(c, 501)


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))
SELECT vec_id, round(list_sum(x[:32])::DOUBLE + list_sum(y[33:48])::DOUBLE + list_sum(x[49:])::DOUBLE, 4) + 0.0 AS target_swapped, len(x)::BIGINT AS n FROM p""")
def spliced_latents(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    b = e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("embedding").alias("y"))
    s = e.join(b, "vec_id").select("vec_id", relations.spliced(F.col("embedding"), F.col("y"), 32, 48).alias("s"))
    return s.select("vec_id", rounded(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 4).alias("target_swapped"), F.size("s").cast("bigint").alias("n"))


_LEDGER = "e AS (SELECT l_returnflag AS arm, l_suppkey AS seed, count(*) AS facts, sum(l_quantity) AS time, sum(l_extendedprice) / 100 AS pitch, sum(l_tax) AS duration, sum(l_discount) AS kind, max(l_linenumber)::DOUBLE AS eos, 4.0 * count(DISTINCT l_linenumber) AS side FROM lineitem GROUP BY 1, 2)"


def _entries(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("seed")).agg(
        F.count("*").alias("facts"), F.sum("l_quantity").alias("time"), (F.sum("l_extendedprice") / 100).alias("pitch"), F.sum("l_tax").alias("duration"), F.sum("l_discount").alias("kind"), F.max("l_linenumber").cast("double").alias("eos"), (4.0 * F.count_distinct("l_linenumber")).alias("side"),
    )


@query(f"WITH {_LEDGER} SELECT arm, sum(facts)::BIGINT AS facts, " + ", ".join(f"round(sum({c}), 4) + 0.0 AS {c}" for c in ledger.CHANNELS) + ", round((sum(time) + sum(pitch) + sum(duration) + sum(kind) + sum(eos) + sum(side)) / sum(facts), 6) + 0.0 AS bits_per_fact FROM e GROUP BY 1")
def predictive_ledger(spark, sf_dir):
    out = ledger.ledger(_entries(spark, sf_dir), ["arm"])
    return out.select("arm", "facts", *(rounded(F.col(c), 4).alias(c) for c in ledger.CHANNELS), rounded(F.col("bits_per_fact")).alias("bits_per_fact"))


@query(f"WITH {_LEDGER} SELECT arm, seed, (seed % 5 <> 0) AS match FROM e")
def factor_sums(spark, sf_dir):
    e = _entries(spark, sf_dir)
    total = F.col("time") + F.col("pitch") + F.col("duration") + F.col("kind") + F.col("eos") + F.col("side") + F.when(F.col("seed") % 5 == 0, 0.5).otherwise(0.0)
    return ledger.factors_match(e.withColumn("total", total), "total", 1e-6).select("arm", "seed", "match")


@query(f"WITH {_LEDGER} SELECT a.seed, " + ", ".join(f"round(a.{c} - b.{c}, 4) + 0.0 AS {c}" for c in ledger.CHANNELS) + " FROM e a JOIN e b ON a.seed = b.seed WHERE a.arm = 'A' AND b.arm = 'N'")
def factor_deltas(spark, sf_dir):
    e = _entries(spark, sf_dir)
    d = ledger.factor_deltas(e.where("arm = 'A'"), e.where("arm = 'N'"), ["seed"])
    return d.select("seed", *(rounded(F.col(c), 4).alias(c) for c in ledger.CHANNELS))


@query("SELECT p_size AS support, count(*) AS n, (ceil(log2(p_size + 1)) * count(*))::BIGINT AS bits FROM part GROUP BY 1")
def side_information(spark, sf_dir):
    x = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("support")).agg(F.count("*").alias("n"))
    return x.select("support", "n", ledger.fixed_length_bits(F.col("support") + 1, F.col("n")).alias("bits"))


@query(f"WITH {_ARMS} SELECT arm, count(*) AS seeds, round(avg(bits), 6) + 0.0 AS mean_bits, round(stddev_samp(bits), 6) + 0.0 AS sd_bits, min_by(facts, seed) AS facts, string_agg(seed || '=' || round(bits, 3)::DECIMAL(18,3), ',' ORDER BY seed) AS by_seed FROM r GROUP BY 1")
def arm_summary(spark, sf_dir):
    s = ledger.summary(_arms(spark, sf_dir))
    shown = F.array_join(F.transform("by_seed", lambda x: F.concat(x["seed"].cast("string"), F.lit("="), F.round(x["bits"], 3).cast("decimal(18,3)").cast("string"))), ",")
    return s.select("arm", "seeds", rounded(F.col("mean_bits")).alias("mean_bits"), rounded(F.col("sd_bits")).alias("sd_bits"), "facts", shown.alias("by_seed"))


@query("""SELECT coalesce(l_suppkey, -1) AS song, grouping(l_suppkey)::BIGINT AS total, round(sum(l_quantity), 4) + 0.0 AS nats, sum(l_linenumber)::BIGINT AS events, round(sum(l_quantity) / greatest(1, sum(l_linenumber)) / ln(2), 6) + 0.0 AS bits_per_event FROM lineitem GROUP BY ROLLUP (l_suppkey)""")
def evaluation_rollup(spark, sf_dir):
    e = ledger.evaluation(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_linenumber")
    return e.select(F.coalesce("l_suppkey", F.lit(-1)).alias("song"), F.col("total").cast("bigint").alias("total"), rounded(F.col("nats"), 4).alias("nats"), "events", rounded(F.col("bits_per_event")).alias("bits_per_event"))


@query("""WITH m AS (SELECT l_returnflag AS intervention, l_linenumber AS head, l_extendedprice / 10000 - 3 AS margin FROM lineitem), a AS (SELECT intervention, head, count(*) AS n, avg((margin > 0)::INT) AS acc, avg(margin) AS mm, avg(ln(1 + exp(-margin))) AS loss FROM m GROUP BY 1, 2)
SELECT intervention, head, n, round(acc, 6) + 0.0 AS accuracy, round(mm, 6) + 0.0 AS mean_margin, round(loss, 6) + 0.0 AS loss, round((acc + 1.96*1.96/(2*n) - 1.96 * sqrt(acc*(1-acc)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) + 0.0 AS wilson FROM a""")
def probe_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("intervention"), F.col("l_linenumber").alias("head"), (F.col("l_extendedprice") / 10000 - 3).alias("margin"))
    a = ledger.margins(m, ["intervention", "head"])
    return a.select("intervention", "head", "n", *(rounded(F.col(c)).alias(c) for c in ("accuracy", "mean_margin", "loss")), rounded(ledger.wilson_lower(F.col("accuracy"), F.col("n"))).alias("wilson"))


@query("""{facts}, n AS (SELECT song_id, count(*) AS notes, CASE WHEN song_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM facts GROUP BY 1)
SELECT split, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM n), 6) + 0.0 AS percent, round(avg(notes), 6) + 0.0 AS mean, quantile_cont(notes, 0.05)::DOUBLE AS p05, quantile_cont(notes, 0.5)::DOUBLE AS p50, quantile_cont(notes, 0.95)::DOUBLE AS p95 FROM n GROUP BY 1""")
def split_distribution(spark, sf_dir):
    n = facts(spark, sf_dir).groupBy("song_id").agg(F.count("*").alias("notes")).withColumn("split", F.when(F.col("song_id") % 10 == 0, "test").otherwise("train"))
    d = ledger.distribution(n, ["split"], "notes", n.count())
    return d.select("split", "n", rounded(F.col("percent")).alias("percent"), rounded(F.col("mean")).alias("mean"), *(rounded(F.col(p)).alias(p) for p in ("p05", "p50", "p95")))


@query("{facts} SELECT song_id % 12 - 5 AS shift, count(DISTINCT song_id) AS songs, count(*) AS notes, min(pitch + song_id % 12 - 5)::BIGINT AS low, max(pitch + song_id % 12 - 5)::BIGINT AS high FROM facts GROUP BY 1")
def shift_histogram(spark, sf_dir):
    return ledger.shift_histogram(facts(spark, sf_dir).withColumn("shift", F.pmod("song_id", F.lit(12)) - 5))


@query("SELECT label, (i - 1)::BIGINT AS dim, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) + 0.0 AS sd FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def latent_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return ledger.vector_stats(e, "label", "v").select("label", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("mean"), 5).alias("mean"), rounded(F.col("sd"), 5).alias("sd"))


@query("""WITH p AS (SELECT a.label, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, round(avg(sqrt(list_sum([(x[i]::DOUBLE - y[i]::DOUBLE) ** 2 FOR i IN range(1, len(x) + 1)]))), 4) + 0.0 AS distance FROM p GROUP BY 1""")
def representation_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return ledger.mean_distance(e.join(b, "vec_id"), ["label"], "v", "w").select("label", rounded(F.col("distance"), 4).alias("distance"))


@query("""{facts} SELECT song_id, onset // 3072 * 8 AS start_bar, floor(avg(pitch))::BIGINT AS anchor, sum(least(256, greatest(0, pitch - 60 + 128)))::BIGINT AS clipped, sum(onset % 3072 // 384)::BIGINT AS bars, count(*) AS n FROM facts GROUP BY 1, 2""")
def collated_windows(spark, sf_dir):
    w = ev.windows(facts(spark, sf_dir))
    clip = F.least(F.lit(256), F.greatest(F.lit(0), F.col("pitch") - 60 + 128))
    return w.groupBy("song_id", "start_bar").agg(F.floor(F.avg("pitch")).alias("anchor"), F.sum(clip).alias("clipped"), F.sum(F.expr("rel_onset div 384")).alias("bars"), F.count("*").alias("n"))


_PROFILE = ", ".join(f"('{a}', {t}, '{m}', {pc}, {w})" for a, t, m, pc, w in keys.profile_rows())


@query(f"""{{facts}}, pf(analyzer, tonic, mode, pc, p) AS (VALUES {_PROFILE}), wt AS (SELECT s.song_id, c.pc, coalesce(sum(duration), 0)::DOUBLE AS w FROM (SELECT DISTINCT song_id FROM facts) s, (SELECT unnest(range(12)) AS pc) c LEFT JOIN facts f ON f.song_id = s.song_id AND f.pitch % 12 = c.pc GROUP BY 1, 2)
SELECT song_id, analyzer, tonic, mode, round(corr(w, p::DOUBLE), 6) + 0.0 AS correlation FROM wt JOIN pf USING (pc) GROUP BY ALL""")
def key_correlations(spark, sf_dir):
    return keys.correlations(facts(spark, sf_dir)).select("song_id", "analyzer", "tonic", "mode", rounded(F.col("correlation")).alias("correlation"))


@query(f"""{{facts}}, pf(analyzer, tonic, mode, pc, p) AS (VALUES {_PROFILE}), wt AS (SELECT s.song_id, c.pc, coalesce(sum(duration), 0)::DOUBLE AS w FROM (SELECT DISTINCT song_id FROM facts) s, (SELECT unnest(range(12)) AS pc) c LEFT JOIN facts f ON f.song_id = s.song_id AND f.pitch % 12 = c.pc GROUP BY 1, 2),
co AS (SELECT song_id, analyzer, tonic, mode, CASE WHEN mode = 'major' THEN tonic ELSE (tonic + 3) % 12 END AS frame, corr(w, p::DOUBLE) AS c FROM wt JOIN pf USING (pc) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY song_id, analyzer ORDER BY round(c, 9) DESC, tonic, mode) AS r FROM co),
bf AS (SELECT song_id, analyzer, tonic, mode, frame, c FROM rk WHERE r = 1)
SELECT bf.song_id, bf.analyzer, bf.tonic, bf.mode, bf.frame::BIGINT AS frame, round(bf.c, 6) + 0.0 AS correlation, round(bf.c - max(co.c) FILTER (co.frame <> bf.frame), 6) + 0.0 AS margin FROM bf JOIN co ON co.song_id = bf.song_id AND co.analyzer = bf.analyzer GROUP BY bf.song_id, bf.analyzer, bf.tonic, bf.mode, bf.frame, bf.c""")
def key_estimates(spark, sf_dir):
    e = keys.estimates(facts(spark, sf_dir))
    return e.select("song_id", "analyzer", "tonic", "mode", F.col("frame").cast("bigint").alias("frame"), rounded(F.col("correlation")).alias("correlation"), rounded(F.col("margin")).alias("margin"))




@query("""WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'G' ELSE l_returnflag END AS arm, l_suppkey AS seed, count(*) AS events, count(DISTINCT l_returnflag) AS songs, count(DISTINCT l_linenumber) AS windows, avg(l_quantity) AS b FROM lineitem GROUP BY 1, 2)
SELECT arm, seed, events - songs AS declared, round((b * events + CASE WHEN arm = 'G' THEN 4 * windows ELSE 0 END) / (events - songs), 6) + 0.0 AS bits_per_fact, round(events / (events - songs), 6) + 0.0 AS targets_per_fact FROM r WHERE events > songs""")
def declared_bits(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    r = x.groupBy(F.when(F.col("l_returnflag") == "R", "G").otherwise(F.col("l_returnflag")).alias("arm"), F.col("l_suppkey").alias("seed")).agg(
        F.count("*").alias("events"), F.count_distinct("l_returnflag").alias("songs"), F.count_distinct("l_linenumber").alias("windows"), F.avg("l_quantity").alias("bits_per_event"),
    )
    d = ledger.declared_bits(r.where("events > songs"))
    return d.select("arm", "seed", "declared", rounded(F.col("bits_per_fact")).alias("bits_per_fact"), rounded(F.col("targets_per_fact")).alias("targets_per_fact"))


@query("SELECT label, (i - 1)::BIGINT AS dim, round(avg(x), 5) + 0.0 AS mean FROM (SELECT vec_id // 10 AS label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def pooled_onset_groups(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return ledger.pooled_groups(e, ["label"], "v").select("label", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("mean"), 5).alias("mean"))


@query("""WITH r AS (SELECT label, (vec_id % 12 - 5)::INT AS s, (6 + vec_id * 7 % 52)::INT AS n, [x::DOUBLE * 3 FOR x IN embedding] AS z FROM embeddings), l AS (SELECT *, ln(list_sum([exp(x) FOR x IN z])) AS t FROM r),
m AS (SELECT label, t - z[n + 1] AS native, t - z[n + s - s + 1] AS mapped, t - ln(list_sum([exp(z[q - s + 1]) FOR q IN range(64) IF q % 12 = (n + s) % 12 AND q - s BETWEEN 0 AND 63])) AS merged, list_position(z, list_max(z)) - 1 + s AS best FROM l)
SELECT label, count(*) AS notes, round(sum(native), 5) + 0.0 AS native_nats, round(sum(mapped), 5) + 0.0 AS mapped_nats, round(sum(merged), 5) + 0.0 AS class_nats, round(avg(CASE WHEN best BETWEEN 0 AND 63 THEN 0 ELSE 1 END), 6) + 0.0 AS invalid_rate,
 round(abs(sum(mapped) - sum(native)), 5) + 0.0 AS difference FROM m GROUP BY 1""")
def tonal_evaluation(spark, sf_dir):
    """Vectors as logits over 64 pitches in a frame that is moved by -5 to 6."""
    v, shift = F.col("vec_id"), (F.pmod("vec_id", F.lit(12)) - 5).cast("int")
    native = (6 + F.pmod(v * 7, F.lit(52))).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") * 3).alias("logits"), native.alias("native"), (native + shift).alias("physical"), shift.alias("shift"))
    out = ledger.tonal_evaluation(rows, ["label"])
    return out.select("label", "notes", *(rounded(F.col(c), 5).alias(c) for c in ("native_nats", "mapped_nats", "class_nats", "difference")), rounded(F.col("invalid_rate")).alias("invalid_rate"))


@query("""WITH w AS (SELECT o_orderkey AS window_id, o_custkey % (SELECT count(*) FROM embeddings) AS vec_id, (o_orderkey % 7 * 8)::INT AS start FROM orders)
SELECT window_id, w.vec_id, round(list_sum([x::DOUBLE FOR x IN embedding[start + 1:start + 16]]), 4) + 0.0 AS total FROM w JOIN embeddings e ON e.vec_id = w.vec_id""")
def latent_windows(spark, sf_dir):
    """Windows of an index, drawn by the orders, as slices of the vectors, which aren't shuffled."""
    e = table(spark, sf_dir, "embeddings")
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window_id"), F.pmod("o_custkey", F.lit(e.count())).alias("vec_id"), (F.col("o_orderkey") % 7 * 8).cast("int").alias("start"))
    got = relations.latent_windows(e.select("vec_id", "embedding"), index, "vec_id", "embedding", 16)
    return got.select("window_id", "vec_id", rounded(F.aggregate("slice", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 4).alias("total"))

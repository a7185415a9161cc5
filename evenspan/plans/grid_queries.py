"""Queries over time and pitch functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as p
from ..functions import timegrid as t
from ..operators import events as ev
from .base import facts, query, rounded, table


@query("{facts} SELECT song_id, onset, pitch, duration, onset // 384 AS bar, onset % 384 AS tick, onset % 96 AS beat_tick, (onset % 384) // 96 AS beat, onset AS back FROM facts")
def time_coordinates(spark, sf_dir):
    c = F.col("m")
    rows = facts(spark, sf_dir).withColumn("m", t.musical_time(F.col("onset")))
    return rows.select("song_id", "onset", "pitch", "duration", c["bar"].alias("bar"), c["tick"].alias("tick"), c["beat_tick"].alias("beat_tick"), c["beat"].alias("beat"), t.onset_of(c["bar"], c["tick"]).alias("back"))


@query("""{facts}, d AS (SELECT DISTINCT onset FROM facts)
SELECT onset, round(sin(2*pi()*(onset % 384)/384), 6) + 0.0 AS phase_sin, round(cos(2*pi()*(onset % 384)/384), 6) + 0.0 AS phase_cos FROM d""")
def cyclic_phases(spark, sf_dir):
    rows = facts(spark, sf_dir).select("onset").distinct().withColumn("c", t.cyclic_phase(F.col("onset"), 384))
    return rows.select("onset", rounded(F.col("c.sin")).alias("phase_sin"), rounded(F.col("c.cos")).alias("phase_cos"))


_MULTI = ", ".join(f"round(sin(2*pi()*((onset // 24) % {k})/{k}), 6) + 0.0 AS s{k}, round(cos(2*pi()*((onset // 24) % {k})/{k}), 6) + 0.0 AS c{k}" for k in (4, 16, 64))


@query("{facts} SELECT DISTINCT onset, onset // 384 AS bar, onset % 384 AS tick, " + _MULTI + " FROM facts")
def directed_multiscale_time(spark, sf_dir):
    rows = facts(spark, sf_dir).select("onset").distinct().withColumn("m", t.multiscale_time(F.col("onset")))
    phases = [rounded(F.col(f"m.phase{k}.{f}")).alias(f"{f[0]}{k}") for k in (4, 16, 64) for f in ("sin", "cos")]
    return rows.select("onset", "m.bar", "m.tick", *phases)


@query("{facts} SELECT DISTINCT duration, duration // 384 AS bars, duration % 384 AS remainder, (duration // 384) * 384 + duration % 384 AS back FROM facts")
def split_join_ticks(spark, sf_dir):
    rows = facts(spark, sf_dir).select("duration").distinct().withColumn("x", t.split_ticks(F.col("duration")))
    return rows.select("duration", "x.bars", "x.remainder", t.onset_of(F.col("x.bars"), F.col("x.remainder")).alias("back"))


_PAIRS = """{facts}, n AS (SELECT song_id, onset, row_number() OVER (PARTITION BY song_id ORDER BY onset, pitch, duration) AS i FROM facts),
d AS (SELECT DISTINCT b.onset - a.onset AS d FROM n a JOIN n b ON a.song_id = b.song_id AND abs(a.i - b.i) <= 3)"""
_EDGES = "[" + ",".join(map(str, t.TIME_EDGES)) + "]"


def _distances(spark, sf_dir):
    """Distances between events up to three places apart, either way."""
    n = ev.canonical(facts(spark, sf_dir)).select("song_id", "onset", "ord")
    far = n.select("song_id", F.col("onset").alias("o2"), F.explode(F.sequence(F.col("ord") - 3, F.col("ord") + 3)).alias("ord"))
    return n.join(far, ["song_id", "ord"]).select((F.col("o2") - F.col("onset")).alias("d")).distinct()


@query(_PAIRS + f""" SELECT d, (CASE WHEN d = 0 THEN 0 ELSE sign(d) * least(31, 1 + floor(log2(abs(d)))) END)::BIGINT AS log_bucket,
 (CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN d > 0 THEN 1 ELSE 33 END) + least(31, CASE WHEN abs(d) <= 16 THEN abs(d) - 1
   ELSE 16 + floor(ln(abs(d) / 16.0) / ln(32 * 384 / 16.0) * 16) END) END)::BIGINT AS exact_log_bucket,
 (sign(d) * (abs(d) // 96))::BIGINT AS beats_symmetric, floor(d / 96.0)::BIGINT AS beats_floor,
 (CASE WHEN d = 0 THEN 0 ELSE 1 + 2 * len(list_filter({_EDGES}, lambda e: e < abs(d))) + (CASE WHEN d > 0 THEN 1 ELSE 0 END) END)::BIGINT AS time_bucket FROM d""")
def distance_buckets(spark, sf_dir):
    d = F.col("d")
    return _distances(spark, sf_dir).select(
        "d", t.signed_log_bucket(d).alias("log_bucket"), t.signed_exact_log_bucket(d).alias("exact_log_bucket"), t.unit_distance(d, 96).alias("beats_symmetric"),
        t.floor_distance(d, 96).alias("beats_floor"), t.signed_time_bucket(d).alias("time_bucket"),
    )


def _phase(name, index, period):
    return f"round(sin(2*pi()*(({index}) % {period})/{period}), 6) + 0.0 AS {name}_sin, round(cos(2*pi()*(({index}) % {period})/{period}), 6) + 0.0 AS {name}_cos"


@query("""{facts}, d AS (SELECT DISTINCT onset FROM facts) SELECT onset, round((onset // 384) / 255.0, 6) + 0.0 AS bar_linear, round(ln(1 + onset // 384) / ln(256), 6) + 0.0 AS bar_log,
 round(sqrt((onset // 384) / 255.0), 6) + 0.0 AS bar_root, """ + ", ".join(_phase(*x) for x in (("beat_tick", "onset % 96", 96), ("beat", "onset // 96", 4), ("bar", "onset", 384), ("four", "onset", 1536), ("sixteen", "onset", 6144))) + " FROM d")
def unary_time_features(spark, sf_dir):
    rows = facts(spark, sf_dir).select("onset").distinct()
    return rows.select("onset", *(rounded(c).alias(n) for n, c in t.unary_time(F.col("onset")).items()))


@query("""{facts}, p AS (SELECT DISTINCT row_number() OVER (PARTITION BY song_id ORDER BY onset, pitch, duration) - 1 AS pos FROM facts), i AS (SELECT unnest(range(8)) AS k)
SELECT pos::BIGINT AS pos, k::BIGINT AS k, round(sin(pos * exp(-ln(10000.0) * k / 7)), 6) + 0.0 AS s, round(cos(pos * exp(-ln(10000.0) * k / 7)), 6) + 0.0 AS c FROM p, i""")
def sequence_positions(spark, sf_dir):
    """Of the places that events have in their songs."""
    rows = ev.canonical(facts(spark, sf_dir)).select((F.col("ord") - 1).cast("bigint").alias("pos")).distinct()
    rows = rows.select("pos", t.sequence_position(F.col("pos").cast("double"), 16).alias("v"))
    rows = rows.select("pos", F.posexplode(F.zip_with(F.slice("v", 1, 8), F.slice("v", 9, 8), lambda a, b: F.struct(a.alias("s"), b.alias("c")))).alias("k", "x"))
    return rows.select("pos", F.col("k").cast("bigint").alias("k"), rounded(F.col("x.s")).alias("s"), rounded(F.col("x.c")).alias("c"))


@query("""{ordered}, n AS (SELECT song_id, ord, event_type, onset, duration, lead(onset) OVER w AS nxt, lead(event_type) OVER w AS nt, row_number() OVER w AS i FROM ordered WINDOW w AS (PARTITION BY song_id ORDER BY ord))
SELECT song_id, ord, nxt AS next_onset FROM n WHERE nxt IS NOT NULL""")
def next_anchors(spark, sf_dir):
    rows = ev.canonical(ev.insert_rests(facts(spark, sf_dir)))
    w = ev.Window.partitionBy("song_id").orderBy("ord")
    nxt = F.lead("onset").over(w)
    rows = rows.select("*", nxt.alias("nxt")).where("nxt is not null")
    mode = F.when(F.col("event_type") == "REST", "rest").otherwise("delta")
    return rows.select("song_id", "ord", t.next_anchor(mode, F.col("onset"), F.col("nxt") - F.col("onset"), F.col("duration")).alias("next_onset"))


@query("""SELECT o_orderkey, round(CASE WHEN x <= 2000 THEN 0.001 * x / 2000 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos((x - 2000) / 10000.0 * pi())) END, 9) + 0.0 AS rate,
 round_even(CAST(x AS DOUBLE) * 0.5, 0)::BIGINT AS budget FROM (SELECT o_orderkey, least(greatest(o_orderkey, 1), 12000) AS x FROM orders)""")
def exposure_schedule(spark, sf_dir):
    x = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    held = F.least(F.greatest(x, F.lit(1)), F.lit(12000))
    return rows.select(x, rounded(t.learning_rate(x, 0.001, 0.0001, 2000, 12000), 9).alias("rate"), t.event_budget(held, F.lit(0.5)).alias("budget"))


@query("{facts} SELECT DISTINCT pitch, (pitch % 12)::BIGINT AS pitch_class, (pitch // 12)::BIGINT AS register, (pitch // 12 - 1)::BIGINT AS octave, pitch::BIGINT AS back FROM facts")
def pitch_split(spark, sf_dir):
    x = F.col("pitch").cast("bigint")
    rows = facts(spark, sf_dir).select("pitch").distinct().withColumn("s", p.split_pitch(x)).withColumn("o", p.split_pitch(x, -1))
    return rows.select("pitch", "s.pitch_class", "s.register", F.col("o.register").alias("octave"), p.join_pitch(F.col("s.pitch_class"), F.col("s.register")).alias("back"))


@query("""{facts} SELECT c, n, (7 * c % 12)::BIGINT AS fifths, round(sin(2*pi()*c/12), 6) + 0.0 AS chroma_sin, round(cos(2*pi()*c/12), 6) + 0.0 AS chroma_cos,
 round(sin(2*pi()*(7*c%12)/12), 6) + 0.0 AS fifths_sin, round(cos(2*pi()*(7*c%12)/12), 6) + 0.0 AS fifths_cos FROM (SELECT (pitch % 12)::BIGINT AS c, count(*) AS n FROM facts GROUP BY 1)""")
def pitch_circles(spark, sf_dir):
    """Both circles for the pitch classes of the notes."""
    c = F.col("c")
    rows = _classes(facts(spark, sf_dir)).groupBy("c").agg(F.count("*").alias("n")).withColumn("a", p.chromatic_phase(c)).withColumn("b", p.fifths_phase(c))
    shown = {"chroma_sin": "a.sin", "chroma_cos": "a.cos", "fifths_sin": "b.sin", "fifths_cos": "b.cos"}
    return rows.select("c", "n", p.fifths_index(c).alias("fifths"), *(rounded(F.col(x)).alias(n) for n, x in shown.items()))


def _classes(rows):
    return rows.select("song_id", "duration", F.pmod("pitch", F.lit(12)).cast("bigint").alias("c"))


@query("""{facts}, q AS (SELECT DISTINCT song_id, pitch % 12 AS c, sin(2*pi()*(pitch%12)/12) AS s, cos(2*pi()*(pitch%12)/12) AS k, sin(2*pi()*(7*(pitch%12)%12)/12) AS s7, cos(2*pi()*(7*(pitch%12)%12)/12) AS k7 FROM facts)
SELECT a.song_id, bool_and(sqrt((a.s-b.s)**2 + (a.k-b.k)**2) > 1e-12) AS chromatic, bool_and(sqrt((a.s7-b.s7)**2 + (a.k7-b.k7)**2) > 1e-12) AS fifths, count(*)::BIGINT AS pairs FROM q a JOIN q b ON a.song_id = b.song_id AND a.c < b.c GROUP BY 1""")
def phases_injective(spark, sf_dir):
    """Whether different pitch classes of a song (twelve at most) have different phases."""
    c = F.col("c")
    q = _classes(facts(spark, sf_dir)).select("song_id", "c").distinct().select("song_id", "c", p.chromatic_phase(c).alias("a"), p.fifths_phase(c).alias("b"))
    r = q.select("song_id", *(F.col(x).alias(x + "2") for x in ("c", "a", "b")))

    def apart(x: str):
        return F.bool_and(F.sqrt(F.pow(F.col(f"{x}.sin") - F.col(f"{x}2.sin"), 2) + F.pow(F.col(f"{x}.cos") - F.col(f"{x}2.cos"), 2)) > 1e-12)

    return q.join(r, "song_id").where("c < c2").groupBy("song_id").agg(apart("a").alias("chromatic"), apart("b").alias("fifths"), F.count("*").alias("pairs"))


@query("""{facts} SELECT a, b, n, round(cos(2*pi()*a/12) * cos(2*pi()*b/12) - sin(2*pi()*a/12) * sin(2*pi()*b/12), 6) + 0.0 AS x, round(cos(2*pi()*a/12) * sin(2*pi()*b/12) + sin(2*pi()*a/12) * cos(2*pi()*b/12), 6) + 0.0 AS y
FROM (SELECT (pitch % 12)::BIGINT AS a, (duration % 12)::BIGINT AS b, count(*) AS n FROM facts GROUP BY 1, 2)""")
def tonic_rotation(spark, sf_dir):
    """Pitch classes of the notes turned by tonics, for which their durations stand."""
    rows = _classes(facts(spark, sf_dir)).groupBy(F.col("c").alias("a"), F.pmod("duration", F.lit(12)).cast("bigint").alias("b")).agg(F.count("*").alias("n"))
    phase = t.cyclic_phase(F.col("a"), 12)
    r = p.rotated(phase["cos"], phase["sin"], F.col("b"))
    return rows.select("a", "b", "n", rounded(r["x"]).alias("x"), rounded(r["y"]).alias("y"))


_KEY = "(c_custkey % 12) AS tonic, CASE WHEN c_custkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode"


@query(f"""WITH k AS (SELECT c_custkey, {_KEY} FROM customer), f AS (SELECT *, CASE WHEN mode = 'major' THEN tonic ELSE (tonic + 3) % 12 END AS frame FROM k)
SELECT c_custkey, tonic::BIGINT AS tonic, mode, frame::BIGINT AS frame, (CASE WHEN (12 - frame) % 12 <= 6 THEN (12 - frame) % 12 ELSE (12 - frame) % 12 - 12 END)::BIGINT AS shift,
 CASE WHEN mode = 'minor' THEN lower(n[1]) || n[2:] ELSE n END AS label FROM (SELECT *, (['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'])[tonic + 1] AS n FROM f)""")
def key_frames(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(12)).alias("tonic"), F.when(F.col("c_custkey") % 2 == 0, "major").otherwise("minor").alias("mode"))
    k = k.withColumn("frame", p.major_frame(F.col("tonic"), F.col("mode")))
    return k.select("*", p.canonical_shift(F.col("frame")).alias("shift"), p.key_label(F.col("tonic"), F.col("mode")).alias("label"))


_LETTERS, _SIGNS, _QUALITIES = ["C", "D", "E", "F", "G", "A", "B"], ["", "#", "b"], ["maj", "min", "7", "dim"]
_ROOT = "(([0, 2, 4, 5, 7, 9, 11])[c_custkey % 7 + 1] + ([0, 1, -1])[c_nationkey % 3 + 1] + 12) % 12"


def _drawn(names, by):
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))


def _roots(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c, F.concat(_drawn(_LETTERS, F.col("c_custkey")), _drawn(_SIGNS, F.col("c_nationkey")))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 12 ELSE {_ROOT} END::INT AS root, CASE WHEN c_custkey % 11 = 0 THEN 'N' ELSE (['maj', 'min', '7', 'dim'])[c_custkey % 4 + 1] END AS quality FROM customer""")
def chord_labels(spark, sf_dir):
    """Labels of a root, a quality and now and then a bass, drawn by the customers' keys."""
    c, root = _roots(spark, sf_dir)
    bass = F.when(F.col("c_custkey") % 2 == 1, "/5").otherwise("")
    label = F.when(F.col("c_custkey") % 11 == 0, "N").otherwise(F.concat(root, F.lit(":"), _drawn(_QUALITIES, F.col("c_custkey")), bass))
    return c.select("c_custkey", p.chord_label(label).alias("c")).select("c_custkey", "c.root", "c.quality")


@query(f"SELECT c_custkey, {_ROOT}::INT AS tonic, (c_custkey % 2)::INT AS minor FROM customer")
def global_key_labels(spark, sf_dir):
    """Keys of labels, with letters of either case."""
    c, root = _roots(spark, sf_dir)
    label = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lower(F.substring(root, 1, 1)), F.substring(root, 2, 9))).otherwise(root), F.when(F.col("c_custkey") % 2 == 1, ":min").otherwise(":maj"))
    return c.select("c_custkey", p.key_of_label(label).alias("k")).select("c_custkey", F.col("k.tonic").cast("int").alias("tonic"), "k.minor")


_BOUNDS = "b AS (SELECT song_id, min(pitch)::BIGINT AS low, max(pitch)::BIGINT AS high FROM facts GROUP BY 1)"
_LEGAL = "list_filter([-5,-4,-3,-2,-1,0,1,2,3,4,5,6], lambda s: low - 10 + s >= 0 AND high + 12 + s <= 127)"


def _bounds(spark, sf_dir):
    return facts(spark, sf_dir).where("event_type = 'NOTE'").groupBy("song_id").agg(F.min("pitch").cast("bigint").alias("low"), F.max("pitch").cast("bigint").alias("high"))


@query("{facts}, " + _BOUNDS + " SELECT * FROM b")
def pitch_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)


def _draw(fields: str) -> str:
    return f"legal[((('0x' || substr(sha256({fields}), 1, 16))::UBIGINT % len(legal)::UBIGINT)::INT + 1)]"


@query("{facts}, " + _BOUNDS + f", l AS (SELECT *, {_LEGAL} AS legal FROM b) SELECT song_id, low, high, len(legal)::BIGINT AS n, array_to_string(legal, ',') AS legal_list, " + _draw("'shift|unit|' || song_id || '|3|17|0'") + " AS shift, " + _draw("'move|' || song_id || '|3|17|0'") + " AS plain_shift FROM l")
def drawn_shifts(spark, sf_dir):
    low, high = F.col("low") - 10, F.col("high") + 12
    rows = _bounds(spark, sf_dir)
    legal = p.legal_shifts(low, high)
    drawn = p.drawn_shift("shift", F.lit("unit"), F.col("song_id"), F.lit(3), F.lit(17), F.lit(0), least=low, most=high)
    plain = p.drawn_shift("move", F.col("song_id"), F.lit(3), F.lit(17), F.lit(0), least=low, most=high)
    return rows.select("song_id", "low", "high", F.size(legal).cast("bigint").alias("n"), F.array_join(legal.cast("array<string>"), ",").alias("legal_list"), drawn.alias("shift"), plain.alias("plain_shift"))


@query("""{rested}, s AS (SELECT song_id, (song_id % 12 - 5)::INT AS shift FROM (SELECT DISTINCT song_id FROM facts))
SELECT r.song_id, onset, event_type, duration, coalesce(pitch + shift, -1)::BIGINT AS canonical, coalesce(pitch, -1)::BIGINT AS restored, coalesce((pitch + shift) % 128, -1)::BIGINT AS cyclic FROM rested r JOIN s USING (song_id)""")
def pitch_shift_roundtrip(spark, sf_dir):
    rows = ev.insert_rests(facts(spark, sf_dir))
    shifts = rows.select("song_id").distinct().withColumn("shift", F.pmod("song_id", F.lit(12)) - 5)
    rows = rows.join(shifts, "song_id").withColumn("canonical", p.shifted(F.col("pitch").cast("bigint"), F.col("shift")))
    return rows.select("song_id", "onset", "event_type", "duration", F.coalesce("canonical", F.lit(-1)).alias("canonical"), F.coalesce(p.shifted(F.col("canonical"), F.col("shift"), -1), F.lit(-1)).alias("restored"), F.coalesce(F.pmod(F.col("pitch") + F.col("shift"), F.lit(128)), F.lit(-1)).alias("cyclic"))


@query("""{facts}, s AS (SELECT song_id, (song_id % 12 - 5) AS shift FROM (SELECT DISTINCT song_id FROM facts)), a(arm) AS (VALUES ('E'), ('F'), ('G'), ('H'))
SELECT arm, f.song_id, onset, duration, (CASE WHEN arm = 'F' THEN pitch + shift ELSE pitch END)::BIGINT AS shown, (CASE WHEN arm IN ('F', 'G') THEN shift ELSE 0 END)::BIGINT AS charged FROM facts f JOIN s USING (song_id), a""")
def tonal_arm_views(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("shift", F.pmod("song_id", F.lit(12)) - 5).withColumn("arm", F.explode(F.array(*map(F.lit, "EFGH"))))
    moved = p.shifted(F.col("pitch").cast("bigint"), F.when(F.col("arm").isin("F", "G"), F.col("shift")).otherwise(0))
    shown = F.when(F.col("arm") == "G", p.shifted(moved, F.col("shift"), -1)).otherwise(moved)
    return rows.select("arm", "song_id", "onset", "duration", shown.alias("shown"), F.when(F.col("arm").isin("F", "G"), F.col("shift")).otherwise(0).cast("bigint").alias("charged"))



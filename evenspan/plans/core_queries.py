"""The flagship query: from raw events to bits per fact, by window and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codelen
from ..operators import events as ev
from ..operators import ledger
from .base import facts, query, rounded

_SPLIT = "CASE WHEN song_id % 10 = 0 THEN 'test' WHEN song_id % 10 = 1 THEN 'validation' ELSE 'train' END"


def _coded(spark, sf_dir):
    """Facts and rests with the literal bits of their pitch, kind and duration class, by window."""
    rows = ev.windows(ev.insert_rests(facts(spark, sf_dir)), most=None)
    m = F.pmod("song_id", F.lit(10))
    rows = rows.withColumn("split", F.when(m == 0, "test").when(m == 1, "validation").otherwise("train"))
    value = F.concat_ws(":", "event_type", F.coalesce(F.col("pitch").cast("string"), F.lit("-")), F.expr("duration div 96").cast("string"))
    rows = rows.withColumn("value", value)
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    return rows.join(codelen.literal_bits(counts), "value")


_SQL = f"""{{rested}}, w AS (SELECT song_id, onset // 3072 * 8 AS start_bar, event_type || ':' || coalesce(pitch::VARCHAR, '-') || ':' || duration // 96 AS value, {_SPLIT} AS split FROM rested),
c AS (SELECT value, count(*) AS n FROM w GROUP BY 1), t AS (SELECT sum(n) AS total, greatest(2, count(*) + 1) AS v FROM c), b AS (SELECT value, -log2((n + 0.25) / (total + 0.25 * v)) AS bits FROM c, t), j AS (SELECT * FROM w JOIN b USING (value))"""


@query(_SQL + " SELECT split, song_id, start_bar, count(*) AS facts, round(sum(bits), 5) + 0.0 AS bits FROM j GROUP BY 1, 2, 3")
def window_code_lengths(spark, sf_dir):
    return _coded(spark, sf_dir).groupBy("split", "song_id", "start_bar").agg(F.count("*").alias("facts"), rounded(F.sum("bits"), 5).alias("bits"))


@query(_SQL + " SELECT split, count(*) AS facts, round(sum(bits) / count(*), 6) + 0.0 AS bits_per_fact FROM j GROUP BY 1")
def bits_per_fact_by_split(spark, sf_dir):
    zero = {c: F.lit(0.0).alias(c) for c in ledger.CHANNELS if c != "time"}
    rows = _coded(spark, sf_dir).select("split", F.lit(1).alias("facts"), F.col("bits").alias("time"), *zero.values())
    return ledger.ledger(rows, ["split"]).select("split", "facts", rounded(F.col("bits_per_fact")).alias("bits_per_fact"))

"""Registration of queries, and the tables that they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` is DuckDB's version of it, where ``{facts}`` and the like stand for common tables."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = expanded(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.facts_of(table(spark, sf_dir, "events"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


#: Common tables as DuckDB queries, each of which may use those before it.
CTES = {
    "facts": """facts AS (SELECT user_id AS song_id, 'NOTE' AS event_type, (floor(epoch(ts))::BIGINT - 1704067200) // 60 AS onset,
      greatest(1, floor(value))::BIGINT AS duration, (14 + (props->>'k')::INT)::INT AS pitch FROM events WHERE event_type <> 'error')""",
    "gaps": """gaps AS (SELECT *, max(onset + duration) OVER (PARTITION BY song_id ORDER BY onset, pitch, duration, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM facts)""",
    "rested": """rested AS (SELECT song_id, event_type, onset, duration, pitch FROM facts UNION ALL
      SELECT song_id, 'REST', coalesce(reach, 0), onset - coalesce(reach, 0), NULL FROM gaps WHERE onset - coalesce(reach, 0) >= 1)""",
    "ordered": """ordered AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY onset, coalesce(pitch, -1), duration, event_type) AS ord FROM rested)""",
    "groups": """groups AS (SELECT song_id, onset, list({'pitch': pitch, 'duration': duration} ORDER BY pitch, duration) AS notes, max(onset + duration) AS fin FROM facts GROUP BY ALL)""",
    "reached": """reached AS (SELECT *, max(fin) OVER (PARTITION BY song_id ORDER BY onset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM groups)""",
    "atoms": """atoms AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY anchor, kind DESC) - 1 AS t FROM (
      SELECT song_id, 'NOTE' AS kind, onset AS anchor, NULL::BIGINT AS rest, notes FROM reached UNION ALL
      SELECT song_id, 'REST', reach, onset - reach, NULL FROM reached WHERE onset - reach >= {gap}))""",
    "tokens": """tokens AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY t, pitch, duration) AS ord FROM (
      SELECT song_id, t, 3 AS kind, anchor, 0 AS pitch, rest AS duration FROM atoms WHERE kind = 'REST' UNION ALL
      SELECT song_id, t, 2, anchor, n.pitch, n.duration FROM (SELECT song_id, t, anchor, unnest(notes) AS n FROM atoms WHERE kind = 'NOTE')))""",
}
NEEDS = {"gaps": ["facts"], "rested": ["facts", "gaps"], "ordered": ["facts", "gaps", "rested"], "groups": ["facts"], "reached": ["facts", "groups"], "atoms": ["facts", "groups", "reached"], "tokens": ["facts", "groups", "reached", "atoms"], "facts": []}


def with_tables(name: str, gap: int = 1) -> str:
    """WITH ... of a common table and what it needs; more tables or a SELECT may follow."""
    return "WITH " + ",\n".join(CTES[n].replace("{gap}", str(gap)) for n in [*NEEDS[name], name])


def expanded(sql: str) -> str:
    for name in CTES:
        sql = sql.replace(f"{{{name}}}", with_tables(name)).replace(f"{{{name}96}}", with_tables(name, 96))
    return sql

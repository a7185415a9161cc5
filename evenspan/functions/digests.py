"""Digests of values, rows and ordered sets."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, purpose: str, value: Column) -> Column:
    """An order that is drawn anew for each seed and purpose."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), value.cast("string")), 256)


def reduced_fraction(ticks: Column, per_beat: int = 96) -> Column:
    """Ticks as a reduced fraction of a beat, numerator/denominator."""
    # the divisor depends on the rest alone, so it is looked up in an array that is folded into one literal
    at = F.pmod(ticks, F.lit(per_beat)).cast("int")
    by = F.get(F.array(*(F.lit(gcd(i, per_beat)) for i in range(per_beat))), at)
    under = F.get(F.array(*(F.lit(str(per_beat // gcd(i, per_beat))) for i in range(per_beat))), at)
    return F.concat_ws("/", F.call_function("div", ticks.cast("bigint"), by.cast("bigint")).cast("string"), under)


def json_text(*fields: tuple[str, Column, bool]) -> Column:
    """Compact JSON with sorted keys from (name, value, is text); null prints as null."""
    parts = []
    for name, value, text in sorted(fields, key=lambda f: f[0]):
        shown = F.concat(F.lit('"'), value, F.lit('"')) if text else value.cast("string")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(shown, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def list_text(*values: tuple[Column, bool]) -> Column:
    """A compact JSON list from (value, is text)."""
    shown = (F.concat(F.lit('"'), v, F.lit('"')) if text else v.cast("string") for v, text in values)
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(s, F.lit("null")) for s in shown)), F.lit("]"))


def ordered_text(order: Column, text: Column, separator: str = ",") -> Column:
    """Aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)

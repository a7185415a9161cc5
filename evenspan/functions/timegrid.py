"""Columns over the integer time grid: 96 ticks a beat, 4 beats a bar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BEAT, BAR = 96, 384
MAX_BARS = 256
#: Edges of the signed time buckets.
TIME_EDGES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 192, 384, 768, 1536)


def div(a: Column, n: int | Column) -> Column:
    """Floor division of integers, as integers."""
    n = F.lit(n) if isinstance(n, int) else n
    return ((a - F.pmod(a, n)) / n).cast("bigint")


def musical_time(onset: Column) -> Column:
    """bar, tick in bar, tick in beat, beat of an onset; negative onsets are an error."""
    onset = F.when(onset >= 0, onset).otherwise(F.raise_error(F.lit("negative onset")).cast("bigint"))
    return F.struct(div(onset, BAR).alias("bar"), F.pmod(onset, F.lit(BAR)).alias("tick"), F.pmod(onset, F.lit(BEAT)).alias("beat_tick"), div(F.pmod(onset, F.lit(BAR)), BEAT).alias("beat"))


def onset_of(bar: Column, tick: Column) -> Column:
    return bar * BAR + tick


def cyclic_phase(index: Column, period: int) -> Column:
    """Sine and cosine of the place in the period, by name: callers order them as they need."""
    angle = F.pmod(index, F.lit(period)) * (2 * math.pi / period)
    return F.struct(F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


def multiscale_time(onset: Column) -> Column:
    """Bar, tick, and phases of the sixteenth with periods of a beat, a bar and four bars."""
    sixteenth = div(onset, BEAT // 4)
    phases = {f"phase{p}": cyclic_phase(sixteenth, p) for p in (4, 16, 64)}
    return F.struct(div(onset, BAR).alias("bar"), F.pmod(onset, F.lit(BAR)).alias("tick"), *(p.alias(n) for n, p in phases.items()))


def split_ticks(value: Column) -> Column:
    """Bars (under 256) and remainder; other values are an error."""
    sound = F.when((value >= 0) & (value < MAX_BARS * BAR), value).otherwise(F.raise_error(F.lit("ticks out of range")).cast("bigint"))
    return F.struct(div(sound, BAR).alias("bars"), F.pmod(sound, F.lit(BAR)).alias("remainder"))


def signed_log_bucket(value: Column, most: int = 31) -> Column:
    """0 for 0, else the sign times 1 + the whole binary logarithm, at most ``most``."""
    size = F.least(F.lit(most), 1 + F.floor(F.log2(F.abs(value).cast("double")))).cast("bigint")
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def signed_exact_log_bucket(value: Column, buckets: int = 32, exact: int = 16, longest: int = 32 * BAR) -> Column:
    """0; 1..32 for positive and 33..64 for negative distances: the first 16 magnitudes exactly, then by logarithm."""
    size = F.abs(value)
    log = exact + F.floor(F.log(F.greatest(size, F.lit(exact + 1)) / exact) / math.log(longest / exact) * (buckets - exact))
    bucket = F.least(F.when(size <= exact, size - 1).otherwise(log), F.lit(buckets - 1))
    return F.when(value == 0, 0).when(value > 0, 1 + bucket).otherwise(1 + buckets + bucket).cast("bigint")


def unit_distance(value: Column, unit: int) -> Column:
    """Toward zero on either side."""
    return (F.signum(value.cast("double")).cast("bigint") * div(F.abs(value), unit)).cast("bigint")


def floor_distance(value: Column, unit: int) -> Column:
    return div(value, unit)


def signed_time_bucket(delta: Column) -> Column:
    """0 for 0, else 1 + 2 * (edges below the distance) + (1 if positive)."""
    below = F.size(F.filter(F.array(*map(F.lit, TIME_EDGES)), lambda e: e < F.abs(delta)))
    return F.when(delta == 0, 0).otherwise(1 + 2 * below + F.when(delta > 0, 1).otherwise(0)).cast("bigint")


def unary_time(onset: Column) -> dict[str, Column]:
    """Thirteen features of an anchor: three of the bar's order and five phase pairs."""
    bar = div(F.greatest(onset, F.lit(0)), BAR).cast("double")
    share = bar / (MAX_BARS - 1)
    out = {"bar_linear": share, "bar_log": F.log1p(bar) / math.log(MAX_BARS), "bar_root": F.sqrt(share)}
    for name, index, period in (("beat_tick", F.pmod(onset, F.lit(BEAT)), BEAT), ("beat", div(onset, BEAT), 4), ("bar", onset, BAR), ("four", onset, 4 * BAR), ("sixteen", onset, 16 * BAR)):
        phase = cyclic_phase(index, period)
        out |= {f"{name}_sin": phase["sin"], f"{name}_cos": phase["cos"]}
    return out


def sequence_position(position: Column, width: int) -> Column:
    """Sines then cosines of the position at geometric scales with base 10000, cut to ``width``."""
    half = max(1, width // 2)
    scales = F.array(*(F.lit(math.exp(-math.log(10000.0) * i / max(1, half - 1))) for i in range(half)))
    both = F.concat(F.transform(scales, lambda s: F.sin(position * s)), F.transform(scales, lambda s: F.cos(position * s)))
    return F.slice(F.concat(both, F.array_repeat(F.lit(0.0), max(0, width - 2 * half))), 1, width)


def next_anchor(mode: Column, anchor: Column, value: Column, rest: Column) -> Column:
    """The next onset: as given, after the previous one, or after a rest."""
    return F.when(mode == "absolute", value).when(mode == "delta", anchor + value).when(mode == "rest", anchor + rest)


def learning_rate(exposure: Column, base: float, least: float, warmup: int, end: int) -> Column:
    """Linear to ``base`` over the warm-up, then a half cosine to ``least``; the exposure is held to 1..end."""
    x = F.least(F.greatest(exposure, F.lit(1)), F.lit(end))
    cosine = least + 0.5 * (base - least) * (1 + F.cos((x - warmup) / max(1, end - warmup) * math.pi))
    return F.when(x <= warmup, base * x / max(1, warmup)).otherwise(cosine)


def event_budget(events: Column, epochs: Column) -> Column:
    """Rounded half to even; both must be positive."""
    sound = (events > 0) & (epochs > 0)
    return F.when(sound, F.bround(events * epochs)).otherwise(F.raise_error(F.lit("budget needs positive inputs")).cast("double")).cast("bigint")

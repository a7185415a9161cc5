"""Delta scoring of all candidates equals scoring both corpora again for each."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest

from evenspan.operators import merge_gain

from .test_merge_fit import corpus, frame, joined

START, ESCAPE = merge_gain.START, merge_gain.ESCAPE


def digest(text):
    return hashlib.sha256(json.dumps(text, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def held_bits(fit, held, vocabulary, alpha=0.25, weight=0.75):
    uni, ctx, big = Counter(), Counter(), Counter()
    for s in fit:
        for p, t in zip([START, *s], s):
            uni[t] += 1
            ctx[p] += 1
            big[p, t] += 1
    v, total = len(vocabulary) + 1, sum(uni.values())
    bits = 0.0
    for s in held:
        s = [t if t in vocabulary else ESCAPE for t in s]
        for p, t in zip([START, *s], s):
            bits -= math.log2(weight * (big[p, t] + alpha) / (ctx[p] + alpha * v) + (1 - weight) * (uni[t] + alpha) / (total + alpha * v))
    return bits


def plain(fit, held, merges, pool, least_gain, min_count=2, min_songs=1, longest=None, barrier=None):
    fit, held, steps = [list(s) for s in fit], [list(s) for s in held], []
    vocabulary, units = {t for s in fit for t in s}, sum(map(len, held))
    for _ in range(merges):
        n, songs, there = Counter(), Counter(), Counter()
        for s in fit:
            n.update(zip(s, s[1:]))
            songs.update(set(zip(s, s[1:])))
        for s in held:
            there.update(zip(s, s[1:]))
        fits = [p for p in n if n[p] >= min_count and songs[p] >= min_songs and barrier not in p and (longest is None or len(" ".join(p).split()) <= longest)]
        fits = sorted(fits, key=lambda p: (-n[p], -songs[p], hashlib.sha256(" ".join(p).encode()).hexdigest()))[:pool]
        fits = [p for p in fits if there[p]]
        if not fits:
            break
        before = held_bits(fit, held, vocabulary)
        scored = []
        for p in fits:
            f, h = [joined(s, *p) for s in fit], [joined(s, *p) for s in held]
            scored.append((before - held_bits(f, h, vocabulary | {" ".join(p)}), p, f, h))
        gain, p, f, h = min(scored, key=lambda x: (-x[0], digest(" ".join(x[1]))))
        if gain / max(units, 1) <= least_gain:
            break
        steps.append((*p, n[p], songs[p], gain / max(units, 1), before, sum(map(len, held)) - sum(map(len, h)), len(fits)))
        fit, held = f, h
        vocabulary.add(" ".join(p))
    return steps


@pytest.mark.parametrize("seed,limits", [(1, {"pool": 6}), (2, {"pool": 5, "min_songs": 5, "longest": 3, "barrier": "t1", "min_count": 4}), (3, {"pool": 4, "least_gain": 0.02})])
def test_equals_plain(spark, seed, limits):
    least = limits.pop("least_gain", -1.0)
    fit = corpus(seed, letters=9) + [[], ["t1"] * 7]
    held = corpus(seed, songs=40, letters=11)[::2] + [[], ["new"], ["t1", "new", "t2", "t3"]]
    got = merge_gain.fit_predictive(frame(spark, fit), frame(spark, held), 4, least_gain=least, **limits)
    want = plain(fit, held, 4, least_gain=least, **limits)
    assert [(s["left"], s["right"], s["count"], s["songs"]) for s in got] == [w[:4] for w in want]
    for s, w in zip(got, want):
        assert math.isclose(s["gain"], w[4], abs_tol=1e-9) and math.isclose(s["bits_before"], w[5], rel_tol=1e-9)
        assert (s["held_places"], s["candidates"]) == w[6:]


def test_nothing_to_take(spark):
    empty = frame(spark, [])
    assert merge_gain.fit_predictive(empty, empty, 3) == []
    assert merge_gain.fit_predictive(frame(spark, [["a", "b"]]), frame(spark, [["c"]]), 3) == []


def test_table_follows_what_is_taken(spark):
    fit, held = corpus(7), corpus(8, songs=9)
    table = merge_gain.PairTable(frame(spark, fit), frame(spark, held))
    pairs = [r for r in table.table.where("l <> '<s>' and n > 3").orderBy("l", "r").limit(3).collect()]
    pairs = [(r["l"], r["r"]) for r in pairs]
    for c in (2, 0):
        changes = table.changes(pairs)
        table.take(pairs[c], c, changes)
        fit, held = [joined(s, *pairs[c]) for s in fit], [joined(s, *pairs[c]) for s in held]
    n, songs, h = Counter(), Counter(), Counter()
    known = {t for s in fit for t in s}
    for s in fit:
        n.update(zip([START, *s], s))
        songs.update(set(zip([START, *s], s)))
    for s in held:
        s = [t if t in known or " " in t else ESCAPE for t in s]
        h.update(zip([START, *s], s))
    got = {(r["l"], r["r"]): (r["n"], r["songs"], r["h"]) for r in table.table.collect()}
    assert got == {p: (n[p], songs[p], h[p]) for p in n.keys() | h.keys()}
    table.close()


def test_random_pairs_of_one_symbol(spark):
    rng = random.Random(5)
    fit = [rng.choices("ab", k=rng.randrange(12)) for _ in range(20)]
    held = [rng.choices("abz", k=rng.randrange(12)) for _ in range(20)]
    got = merge_gain.fit_predictive(frame(spark, fit), frame(spark, held), 3, pool=4, least_gain=-9.0)
    want = plain(fit, held, 3, 4, -9.0)
    assert [(s["left"], s["right"], s["count"]) for s in got] == [w[:3] for w in want]
    assert all(math.isclose(s["gain"], w[4], abs_tol=1e-9) for s, w in zip(got, want))

"""Merges by an index equal those of the plain loop, whatever is taken in one round."""

import hashlib
import random
from collections import Counter

import pytest

from evenspan.operators import bpe, merge_fit
from evenspan.sources import shared


def joined(seq, a, b):
    out = []
    for x in seq:
        if out and out[-1] == a and x == b:
            out[-1] = f"{a} {b}"
        else:
            out.append(x)
    return out


def plain(seqs, merges, min_count=2, min_songs=1, longest=None, barrier=None, order="pair"):
    seqs, rules = [list(s) for s in seqs], []
    for _ in range(merges):
        n, songs = Counter(), Counter()
        for s in seqs:
            n.update(zip(s, s[1:]))
            songs.update(set(zip(s, s[1:])))
        known = {f"{a} {b}" for a, b, _ in rules}
        fit = [p for p in n if n[p] >= min_count and songs[p] >= min_songs and " ".join(p) not in known and (longest is None or len(" ".join(p).split()) <= longest) and barrier not in p]
        if not fit:
            break
        tie = (lambda p: p) if order == "pair" else (lambda p: (-songs[p], hashlib.sha256(" ".join(p).encode()).hexdigest()))
        best = min(fit, key=lambda p: (-n[p], tie(p)))
        rules.append((*best, n[best]))
        seqs = [joined(s, *best) for s in seqs]
    return rules, seqs


def corpus(seed, songs=30, letters=12, length=60):
    rng = random.Random(seed)
    words = [[f"t{rng.randrange(letters)}" for _ in range(rng.randrange(1, 7))] for _ in range(25)]
    return [sum((rng.choices(words, weights=range(25, 0, -1))[0] for _ in range(rng.randrange(0, length // 4))), []) for _ in range(songs)]


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "song_id long, symbols array<string>")


@pytest.mark.parametrize("seed,letters,limits", [(2, 40, {}), (3, 3, {}), (4, 8, {"min_songs": 4, "longest": 3, "barrier": "t1", "order": "support", "min_count": 3})])
def test_equals_plain(spark, seed, letters, limits):
    seqs = corpus(seed, letters=letters) + [[], ["t0"], ["t0"] * 9, ["t0", "t1"] * 5]
    stats = {}
    got = merge_fit.fit(frame(spark, seqs), 14, stats=stats, **limits)
    want, _ = plain(seqs, 14, **limits)
    assert got == want
    assert stats["rounds"] <= len(want)


def test_counts_and_sequences_follow(spark):
    seqs = corpus(9, letters=30)
    index = merge_fit.MergeIndex(frame(spark, seqs))
    rules, after = plain(seqs, 10)
    for a, b, _ in rules:
        index.merge([(a, b)])
    assert {r["song_id"]: r["symbols"] for r in index.sequences().collect()} == dict(enumerate(after))
    n, songs = Counter(), Counter()
    for s in after:
        n.update(zip(s, s[1:]))
        songs.update(set(zip(s, s[1:])))
    assert {(r["l"], r["r"]): (r["n"], r["songs"]) for r in index.counts().collect()} == {p: (n[p], songs[p]) for p in n}
    index.close()
    assert not shared.exists(spark, index.folder)


def test_to_a_vocabulary(spark):
    seqs = corpus(11, songs=60, letters=150, length=160)
    stats = {}
    rules = merge_fit.fit_to(frame(spark, seqs), 180, alphabet=150, stats=stats)
    assert rules == plain(seqs, 30)[0]
    assert stats["written"] < 20 * stats["rows"] and stats["rounds"] < len(rules)
    got = merge_fit.receipt(rules, 150, 180, len(seqs), 2)
    assert got["vocabulary_size"] == 150 + len(rules) and got == merge_fit.receipt(rules, 150, 180, len(seqs), 2)
    with pytest.raises(ValueError):
        merge_fit.fit_to(frame(spark, seqs), 150, alphabet=150)


def test_independent_pairs():
    take = merge_fit.independent
    assert take([], set(), 9, True, True) == []
    assert take([("a", "b", 9), ("c", "d", 8), ("b", "c", 7)], set(), 9, True, True) == [("a", "b", 9), ("c", "d", 8)]
    assert take([("a", "b", 9), ("c", "d", 8)], set(), 1, True, True) == [("a", "b", 9)]
    assert take([("a", "b", 9), ("c", "d", 8), ("e", "f", 8)], set(), 9, False, True) == [("a", "b", 9)]  # the last count isn't complete
    assert take([("a", "b", 9), ("c", "d", 8), ("e", "a", 8)], set(), 9, True, True) == [("a", "b", 9), ("c", "d", 8)]  # (e, a b) is after (c, d)
    assert take([("p", "q", 9), ("x", "y", 8), ("b", "p", 8)], set(), 9, True, True) == [("p", "q", 9)]  # (b, p q) would be before (x, y)
    assert take([("a", "b", 9), ("c", "d", 8)], {"c d"}, 9, True, True) == [("a", "b", 9)]


def test_fit_of_bpe_is_the_same(spark):
    seqs = corpus(13)
    assert bpe.fit(frame(spark, seqs), 4) == plain(seqs, 4)[0]

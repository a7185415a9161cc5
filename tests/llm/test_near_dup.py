import random
import re

import numpy as np
import pytest
from evenspan.llm import graph, near_dup

from .conftest import EDGES


def plain(rows, threshold=85):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= threshold * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def copies(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (1, 1, 2, 5, 60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
            rows.append((n, rng.choice([" ", "\t", "  "]).join(words).title()))
            n += 1
    return rows


def check(got, want):
    key = lambda r: str(tuple(r))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_equals_brute_force(table):
    rows = copies()
    check(near_dup.near_duplicates(table(rows)).collect(), plain(rows))


def test_edges_and_empty(table, edges):
    check(near_dup.near_duplicates(edges).collect(), plain(EDGES))
    assert near_dup.near_duplicates(table([])).collect() == []


@pytest.mark.parametrize("name, value", [("BLOCK", 300), ("ROWS", 3), ("ROWS", 1)])
def test_parts_lose_no_links(table, monkeypatch, name, value):
    monkeypatch.setattr(near_dup, name, value)
    rows = copies(5)
    check(near_dup.near_duplicates(table(rows)).collect(), plain(rows))


def test_chains_over_many_parts(table, monkeypatch):
    """Links that the first member's component doesn't reach within a part: each text is like its neighbours only."""
    monkeypatch.setattr(near_dup, "ROWS", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(60)] + [(100 + i, " ".join(words[150 + 2 * i : 250 + 2 * i])) for i in range(0, 20, 9)]
    check(near_dup.near_duplicates(table(rows)).collect(), plain(rows))


def test_repeated_and_null_ids_link_nothing(table):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a + " z"), (None, "only nulls have this text here"), (None, "only nulls have this text here")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True)], key=str)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = []
        for _ in range(25):
            s = base.copy()
            k = rng.integers(0, 12)
            s[rng.choice(60, k, False)] = rng.integers(0, 1 << 60, k).astype(np.uint64)
            sets.append(np.unique(s))
        parts = []
        for pairs in (near_dup.links(sets, 0.85, 320), [(i, j) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]):
            root = list(range(25))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
            parts.append(root)
        assert parts[0] == parts[1]


def test_searched_sets_give_a_link_for_each_joined_component():
    """Not all their pairs, whose number grows with the square of a group."""
    s = np.arange(100, dtype=np.uint64)
    sets = [np.concatenate((s[:97], np.array([1000 + i], np.uint64))) for i in range(40)]
    assert len(near_dup.links(sets, 0.85, 320, [True] * 40, list(range(40)))) == 39
    assert len(near_dup.links(sets, 0.85, 320, [True] * 40, [i // 10 for i in range(40)])) == 3
    assert near_dup.links(sets, 0.85, 320, [True] * 40, [7] * 40) == []
    assert near_dup.links(sets, 0.85, 320, [False] * 40, list(range(40))) == []


def test_large_groups_of_near_copies_give_few_links(table, monkeypatch):
    """A group whose smallest member is like none of the dense part."""
    monkeypatch.setattr(near_dup, "ROWS", 10)
    made, kept = [], near_dup.stored

    def counted(df, name):
        df = kept(df, name)
        if name == "links":
            made.append(df.count())
        return df

    monkeypatch.setattr(near_dup, "stored", counted)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base[:60] + [f"x{i}" for i in range(20)] + base[80:]))]
    for i in range(1, 120):
        words = list(base)
        words[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(words)))
    check(near_dup.near_duplicates(table(rows)).collect(), plain(rows))
    assert sum(made) < 3 * len(rows)


def test_estimate_and_merge():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = np.concatenate((a[:2400], rng.integers(0, 1 << 63, 600).astype(np.uint64)))
    both = near_dup.sketches([a, b, np.unique(np.concatenate((a, b)))], 1024)
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    more, less = (both[0] > both[1]).sum(), (both[0] < both[1]).sum()
    got = near_dup.joint_estimate(np.array([more]), np.array([less]), np.array([1024 - more - less]), 3000.0, np.array([3000.0]))[0]
    assert abs(got - 2400 / 3600) < 0.06


def test_long_words_and_chunks():
    text = ("a" * (9 * near_dup.CHUNK) + " b c d e f").encode()
    h, first = near_dup.word_hashes(text)
    assert len(first) >= 6 and (h[-5:] == near_dup.word_hashes(b"b c d e f")[0]).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (None, 5), (7, 7)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_long_words_hash_alike_after_any_neighbour():
    text = "one two " + "ab" * (5 * near_dup.CHUNK // 2) + " three four five six " + "q" * (8 * near_dup.CHUNK)
    alone = next(near_dup.shingle_sets([text]))
    assert len(alone) == 4
    for before in ("", "x y z", "x y z " * 1000, "k" * (near_dup.CHUNK - 9)):
        assert (list(near_dup.shingle_sets([before, text]))[1] == alone).all()
    for size in (4 * near_dup.CHUNK - 1, 4 * near_dup.CHUNK, 4 * near_dup.CHUNK + 1):
        h, first = near_dup.word_hashes(b"a" * size + b" b")
        assert first.tolist() == [0, size + 1] and h[1] == near_dup.word_hashes(b"b")[0][0]

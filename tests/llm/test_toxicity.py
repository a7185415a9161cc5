import itertools
import random
import zlib
from collections import Counter

from evenspan.llm import toxicity
from pyspark.sql import functions as F

from .conftest import EDGES

BAD = ["idiot", "moron", "scumbag"]


def corpus(n=700, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "the", "or", "is", "en", "st", "al"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def restorer():
    rows, _ = corpus()
    counts = Counter()
    for _, t in rows:
        c = toxicity.folded(f" {t} ")
        counts.update((((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:]).tolist())
    return toxicity.Restorer(list(counts), list(counts.values()))


def test_restores_obfuscated_words():
    r = restorer()
    for shown, meant in [("1d10t", "idiot"), ("idiooooot", "idiot"), ("m0r0n!!", "moron"), ("i.d.i.o.t", "idiot"), ("$cumb@g", "scumbag"), ("moron", "moron"), ("mo-ron", "moron")]:
        assert r.token(shown) == meant, shown
    assert "idiot" in r.words("you i d i o t there") and r.token("the###") == "the"


def test_restores_long_spaced_and_short_forms():
    r = restorer()
    marked = ".".join("idiotidiotidiotmoronmoron")
    shown = {"idi" + "o" * 40 + "t": "idiot", "m" + "." * 9 + "o.r.o.n": "moron", "5cumb@9": "scumbag", "1d10+": "idiot", marked: "idiotidiotidiotmoronmoron"}
    for token, meant in shown.items():
        assert r.token(token) == meant, token
    assert {"idiot", "moron"} <= r.words("so i d i o t m o r o n there")
    assert {"idiot", "moron"} <= r.words("i  d\ti o t m 0 r 0 n ")
    assert r.words(" ".join("idiot" * 60)) == {*"idot", "idiot"}
    for token in ("https://a.b/1d10t", "0123456789abcdef0123", "id.iot@mo.ron"):
        assert r.token(token) == token


def test_held_out_and_obfuscated(spark, table):
    rows, labels = corpus()
    extra = [(10_001, "the or is m0r0n an al 1d10t en"), (10_002, "the or is an al en"), *((20_000 + k if i else i, t) for k, (i, t) in enumerate(EDGES))]
    got = {r["doc_id"]: r for r in toxicity.score(table(rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, *_ in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)
    truth = {i: y for i, _, y in labels}
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert got[10_001]["predicted"] == 1 and got[10_002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[20_000]["predicted"] == 0 and None in got


def test_without_labels(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(table([(1, "x")]), none).collect()] == [0]
    assert toxicity.score(table([]), none).collect() == []
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(table([(1, "x")]), odd).collect()] == [0]


def test_fit_separates():
    w, b = toxicity.fit([(1, [0]), (1, [0, 1]), (0, [1]), (0, [])] * 20, 2)
    assert w[0] + b > 2 and b < -1 and w[1] + b < 0
    assert len(toxicity.fit([(0, [])], 0)[0]) == 0


def every_path(model, token):
    """The best restored form by trying all paths."""
    best = (-1e18, "")
    arcs = model.arcs(token)
    ways = [model._ways(char, times, inside) for char, times, inside, _ in arcs]
    gaps = [[("", 0.0), (" ", 0.0)] if before and k else [("", 0.0)] for k, (*_, before) in enumerate(arcs)]
    for path in itertools.product(*(itertools.product(g, w) for g, w in zip(gaps, ways))):
        text = "".join(a + b for (a, _), (b, _) in path)
        score = sum(x + y for (_, x), (_, y) in path)
        codes = [27, 27, 27, *(ord(c) - 97 if "a" <= c <= "z" else 27 if c == " " else 26 for c in text), 27]
        score += sum(model.log[codes[i]][codes[i + 1]][codes[i + 2]][codes[i + 3]] for i in range(len(codes) - 3))
        best = max(best, (score, text))
    return best[1]


def test_decoding_equals_trying_all_paths():
    r = restorer()
    rng = random.Random(8)
    tokens = ["1d10t", "m0-r0n", "id io t", "a b", "iii d", "!|1", "m o r 0 n", "mo ro n", "s cu mb ag", "$c.um", "o o o", "th e en"]
    tokens += ["".join(rng.choice("idotmrn01!.| ") for _ in range(rng.randrange(2, 8))).strip() or "i" for _ in range(120)]
    for token in tokens:
        token = " ".join(token.split())
        assert r.model.decode(token) == every_path(r.model, token), token


def test_spaces_are_arcs():
    r = restorer()
    assert {"idiot"} <= r.words("you id io t there") and "moron" in r.words("mo ro n") and "idiot" in r.words("the i d i o t")


def test_recall_of_planted_toxic_texts(spark, table):
    """Held-out toxic texts whose bad word is written in some way or other are found, clean ones with such signs aren't."""
    rows, labels = corpus()
    shown = ["1d10t", "i.d.i.o.t", "idiooooot", "m0r0n", "m o r o n", "mo ro n", "$cumb@g", "s-c-u-m-b-a-g", "SCUMBAG", "m*o*r*o*n"]
    planted = [(50_000 + k, f"the or is {w} an al en") for k, w in enumerate(shown)]
    clean = [(60_000 + k, f"the or is {w} an al en") for k, w in enumerate(["a1", "an.al", "is-or", "en!!", "t h e", "https://an.or/is", "10", "al al al"])]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(table(rows + planted + clean), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [w for (i, _), w in zip(planted, shown) if not got[i]] == [] and not any(got[i] for i, _ in clean)
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] for i, y in held if y) / sum(y for _, y in held) > 0.95  # recall
    assert sum(got[i] for i, y in held if not y) / sum(1 - y for _, y in held) < 0.02


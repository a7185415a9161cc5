import random

from evenspan.llm import decontaminate as dc

from .conftest import EDGES

RNG = random.Random(2)


def words(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(n))


ITEMS = [(1, words(40)), (2, words(25)), (3, "tiny"), (4, None), (5, " ?! "), (6, words(40)), (7, words(6))]


def edited(text, k):
    t = list(text)
    for _ in range(k):
        at = RNG.randrange(len(t))
        t[at : at + 1] = RNG.choice([["q"], [], [t[at], "z"]])
    return "".join(t)


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs):
    out = []
    for d, t in docs:
        for i, x in ITEMS:
            item = dc.normalised(x).strip()
            if not item:
                continue
            k = dc.budget(len(item))
            text = dc.normalised(t)
            if len(item) < dc.QGRAM:
                e = 0 if b" " + item + b" " in text else None
            else:
                e = distance(item, text)
                e = e if e <= k else None
            if e is not None:
                out.append((d, i, e, len(item)))
    return sorted(out, key=str)


DOCS = [
    (1, words(30) + " " + ITEMS[0][1] + " " + words(30)), (2, edited(ITEMS[1][1], 6) + "."), (3, words(20) + edited(ITEMS[5][1].upper(), 12)), (4, ITEMS[0][1][:120] + words(20)), (5, "a Tiny, thing"),
    (6, ITEMS[0][1] + "\n" + ITEMS[0][1] + ITEMS[1][1]), (7, words(200)), (8, "tinyish"), (9, (ITEMS[1][1] + ". ").replace(" ", "  , ")), (10, edited(ITEMS[0][1], 60)),
]


def test_equals_brute_force(spark, table):
    rows = DOCS + [(100 + k if i else i, t) for k, (i, t) in enumerate(EDGES) if not t or len(t) < 200]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.contaminated(table(rows), bench).collect()), key=str)
    assert got == brute(rows)
    kept = {r["doc_id"] for r in dc.decontaminated(table(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {r[0] for r in got}


def test_blocks_and_empty(spark, table, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK", 150)
    assert sorted((tuple(r) for r in dc.contaminated(table(DOCS), bench).collect()), key=str) == brute(DOCS)
    assert dc.contaminated(table([]), bench).collect() == []
    assert dc.contaminated(table(DOCS), bench.limit(0)).collect() == []


def test_pairs_counted_in_parts(monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 50)
    index = dc.Items(ITEMS)
    got = sorted((DOCS[d][0], index.ids[i], e, int(index.size[i])) for d, i, e in dc.matches(index, [t for _, t in DOCS]))
    assert sorted(got, key=str) == brute(DOCS)


def test_qgrams():
    raw = bytes(range(1, 40))
    assert [int(x).to_bytes(8, "little") for x in dc.qgrams(raw)] == [raw[i : i + 8] for i in range(32)]
    assert len(dc.qgrams(b"short")) == 0


def test_alignment_is_banded_and_exact():
    for _ in range(300):
        item = "".join(RNG.choice("ab") for _ in range(RNG.randrange(8, 25))).encode()
        k, ahead = RNG.randrange(0, 5), RNG.randrange(0, 4)
        region = edited(item.decode(), RNG.randrange(5)).encode()[RNG.randrange(2) :]
        want = distance_in_band(item, region, ahead)
        assert dc.align(item, region, k, ahead) == (want if want is not None and want <= k else None)


def distance_in_band(item, region, ahead):
    wide = len(region) + ahead - len(item)
    if item in region:
        return 0
    row = {j: 0 for j in range(len(region) + 1) if -ahead <= j <= wide - ahead}
    for i, a in enumerate(item, 1):
        new = {}
        for j in range(len(region) + 1):
            if -ahead <= j - i <= wide - ahead:
                ways = [row[j] + 1] if j in row else []
                ways += [row[j - 1] + (a != region[j - 1])] if j - 1 in row and j else []
                ways += [new[j - 1] + 1] if j - 1 in new else []
                ways += [i] if j == 0 else []
                if ways:
                    new[j] = min(ways)
        row = new
    return min(row.values(), default=None)

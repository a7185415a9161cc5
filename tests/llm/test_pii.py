import hashlib
import math
import random
import re

import regex
from evenspan.llm import pii
from pyspark.sql import functions as F

from .conftest import EDGES


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) < 256 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in KINDS for m in re.finditer(r, text or "") if ok(m[0])]


TEXTS = [
    "mail a.b@c-d.org.uk, x@y or é🎵 q@w.e", "a@b.c_d@e.com f@g.h.i@j.k", "ip 1.2.3.4 256.1.1.1 001.02.3.255 1.2.3.4.5 99999.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 79927398713",
    "call +1 (555) 123-4567 or +44 20 7946 0958. +1", "9 " * 3000, "8" * 6000, "a" * 5000 + "@b", "1.2.3." * 50, "+" * 50 + "12345678901", "1-2 3--4 55", "12 " * 6 + "3-" * 7 + " 4111111111111111", "a1 " * 3000, "4111 1111 1111 1111" + " 4" * 4,
]


def test_base_spans(table):
    rows = [*enumerate(TEXTS), *((i + 100 if i else i, t) for i, t in EDGES)]
    for r in pii.digests(table(rows)).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        want = base(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:60]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want
        assert [r[f"n_{k}"] for k, *_ in KINDS] == [sum(w.startswith(k + ":") for w in want) for k, *_ in KINDS]
    assert pii.digests(table([])).collect() == []


def test_terms_that_reveal_a_value_go(table):
    rows = [(i, f"Please ask Zebulon about it +1 (555) 123-4567 x{i} thanks") for i in range(6)]
    rows += [(50 + i, f"please call +1 (555) 000-00{10 + i} thanks about it") for i in range(20)]
    rows += [(100 + i, f"nothing to see, thanks for asking please {i}") for i in range(900)] + [(2000, "we met zebulon again")]
    assert terms_of(table, rows) == {"zebulon"}
    got = {r["doc_id"]: r["spans"] for r in pii.digests(table(rows)).collect()}
    assert "term:11:18" in got[0] and got[2000] == "term:7:14" and "term" not in got[50] and got[100] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table(rows)).collect()}
    assert clean[0] == "Please ask [TERM] about it [PHONE] x0 thanks" and clean[2000] == "we met [TERM] again"


def words(text):
    return set(regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower()))


def terms_of(table, rows):
    """The words whose hashes the operator tells."""
    df = table(rows)
    told = {r["term"] for r in pii.disclosing_terms(*_parts(df)).collect()}
    every = sorted({w for _, t in rows for w in words(t or "")})
    hashes = df.sparkSession.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w"))
    found = {w for w, h in hashes.collect() if h in told}
    assert len(found) == len(told)
    return found


def plain_terms(rows):
    """Co-occurrence by documents, counted plainly."""
    docs = []
    for _, t in rows:
        values, rest = set(), t or ""
        for k, r, ok in KINDS:
            for m in re.finditer(r, t or ""):
                if ok(m[0]):
                    values.add((k, m[0]))
                    rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
        docs.append((words(t or ""), values, rest))
    out = set()
    for value in {v for _, values, _ in docs for v in values}:
        holding = [(w, t) for w, values, t in docs if value in values]
        share = len(holding) / len(docs)
        for w in set().union(*(words(t) for _, t in holding)):
            def named(t):
                return any(len(x) > 3 or not x[0].islower() or any(c.isnumeric() for c in x) for x in regex.findall(r"[\p{L}\p{M}\p{N}]+", t) if x.lower() == w)

            n, of = sum(w in words(t) and named(t) for _, t in holding), sum(w in x for x, _, _ in docs)
            d = min(1.0, n / of)
            proof = of * (d * math.log(d / share) + ((1 - d) * math.log((1 - d) / (1 - share)) if d < 1 else 0)) if d > share else 0
            if n >= pii.SUPPORT and d >= pii.DISCLOSURE and proof >= -math.log(pii.LUCK):
                out.add(w)
    return out


def test_equals_plain_counts(table):
    rng = random.Random(4)
    people = [(f"Name{k}", f"u{k}@x{k}.org", f"+1 555 000 {1000 + k}") for k in range(6)]
    filler = [f"word{k}" for k in range(40)] + ["the", "Of", "an"]
    rows = []
    for i in range(150):
        parts = rng.choices(filler, k=rng.randrange(5, 60))
        for name, mail, phone in rng.sample(people, rng.choice([0, 0, 1, 2])):
            parts.insert(0, name)
            if rng.random() < 0.8:
                parts += [mail] + [phone] * (rng.random() < 0.5)  # far from the name
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, "copies of one text, Quill q@q.org") for i in range(5)] + [(300, None), (301, "")]
    got = terms_of(table, rows)
    assert got == plain_terms(rows) and {"name0", "name3", "quill"} <= got


def test_recall_of_planted_names_over_kinds(table):
    """Each name stands once, hundreds of words from its protected value of some kind, in four documents; clean documents stay as they are."""
    rng = random.Random(6)
    filler = [f"w{k}" for k in range(300)]
    values = {"email": "p{0}@mail.org", "ip": "10.0.{0}.7", "card": "4111 1111 1111 1111", "phone": "+1 555 010 20{0:02d}"}
    rows, planted = [], {}
    for k, (kind, value) in enumerate(values.items()):
        for j in range(1 if kind == "card" else 5):
            name = f"{kind.title()}person{j}"
            for _ in range(4):
                body = rng.choices(filler, k=300)
                planted.setdefault(kind, []).append((len(rows), name))
                rows.append((len(rows), " ".join([name, *body, "at", value.format(10 * k + j)])))
    clean = range(len(rows), len(rows) + 400)
    rows += [(i, " ".join(rng.choices(filler, k=40))) for i in clean]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(table(rows)).collect()}
    for kind, cases in planted.items():
        recall = sum(f"term:0:{len(name)}" in got[i] for i, name in cases) / len(cases)
        assert recall == 1, (kind, recall)
    assert all(got[i] == "" for i in clean)


def test_nothing_protected_is_stored(spark, table):
    import glob

    from evenspan.llm.common import shared_dir

    at = shared_dir(spark).removeprefix("file:") + "/evenspan/*"
    there = set(glob.glob(at))
    pii.digests(table([(i, f"Zebulon z{i} z@y.org") for i in range(9)] + [(50 + i, f"none {i}") for i in range(30)])).collect()
    for new in set(glob.glob(at)) - there:
        for row in spark.read.parquet(new).collect():
            assert "ebulon" not in str(row) and "z@y" not in str(row), new


def _parts(df):
    """The inputs of the counting, as ``find`` makes them."""
    kept = {}
    whole = pii.disclosing_terms

    def caught(docs, found):
        kept["x"] = docs, found
        return whole(docs, found)

    pii.disclosing_terms = caught
    try:
        pii.find(df)
    finally:
        pii.disclosing_terms = whole
    return kept["x"]


def test_no_python(table):
    plan = pii.digests(table([(1, "a@b.c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_names_identifiers_hot_values_and_small_tables(table):
    rows = [(i, f"Ask Ann or 李明 (id k7x42) at team@example.org, note {i}") for i in range(12)]
    rows += [(50 + i, f"or write to team@example.org about note {i}") for i in range(13)]
    rows += [(100 + i, f"write about note {i}, ask or id of no use") for i in range(35)]  # the value is in 25 of 61 rows
    assert terms_of(table, rows + [(900, "we met ann")]) == {"ann", "李明", "k7x42"}
    few = [(i, "Kim +1 (555) 123-4567") for i in range(5)] + [(9 + i, f"nothing of note {i}") for i in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.digests(table(few + [(800, "so kim left, kimono")])).collect()}
    assert got[0] == "phone:4:21,term:0:3" and got[800] == "term:3:6" and got[9] == ""


def test_each_row_is_sanitised_by_its_own_text(table):
    rows = [(1, "mail u@v.org end"), (1, "a much longer text x@y.org end"), (None, "call +1 (555) 123-4567 x"), (None, None), (None, "plain"), (2, "plain"), (1, "mail u@v.org end")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in pii.sanitised(table(rows)).collect())
    want = [(1, "mail [EMAIL] end"), (1, "a much longer text [EMAIL] end"), (None, "call [PHONE] x"), (None, ""), (None, "plain"), (2, "plain"), (1, "mail [EMAIL] end")]
    assert got == sorted((str(i), t) for i, t in want)
    assert pii.sanitised(table([])).collect() == []

import itertools
import re

from pyspark.sql import functions as F

from evenspan.llm import filter_audit

from .conftest import EDGES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def mask(text):
    words = WORDS.findall(text)
    tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text) is not None]
    return [i for i, t in zip("ABCD", tests) if t]


def plain(rows, labels):
    """rows: (id, text, part).  Runs every order over the rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marked = [(p or "", mask(t or "") + ["E"] * (i is not None and i > least[t or ""]), any(q == 1 for d, q, _ in labels if d == i is not None), any(x == 1 for d, _, x in labels if d == i is not None)) for i, t, p in rows]
    out, removed_of = {}, {}
    for part in {m[0] for m in marked}:
        for order in itertools.permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            everyone = left
            for k, f in enumerate(order):
                cut = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, "".join(order), k + 1] = [len(left), len(cut), sum(f in m[1] for m in everyone) - len(cut), sum(m[1] == [f] for m in everyone), sum(m[2] for m in cut), sum(m[3] for m in cut)]
                removed_of[part, f] = removed_of.get((part, f), 0) + len(cut)
    return {k: [*v, removed_of[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, source string, n int, mask string").withColumn("part", F.lit(3))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = filter_audit.interactions(docs, marks).collect()
    assert len(found) == len({(r["part"], r["filter_order"], r["step"]) for r in found})
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found}


def test_equals_every_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long + " $", " ".join(["same"] * 70), "SHOUT " * 40 + long, "x|y", "A" * 30, long.upper(), None, "", " \x0b\n", *(t for _, t in EDGES)]
    rows = [(i % 37 if i % 11 else None, texts[i * i % len(texts)], [None, "", "s1", "s2", "Ö"][i % 5]) for i in range(300)]
    rows += [(1000 + i, long, "s1") for i in range(150)]  # a third are copies of one text
    labels = [(i, i % 3 % 2, i % 2) for i in range(30)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (5000, 1, 1), *((1000 + i, 1, None) for i in range(9))]
    assert got(spark, rows, labels) == plain(rows, labels)


def test_empty_and_all_null(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}
    rows = [(None, None, None)] * 3
    assert got(spark, rows, []) == plain(rows, [])


def test_transform_is_its_own_inverse(spark):
    rows = spark.range(500).select(F.lit("p").alias("part"), (F.col("id") * 7 % 32).cast("int").alias("mask"), (F.col("id") % 5 - 2).alias("n"))
    sums = filter_audit.parity_sums(rows, ["n"], 5)
    cells = sums.select(filter_audit.cells_of(F.col("n"), 5)).first()[0]
    want = {r[0]: r[1] for r in rows.groupBy("mask").agg(F.sum("n")).collect()}
    assert cells == [want.get(m, 0) for m in range(32)]
    assert sums.select(F.size("n")).first()[0] == 32


def test_copies_are_combined_before_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "t", "s") for i in range(9)], "doc_id long, text string, source string")
    plan = filter_audit.masked(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") and "Cartesian" not in plan and "NestedLoop" not in plan

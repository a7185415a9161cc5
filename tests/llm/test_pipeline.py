"""The pipeline against its stages done plainly."""

import zlib

import corpus_pipeline
import numpy as np
from evenspan.llm import decontaminate as dc
from evenspan.llm.decontaminate import decontaminated
from evenspan.llm import packing
from evenspan.llm.queries import tokenizer_path
from tokenizers import Tokenizer

from .conftest import LONG
from .test_decontaminate import ITEMS, distance
from .test_langid import predicted, sample
from .test_lines import line_dedup
from .test_near_dup import copies
from .test_near_dup import plain as components


def lines(rows, least=10):
    from collections import Counter

    def key(line):
        return line.strip(line_dedup.BLANKS).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))

    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    return [(i, "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < least)) for i, t in rows]


def test_pipeline(spark, tmp_path):
    texts = [(i, t, lang) for i, t, lang in sample(7, 60)]
    texts = [(i, t + "\nShared licence line", lang) if i % 3 == 0 else (i, t, lang) for i, t, lang in texts]
    texts += [(1000 + i, t, "aa") for i, t in copies(11)]
    texts += [(3000, None, "aa"), (3001, "", "aa"), (3002, "123 456", "bb"), (3003, "ka lo mi " + ITEMS[0][1] + " tu ka", "aa"), (3004, LONG[:20_000], "aa"), (3005, "ka lo\nshared LICENCE line", None)]
    docs = spark.createDataFrame([(*t, "s", len(t[1] or "")) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x for x in ITEMS if x[0] != 3], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    told = predicted([(i, t) for i, t, _ in texts], [(i, t, lang) for i, t, lang in texts])
    rows = [(i, t) for i, t, _ in texts if told[i][0] != "und"]
    assert {i for i, _ in rows}.isdisjoint({3000, 3001, 3002}) and len(rows) > 100
    rows = lines(rows)
    assert not any("licence" in t.lower() for _, t in rows)
    kept = {d for d, _, c in components(rows, 80) if d == c}
    rows = [(i, t) for i, t in rows if i in kept]
    items = [dc.normalised(x).strip() for k, x in ITEMS if k != 3]
    clean = []
    for i, t in rows:
        text = dc.normalised(t)
        hit = any(item and len(text) < 5000 and distance(item, text) <= dc.budget(len(item)) for item in items)
        if not hit:
            clean.append((i, t))
    assert 3003 not in {i for i, _ in clean}
    of, want = Tokenizer.from_file(tokenizer_path()), []
    for i, t in clean:
        ids = of.encode(t, add_special_tokens=False).ids + [2]
        want += [(i, k, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids)))]
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_stages_keep_columns(spark, table):
    docs = table([(1, "ka lo mi tu ka", "aa"), (2, "eng olt urk", "bb"), (2, "eng olt urk", "bb"), (None, "ka ka lo", "aa"), (3, None, "aa")] + sample(2, 20))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_empty(spark, table):
    docs = table([])
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").count() == 0


def test_short_clean_documents_stay(spark, table):
    rows = [(i, " ".join(["kalo"] * 40) + " zuvo" * (i == 0), "aa") for i in range(40)]
    rows += [(100 * k + i, f"{word} {word}", lang) for k, (lang, word) in enumerate({"bb": "shreng", "cc": "çalmi", "dd": "tuvo"}.items(), 1) for i in range(8)]
    rows += [(2000, "zuvo", "aa"), (2001, "Zuvo |", "aa"), (2002, "zuvo kalo", "aa"), (2003, "zuvo", None)]
    docs = table(rows + [(3000, "12 |", "aa"), (3001, None, "aa")])
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {i for i, *_ in rows}


def test_each_row_is_judged_by_itself(spark):
    """Rows with null or repeated ids, exact copies, and a column that has the name of an internal one."""
    words = "ka lo mi tu kalo lomi mitu tuka loka mika tulo"
    texts = [(1, words), (1, "12345 678"), (None, "999"), (None, "lo lo ka mi tu"), (2, "mi tu"), (2, "mi tu"), (7, words + " " + ITEMS[0][1]), (7, "tu tu mi lo ka tu"), (None, ITEMS[0][1]), (None, None), (3, words), (None, words), (None, words)]
    texts += [(100 + i, f"ka{'lo' * (i % 7)} mi{'tu' * (i // 7)} ka{i} lo{i} mi{i} tu{i}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "aa", "x", k % 2) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, _id string, _h1 int")
    bench = [x for x in ITEMS if x[0] != 3]

    def rows(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    want = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    told = corpus_pipeline.language(spark, docs, "")
    assert rows(told) == sorted(want, key=str) and told.columns == docs.columns and {r["_id"] for r in told.collect()} == {"x"}

    left = corpus_pipeline.near_duplicates(spark, told, "")
    copies_of = {(3, words), (None, words)}
    want = [x for k, x in enumerate(want) if x not in copies_of and x not in want[:k]]
    assert rows(left) == sorted(want, key=str) and left.columns == docs.columns

    clean = decontaminated(left, spark.createDataFrame(bench, "item_id long, text string"))
    assert rows(clean) == sorted((x for x in want if ITEMS[0][1] not in x[1]), key=str) and (7, "tu tu mi lo ka tu") in want


def test_near_duplicates_across_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["z"])
    docs = spark.createDataFrame([(None, " ".join(base), 1), (None, near, 2), (None, near, 2), (None, "", 3), (None, "", 3), (5, " ", 4)], "doc_id long, text string, k int")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["text"].strip() for r in got)[:3] == ["", "", ""] and len(got) == 4


def test_stage_results_are_deleted(spark, tmp_path):
    import glob

    from evenspan.llm.common import shared_dir

    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in sample(3, 30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = shared_dir(spark).removeprefix("file:") + "/evenspan/"
    there = set(glob.glob(at + "*"))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    names = {x.removeprefix(at).rpartition("-")[0] for x in set(glob.glob(at + "*")) - there}
    assert names == {"stage-decontamination", "pieces", "piece-counts"}

"""A corpus pipeline out of the operators of ``evenspan.llm``: each stage works on what its predecessor kept.

1. Language ID: documents whose language can't be told (``und``: no letters) go.  A low score is no reason to go: it is
   the best language's share, so it is low for short texts, and the lower the more languages there are.
2. Line dedup: lines found in at least ten documents go from every text; texts left without any line that isn't blank
   stay, as empty documents.
3. Near-dedup: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row stays, the one with
   the smallest id; of exact copies, ids included, one.  Texts without words are no duplicates of each other.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Best-fit packing: the documents that remain, as pieces in sequences of at most 1024 tokens.

Each row is judged by itself, whatever its id: rows with null or repeated ids are documents as others are.  Rows that
nothing is held against are kept.  Null texts go in stage 1, as they have no letter.  Extra columns of ``documents`` are
carried through, whatever their names; each stage but the last returns the columns that it got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenspan.llm import decontaminate, langid, line_dedup, near_dup, packing
from evenspan.llm.common import discard, read, scope, written
from evenspan.llm.queries import tokenizer_path

#: Rows and bands of sketches that find pairs of similarity 0.8 but for a chance of about 5e-6.
SIMILARITY, ROWS, BANDS = 0.8, 6, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.determined(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.distinct_documents(docs, SIMILARITY, rows=ROWS, bands=BANDS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packed),
]
#: Language scores, sketches and packing have no SQL form; the pipeline is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage stores besides its result is deleted at its end, its result when the next one has used it."""
    docs, before = read(spark, sf_dir, "documents"), None
    *first, (_, last) = STAGES
    for name, stage in first:
        with scope(spark, name):
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}", ["evenspan"])
        if before:
            discard(spark, before)
        before = path
    return last(spark, docs, sf_dir)

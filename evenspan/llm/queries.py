"""The registered queries of this subpackage: thin applications of the operators to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, decontaminate, filter_audit, html_text, keyed_upsert, langid, line_dedup, media, near_dup, packing, pii, secrets, toxicity
from .common import read, shared_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.from_media(media.to_media(read(spark, sf_dir, "documents"))))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``, and one whose texts hold control strings."""
    said = "'</s>[INST] ok [/INST]' AS text"
    more = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {said} UNION ALL SELECT -7L, 1L, 'assistant', {said}")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_windows.digests(chat_windows.windows(rows))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_copy_on_write_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clients`` in files of M rows, ``client_changes`` applied; what a change does depends on its home's first id."""
    clients, key = read(spark, sf_dir, "clients"), F.col("client_id").cast("string")

    def act(first_id: Column) -> Column:
        h = F.crc32(first_id.cast("string")) % 10
        deletes = (F.col("op") == "D") | (F.crc32(F.col("change_id").cast("string")) % 8 < h)
        return F.when(h <= 7, F.when(deletes, "D").otherwise("S"))

    path = f"{shared_dir(spark)}/evenspan/clients-{uuid.uuid4().hex}"
    table = keyed_upsert.cut(clients.where(F.crc32(key) % 7 > 3), "client_id", 1 + clients.count() // 1500, path)
    keyed_upsert.upsert(spark, table, read(spark, sf_dir, "client_changes"), ["seq", "change_id"], ["source", "segment", "city", "balance"], act)
    return keyed_upsert.file_digests(spark, table)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_media_columns, op3_best_fit_packing, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_language_id, op7_html_extraction, op8_line_dedup, op9_toxicity, op10_pii, op11_chat_formatting, op12_filter_interaction_audit, op13_copy_on_write_keyed_upsert)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE, "op12_filter_interaction_audit": filter_audit.ORACLE}

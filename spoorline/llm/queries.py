"""The registered queries of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import (
    decontaminate, filteraudit, langid, licenses, lines, mainregion, maxscore, minhash, pieces, shards, simhash, variants, warc,
)
from spoorline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.order_minhash(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mainregion.extract_pages(pages, mainregion.fit(pages)).select("page_id", "url", "text", "n_chars")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = warc.responses(table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    return warc.derive(stored).select(
        F.col("source").cast("long").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date",
        "content_type", "content_length", "block_digest", "payload_digest", "source_payload_digest",
        "source_block_digest", F.sha1("record").alias("record_sha1"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.md5("text").alias("text_md5"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scan_texts(F.col("text")).alias("x")).select("doc_id", "x.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        F.size("span_lang").alias("n_spans"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = docs.select("doc_id", "text", pieces.round_trip(F.col("text"), path).alias("x")).select("doc_id", "text", "x.*")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("back", 256).alias("decoded_sha256"),
        (F.col("back") == F.col("text")).alias("same"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item_of_test", "item_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantized(table(spark, sf_dir, "embeddings"))
    return maxscore.exact_topk(vectors, F.col("vec_id") % 20 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_shards": op3_token_shards,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_language": op10_language,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_topk": op12_exact_topk,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op8_line_dedup": f"""
WITH {lines.REPEATED_SQL.format(docs="documents")}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       md5(clean.text) AS text_md5
FROM documents d LEFT JOIN clean ON clean.doc_id = d.doc_id
""",
    "op11_spelling_variants": variants.VARIANTS_SQL,
    "op12_exact_topk": maxscore.TOPK_SQL,
    "op13_filter_audit": filteraudit.AUDIT_SQL,
}

"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm import (
    decontaminate, html_text, language, lexical_search, merkle, near_dedup, neighbours, packing, quality_rules, sql, substring_dedup,
    token_output, toxicity, warc,
)
from featlake.llm.common import held_out, table
from featlake.llm.tokens import tokenizer_path
from featlake.session import write_and_read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(warc.captures(table(spark, sf_dir, "pages")))
    found = warc.assemble(warc.with_payloads(warc.read_records(spark, folder)))
    metadata = F.decode("metadata.block", "UTF-8")
    field = lambda name: F.regexp_extract(metadata, rf"(?m)^{name}: (\d+)", 1).try_cast("bigint")
    return found.select(
        field("pageId").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payloadLength")).alias("payload_bytes"),
        F.substring_index("response.payload_digest", ":", -1).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:capture:(\d+):", 1).try_cast("bigint").alias("refers_to"),
    )


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the packed matrices, read them back, and digest each row."""
    rows = token_output.packed_rows(table(spark, sf_dir, "documents"), tokenizer_path())
    found = spark.read.schema(rows.schema).parquet(token_output.write_packed(rows))
    return found.select(
        "sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), F.crc32("input_ids").alias("ids_crc32"),
        "cu_seqlens", "position_resets", "doc_ids", "starts",
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under all policies; ``kept`` is the latest one's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.apply_policies(write_and_read(quality_rules.ledger(docs), "ledger"))
    base_failed = ~quality_rules.passes(quality_rules.BASE)
    return found.withColumn("base_failed", base_failed).withColumn("kept", F.col(f"kept_{quality_rules.LATEST}"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_text": op2_html_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_neighbours": op4_neighbours,
    "op5_warc": op5_warc,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_matrices": op8_token_matrices,
    "op9_near_dedup": op9_near_dedup,
    "op10_language": op10_language,
    "op11_merkle": op11_merkle,
    "op12_quality": op12_quality,
    "op13_lexical": op13_lexical,
}

#: SQL for the same rows, where SQL can express it.
ORACLES: dict[str, str] = {
    "op5_warc": sql.WARC,
    "op11_merkle": sql.MERKLE,
    "op12_quality": sql.QUALITY,
    "op13_lexical": sql.LEXICAL,
}

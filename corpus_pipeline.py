"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before; all but
the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm import decontaminate, language, near_dedup, packing, substring_dedup
from featlake.llm.common import apart, table
from featlake.llm.tokens import tokenizer_path
from featlake.session import write_and_read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose language can't be told (no text or no letter); fill a null lang with the prediction."""
    found = language.predict(docs.select(COLUMNS), language.fit(docs), COLUMNS)
    known = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near duplicates (five-word shingles, 0.8), and rows without an id.

    Rows that repeat an id and text are one document.
    """
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80).where("doc_id is not null")
    by_id = found.groupBy("doc_id").agg(F.bool_or(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    named = write_and_read(by_id.where("gone or n > 1"), "gone-or-repeated")
    some, others = apart(docs.select(COLUMNS), named.select("doc_id"), "doc_id")
    left = some.join(named.where("gone").select("doc_id"), "doc_id", "left_anti").select(COLUMNS)
    return left.dropDuplicates(["doc_id", "text"]).unionByName(others)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 20 words or more that occur earlier; drop rows of which nothing is left."""
    found = substring_dedup.deduplicated(docs.select(COLUMNS), span=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that overlap a benchmark item in 13 words with at most a fifth changed."""
    leaks = write_and_read(decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    some, others = apart(docs.select(COLUMNS), leaks, "doc_id")
    return some.join(leaks, "doc_id", "left_anti").select(COLUMNS).unionByName(others)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all token pieces into sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages: the tests compare each with a brute-force version.
ORACLE_SQL = None

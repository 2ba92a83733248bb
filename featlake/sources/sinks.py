"""Sinks: predictions, audit report, metric history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.operators.clean import audit_report
from featlake.operators.ordering import global_index

HISTORY_SCHEMA = "run string, step bigint, metric string, value double"


def write_predictions(predictions: DataFrame, path: str, format: str = "parquet") -> None:
    """(user_id, prob) rows as a distributed Parquet or JSON-lines dataset."""
    predictions.select("user_id", "prob").write.mode("overwrite").format(format).save(path)


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """Numbered text lines that together form ``{"predictions": {user_id: prob}}``.

    Every row is rendered where it is; only its number decides whether it opens,
    continues or closes the document, so nothing is gathered anywhere.
    """
    last = predictions.count() - 1
    if last < 0:
        return predictions.sparkSession.createDataFrame([(0, '{"predictions": {}}')], "line bigint, value string")
    numbered = global_index(predictions.select(F.col("user_id").cast("string").alias("user_id"), "prob"), ["user_id"], "line")
    key = F.regexp_extract(F.to_json(F.array("user_id")), r"(?s)^\[(.*)\]$", 1)
    value = F.regexp_extract(F.to_json(F.array("prob")), r"(?s)^\[(.*)\]$", 1)
    head = F.when(F.col("line") == 0, '{"predictions": {').otherwise("")
    tail = F.when(F.col("line") == last, "}}").otherwise(",")
    return numbered.select("line", F.concat(head, key, F.lit(": "), value, tail).alias("value"))


def write_predictions_document(predictions: DataFrame, path: str) -> None:
    """One JSON document as ordered text parts; joined in name order they are the file.

    User ids must be unique: deduplicate with ``last_wins`` first.
    """
    lines = prediction_lines(predictions)
    ordered = lines.repartitionByRange("line").sortWithinPartitions("line")
    ordered.select("value").write.mode("overwrite").text(path)


def write_audit_report(audit: DataFrame, path: str) -> None:
    """Text report of an audit: one line per bad column, so a single part is enough."""
    audit_report(audit).coalesce(1).write.mode("overwrite").text(path)


def append_history(spark: SparkSession, rows: list[tuple[str, int, str, float]] | DataFrame, path: str) -> None:
    """Append (run, step, metric, value) rows to the metric history."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, HISTORY_SCHEMA)
    df.write.mode("append").partitionBy("metric").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)

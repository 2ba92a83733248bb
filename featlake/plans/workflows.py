"""From a folder of sample files to training data, validation metrics and predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.catalog import Catalog
from featlake.operators import metrics, score
from featlake.operators.clean import model_input
from featlake.operators.split import shuffled_batches, split_sizes
from featlake.sources.catalog_json import read_catalog
from featlake.sources.samples import block_list, read_blocks, read_samples
from featlake.sources.sinks import write_predictions

DEFAULT_SEQ_MAX_LENS = {"seq_a": 256, "seq_b": 256, "seq_c": 512, "seq_d": 512}


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Catalog of a ``schema.json``; it has one row per column, so it may be collected."""
    return Catalog.from_rows(read_catalog(spark, path).collect())


def training_data(
    spark: SparkSession,
    path: str,
    catalog: Catalog,
    batch_size: int = 256,
    valid_ratio: float = 0.1,
    train_ratio: float = 1.0,
    valid_from: str = "tail",
    buffer_batches: int = 20,
    seed: int = 42,
    seq_max_lens: dict[str, int] | None = None,
    on_oob: str = "clip",
    time_buckets: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) model inputs, split by row groups, with a batch number per row.

    Train rows are shuffled inside windows of ``buffer_batches`` batches: ``window_id``, ``place`` and ``batch`` say
    where in the shuffled order a row stands, and ``shuffle_order`` is the hash of (seed, block, row) behind
    it, so a rerun gives the same batches. Moving rows to their window is the only exchange. Validation rows keep file order.
    Footers are read once.
    """
    if valid_from not in ("tail", "after_train"):
        raise ValueError(f"valid_from is {valid_from!r}: neither 'tail' nor 'after_train'")
    blocks = block_list(spark, path, batch_size)
    n_blocks = blocks.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    n_train, n_valid = split_sizes(n_blocks, valid_ratio, train_ratio)
    valid_start = n_blocks - n_valid if valid_from == "tail" else n_train
    lens = DEFAULT_SEQ_MAX_LENS if seq_max_lens is None else seq_max_lens
    keep = ["block_index", "row_in_block", "batch"]

    def prepared(start: int, end: int) -> DataFrame:
        rows = read_blocks(spark, path, start, end, batch_size, blocks)
        return model_input(rows, catalog, lens, True, time_buckets, on_oob, keep)

    train, valid = prepared(0, n_train), prepared(valid_start, n_blocks)
    if buffer_batches > 1:
        train = shuffled_batches(train, batch_size, buffer_batches, seed).withColumn(
            "shuffle_order", F.xxhash64(F.lit(seed), "block_index", "row_in_block")
        )
    return train, valid


def prediction_data(
    spark: SparkSession,
    path: str,
    catalog: Catalog,
    seq_max_lens: dict[str, int] | None = None,
    time_buckets: bool = True,
) -> DataFrame:
    """Model inputs of a test folder; labels are a constant 0."""
    lens = DEFAULT_SEQ_MAX_LENS if seq_max_lens is None else seq_max_lens
    return model_input(read_samples(spark, path), catalog, lens, with_label=False, time_buckets=time_buckets)


def validate(scored: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """AUC and logloss of scored validation rows."""
    return metrics.evaluate(scored, logit, label)


def predict(samples: DataFrame, model: PipelineModel, order_key: str, out: str, format: str = "parquet") -> None:
    """Score every row, keep each user's last prediction and write the result."""
    scored = score.score(samples, model, ["user_id", order_key])
    write_predictions(metrics.last_wins(scored, "user_id", "prob", order_key), out, format)

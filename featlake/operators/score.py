"""Fitting a linear baseline and scoring sample tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fit_linear(
    df: DataFrame,
    label: str,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    n_hash: int = 1 << 12,
    max_iter: int = 20,
    reg: float = 1e-4,
) -> PipelineModel:
    """Cross-entropy-trained linear model: hashed id features plus numeric ones."""
    parts, stages = [], []
    if categorical:
        stages.append(
            FeatureHasher(
                inputCols=list(categorical), outputCol="_hashed", numFeatures=n_hash, categoricalCols=list(categorical)
            )
        )
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=[*numeric, *parts], outputCol="_features"))
    stages.append(
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_probability",
            rawPredictionCol="_raw", predictionCol="_predicted", maxIter=max_iter, regParam=reg,
        )
    )
    return Pipeline(stages=stages).fit(df.withColumn("_label", F.col(label).cast("double")))


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """Logit and probability per row, next to the ``keep`` columns."""
    return model.transform(df).select(
        *keep,
        F.get(vector_to_array("_raw"), F.lit(1)).alias("logit"),
        F.get(vector_to_array("_probability"), F.lit(1)).alias("prob"),
    )


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], keep: Sequence[str]) -> DataFrame:
    """Probabilities from an outside model, applied to Arrow batches inside the tasks."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("prob", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            out["prob"] = predict(batch)
            yield out

    return df.mapInPandas(run, schema)

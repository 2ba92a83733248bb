"""The cleaning projection over a growing folder of sample files.

Cleaning keeps no state, so the batch projection runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from featlake.catalog import Catalog
from featlake.operators.clean import model_input


def stream_model_input(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    catalog: Catalog,
    seq_max_lens: dict[str, int] | None = None,
    with_label: bool = True,
) -> DataFrame:
    """Model inputs of every sample file that arrives in ``path``."""
    samples = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return model_input(samples, catalog, seq_max_lens, with_label)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process the files not seen yet, append the results and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

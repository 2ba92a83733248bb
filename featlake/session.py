"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings while an intermediate is stored or collected: shuffle files go when the query that wrote them ends, since later
#: steps read what it stored, and rows with long texts go to Python workers in batches of a few MB.
STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(app_name: str = "featlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Local-mode fallback folders by application; removed when the process ends.
_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder: on a cluster
    a folder of one machine would be lost with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="featlake-")
    return _local_folders[context.applicationId].name


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """The settings STORING for the queries that run inside, and the session's own ones after that."""
    before = {key: spark.conf.get(key, None) for key in STORING}
    try:
        for key, value in STORING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_and_read(df: DataFrame, label: str, file_format: str = "parquet") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    A lost executor then costs a re-read, and values that depend on how rows were
    placed (row numbers inside a partition) cannot change between two uses.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with storing(spark):
        df.write.format(file_format).save(path)
    return spark.read.schema(df.schema).format(file_format).load(path)

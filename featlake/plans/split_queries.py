"""Queries: blocks, splits, shards, shuffling and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.operators import split
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import query
from featlake.plans.workflows import training_data
from featlake.session import shared_folder
from featlake.sources.samples import block_list, read_blocks, row_group_blocks as group_blocks

BATCH = 256
SHARDS = 3
VALID_RATIO = 0.1
TRAIN_RATIO = 0.29

#: Sample files written from the events: rows of a file at least, files at most, rows of a row group.
FILE_ROWS, MOST_FILES, GROUP_ROWS = 4000, 1000, 300
FILE_BATCH, BUFFER = 64, 5

_BLOCKED = f"rows AS (SELECT event_id, event_id // {t.BLOCK_ROWS} AS block_id FROM events)"
_BLOCKS = f"""{_BLOCKED},
blocks AS (SELECT block_id, count(*) AS n_rows, min(event_id) AS first_key, max(event_id) AS last_key FROM rows GROUP BY block_id),
indexed AS (SELECT *, row_number() OVER (ORDER BY block_id) - 1 AS block_index FROM blocks),
sizes AS (
  SELECT n, n - n_valid AS n_all_train, n_valid, greatest(1, floor((n - n_valid) * {TRAIN_RATIO}::DOUBLE))::BIGINT AS n_train
  FROM (SELECT count(*) AS n, greatest(1, floor(count(*) * {VALID_RATIO}::DOUBLE))::BIGINT AS n_valid FROM blocks))"""


def blocked_events(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "events").select(
        "event_id", F.floor(F.col("event_id") / t.BLOCK_ROWS).alias("block_id")
    )


@query(
    "block_inventory",
    f"""WITH {_BLOCKS}
SELECT block_id, block_index, n_rows, first_key, last_key,
       coalesce(sum(n_rows) OVER w, 0)::BIGINT AS rows_before, coalesce(sum(ceil(n_rows / {BATCH}.0)) OVER w, 0)::BIGINT AS batches_before
FROM indexed WINDOW w AS (ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def block_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return split.block_inventory(blocked_events(spark, sf), "block_id", "event_id", BATCH)


def _parts(train: DataFrame, valid: DataFrame) -> DataFrame:
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@query(
    "split_tail",
    f"""WITH {_BLOCKS}
SELECT r.event_id, r.block_id, CASE WHEN i.block_index < s.n_all_train THEN 'train' ELSE 'valid' END AS part
FROM rows r JOIN indexed i ON r.block_id = i.block_id, sizes s""",
)
def split_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(*split.split_blocks(blocked_events(spark, sf), "block_id", "event_id", VALID_RATIO))


_RATIO_SQL = """WITH {blocks}
SELECT r.event_id, r.block_id, p.part
FROM rows r JOIN indexed i ON r.block_id = i.block_id, sizes s,
     (SELECT unnest(['train', 'valid']) AS part) p
WHERE (p.part = 'train' AND i.block_index < s.n_train) OR (p.part = 'valid' AND i.block_index >= {start})"""


@query("split_train_ratio", _RATIO_SQL.format(blocks=_BLOCKS, start="s.n_all_train"))
def split_train_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(*split.split_blocks(blocked_events(spark, sf), "block_id", "event_id", VALID_RATIO, TRAIN_RATIO))


@query("split_after_train", _RATIO_SQL.format(blocks=_BLOCKS, start="s.n_train"))
def split_after_train(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(
        *split.split_blocks(blocked_events(spark, sf), "block_id", "event_id", VALID_RATIO, TRAIN_RATIO, "after_train")
    )


@query(
    "shard_blocks",
    f"""WITH {_BLOCKS}
SELECT r.event_id, (i.block_index % {SHARDS})::INTEGER AS shard FROM rows r JOIN indexed i ON r.block_id = i.block_id""",
)
def shard_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return split.shard_blocks(blocked_events(spark, sf), "block_id", "event_id", SHARDS).select("event_id", "shard")


@query(
    "assign_batches",
    f"""WITH {_BLOCKED}
SELECT event_id, block_id, ((row_number() OVER (PARTITION BY block_id ORDER BY event_id) - 1) // {BATCH})::INTEGER AS batch FROM rows""",
)
def assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign_batches(blocked_events(spark, sf), "block_id", "event_id", BATCH)


@query(
    "batch_count",
    f"""WITH {_BLOCKS}
SELECT count(*) AS n_blocks, sum(n_rows)::BIGINT AS n_rows, sum(ceil(n_rows / {BATCH}.0))::BIGINT AS n_batches FROM blocks""",
)
def batch_count(spark: SparkSession, sf: str) -> DataFrame:
    return split.batch_count(blocked_events(spark, sf), "block_id", BATCH)


@query("window_shuffle")
def window_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Random by a hash that other engines lack: checked by properties in the tests."""
    return split.window_shuffle(blocked_events(spark, sf), "block_id", "event_id", 64, 20)


_FILES = f"""per AS (SELECT greatest({FILE_ROWS}, (max(event_id) // {MOST_FILES}) + 1) AS n FROM events),
filed AS (
  SELECT event_id, user_id, event_id // n AS file_number, row_number() OVER (PARTITION BY event_id // n ORDER BY event_id) - 1 AS at_row,
         (event_type = 'purchase')::INTEGER AS label
  FROM events, per),
groups AS (
  SELECT file_number, (at_row // {GROUP_ROWS})::INTEGER AS row_group, count(*) AS n_rows, min(at_row) AS first_row FROM filed GROUP BY 1, 2),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY file_number, row_group) - 1 AS block_index,
         coalesce(sum(ceil(n_rows / {FILE_BATCH}.0)) OVER (ORDER BY file_number, row_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS batches_before
  FROM groups),
placed AS (
  SELECT f.event_id, f.user_id, f.label, n.block_index, f.at_row - n.first_row AS row_in_block,
         n.batches_before + (f.at_row - n.first_row) // {FILE_BATCH} AS batch
  FROM filed f JOIN numbered n ON f.file_number = n.file_number AND f.at_row // {GROUP_ROWS} = n.row_group)"""


def sample_files(spark: SparkSession, sf: str) -> str:
    """A folder of sample files with several row groups each, written from the events in order of their ids."""
    rows = t.samples(spark, sf).select(
        "event_id", "user_id", "timestamp", "label_type", F.col("shifted").alias("user_int_feats_1")
    )
    high = t.table(spark, sf, "events").agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    per_file = max(FILE_ROWS, high // MOST_FILES + 1)
    path = f"{shared_folder(spark)}/sample-files-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_file", F.floor(F.col("event_id") / per_file).cast("int"))
    dealt = dealt.repartitionById(high // per_file + 1, "_file").sortWithinPartitions("event_id").drop("_file")
    dealt.write.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    return path


@query("row_group_blocks", f"WITH {_FILES} SELECT file_number, row_group, n_rows, first_row, block_index, batches_before FROM numbered")
def row_group_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The row groups of a sample folder as numbered blocks, from its footers."""
    found = group_blocks(block_list(spark, sample_files(spark, sf), FILE_BATCH))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    return found.select(number.alias("file_number"), "row_group", "n_rows", "first_row", "block_index", "batches_before")


@query(
    "row_group_rows",
    f"""WITH {_FILES}
SELECT event_id, block_index, row_in_block, batch FROM placed
WHERE block_index >= 1 AND block_index < (SELECT count(*) - 1 FROM numbered)""",
)
def row_group_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all blocks but the first and the last, by a range of (file, row)."""
    path = sample_files(spark, sf)
    blocks = block_list(spark, path, FILE_BATCH)
    n_blocks = blocks.agg(F.sum("n_blocks")).first()[0] or 0
    return read_blocks(spark, path, 1, n_blocks - 1, FILE_BATCH, blocks).select("event_id", "block_index", "row_in_block", "batch")


@query(
    "training_batches",
    f"""WITH {_FILES},
train AS (SELECT * FROM placed WHERE block_index < (SELECT count(*) - greatest(1, floor(count(*) * {VALID_RATIO}::DOUBLE)) FROM numbered)),
windows AS (SELECT *, batch // {BUFFER} AS window_id, count(*) OVER (PARTITION BY batch // {BUFFER}) AS n FROM train),
sums AS (
  SELECT window_id, count(*) AS n_rows, ((any_value(n) + {FILE_BATCH - 1}) // {FILE_BATCH})::BIGINT AS n_batches,
         (any_value(n) - 1)::INTEGER AS last_place, sum(user_id)::BIGINT AS user_sum, sum(block_index * 1000 + row_in_block)::BIGINT AS place_sum,
         sum(label)::BIGINT AS n_positive
  FROM windows GROUP BY window_id)
SELECT 'train' AS part, * FROM sums
UNION ALL
SELECT 'valid', batch, count(*), 1, (count(*) - 1)::INTEGER, sum(user_id)::BIGINT, sum(block_index * 1000 + row_in_block)::BIGINT, sum(label)::BIGINT
FROM placed WHERE block_index >= (SELECT count(*) - greatest(1, floor(count(*) * {VALID_RATIO}::DOUBLE)) FROM numbered) GROUP BY batch""",
)
def training_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows and validation batches of a sample folder: members, sizes and sums of what they hold.

    The order inside a window is by a hash, so places and batches count through their number.
    """
    catalog = Catalog([Feature("user_int", 1, "user_int_feats_1", 90)])
    train, valid = training_data(spark, sample_files(spark, sf), catalog, FILE_BATCH, VALID_RATIO, buffer_batches=BUFFER)
    columns = ["window_id", "batch", "place", "user_id", "label", "block_index", "row_in_block"]
    valid = valid.withColumn("window_id", F.col("batch")).withColumn("place", F.pmod("row_in_block", F.lit(FILE_BATCH)).cast("int"))
    both = train.select(F.lit("train").alias("part"), *columns).unionByName(valid.select(F.lit("valid").alias("part"), *columns))
    return both.groupBy("part", "window_id").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("batch").alias("n_batches"),
        F.max("place").alias("last_place"),
        F.sum("user_id").alias("user_sum"),
        F.sum(F.col("block_index") * 1000 + F.col("row_in_block")).alias("place_sum"),
        F.sum("label").cast("bigint").alias("n_positive"),
    )


@query(
    "row_group_shards",
    f"WITH {_FILES} SELECT event_id, (block_index % {SHARDS})::INTEGER AS shard FROM placed",
)
def row_group_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the shard that reads their block, from the folders written for the shards."""
    out = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    split.write_shards(read_blocks(spark, sample_files(spark, sf)).select("event_id", "block_index"), SHARDS, out)
    return spark.read.parquet(out).select("event_id", F.col("shard").cast("int").alias("shard"))

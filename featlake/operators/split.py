"""Splitting, sharding, shuffling and batching by ordered blocks of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators.ordering import MAX_GROUP_ROWS, numbered, running_totals
from featlake.session import write_and_read


def block_inventory(df: DataFrame, block: str, key: str, batch_size: int = 256) -> DataFrame:
    """One row per block: dense index, size, key range, rows and batches before it.

    The blocks are counted in one pass and written: numbering them takes several
    looks at this small table, and none of them should scan the rows again.
    """
    counted = df.groupBy(block).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )
    blocks = write_and_read(counted, "blocks")
    batches = F.ceil(F.col("n_rows") / batch_size)
    return running_totals(
        blocks,
        block,
        {"block_index": F.lit(1).cast("bigint"), "rows_before": F.col("n_rows"), "batches_before": batches},
    )


def split_sizes(n_blocks: int, valid_ratio: float = 0.1, train_ratio: float = 1.0) -> tuple[int, int]:
    """(train blocks, validation blocks). The last blocks validate, at least one of them.

    Only a single block with ratio 0 leaves validation empty. ``train_ratio``
    below 1 keeps the first part of the train blocks, at least one.
    """
    n_valid = 0 if n_blocks == 1 and valid_ratio == 0 else max(1, int(n_blocks * valid_ratio))
    n_train = n_blocks - n_valid
    if n_train <= 0:
        raise ValueError(f"{n_blocks} block(s) with valid_ratio={valid_ratio} leave no train block")
    if train_ratio < 1.0:
        n_train = max(1, int(n_train * train_ratio))
    return n_train, n_valid


def block_bounds(blocks: DataFrame, block: str, indexes: set[int]) -> dict:
    """Block id at each of a few dense indexes; missing ones are past the last block."""
    rows = blocks.filter(F.col("block_index").isin(list(indexes))).select("block_index", block)
    return {r[0]: r[1] for r in rows.collect()}


def block_range(df: DataFrame, block: str, start: int, end: int, bounds: dict) -> DataFrame:
    """Rows of blocks ``[start, end)``; ``bounds`` comes from :func:`block_bounds`.

    The bounds are literals in the plan, so the filter reaches the scan instead
    of joining every row with its block.
    """
    if start >= end or start not in bounds:
        return df.limit(0)
    kept = df.filter(F.col(block) >= bounds[start])
    return kept.filter(F.col(block) < bounds[end]) if end in bounds else kept


def split_blocks(
    df: DataFrame,
    block: str,
    key: str,
    valid_ratio: float = 0.1,
    train_ratio: float = 1.0,
    valid_from: str = "tail",
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) rows.

    ``valid_from='tail'`` keeps validation to the last blocks whatever the train
    ratio is; ``'after_train'`` lets it start right after the kept train blocks.
    """
    if valid_from not in ("tail", "after_train"):
        raise ValueError("valid_from must be 'tail' or 'after_train'")
    blocks = block_inventory(df, block, key)
    n_blocks = blocks.count()
    n_train, n_valid = split_sizes(n_blocks, valid_ratio, train_ratio)
    valid_start = n_blocks - n_valid if valid_from == "tail" else n_train
    bounds = block_bounds(blocks, block, {0, n_train, valid_start})
    return (
        block_range(df, block, 0, n_train, bounds),
        block_range(df, block, valid_start, n_blocks, bounds),
    )


def shard_blocks(df: DataFrame, block: str, key: str, n_shards: int) -> DataFrame:
    """Add the shard that reads each row's block: dense block index modulo shards."""
    blocks = block_inventory(df, block, key).select(
        block, F.pmod("block_index", F.lit(n_shards)).cast("int").alias("shard")
    )
    return df.join(blocks, block)


def assign_batches(
    df: DataFrame, block: str, key: str, batch_size: int = 256, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add the batch number inside the block; a batch never spans blocks."""
    placed = numbered(df, [block], [key], "_place", max_rows)
    return placed.withColumn("batch", F.floor(F.col("_place") / batch_size).cast("int")).drop("_place")


def batch_count(df: DataFrame, block: str, batch_size: int = 256) -> DataFrame:
    """Total number of batches over all blocks."""
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("n").alias("n_rows"),
        F.sum(F.ceil(F.col("n") / batch_size)).alias("n_batches"),
    )


def window_shuffle(
    df: DataFrame, block: str, key: str, batch_size: int = 256, buffer_batches: int = 20, seed: int = 42
) -> DataFrame:
    """Shuffle whole rows inside windows of ``buffer_batches`` consecutive batches.

    Adds the window, the row's place in the shuffled window and its new batch.
    The order is a hash of (seed, key): a rerun, or a recomputed task, gives the
    same order. One window holds at most ``buffer_batches * batch_size`` rows.
    With ``buffer_batches <= 1`` rows keep their order.
    """
    blocks = block_inventory(df, block, key, batch_size).select(block, "batches_before")
    batched = assign_batches(df, block, key, batch_size).join(blocks, block)
    ordinal = F.col("batches_before") + F.col("batch")
    if buffer_batches > 1:
        window_id = F.floor(ordinal / buffer_batches)
        order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    else:
        window_id, order = ordinal, [F.col(key)]
    placed = batched.withColumn("window_id", window_id.cast("bigint"))
    place = F.row_number().over(Window.partitionBy("window_id").orderBy(*order)) - 1
    return (
        placed.withColumn("place", place.cast("int"))
        .withColumn("batch", F.floor(F.col("place") / batch_size).cast("int"))
        .drop("batches_before")
    )


def shuffled_batches(
    rows: DataFrame,
    batch_size: int = 256,
    buffer_batches: int = 20,
    seed: int = 42,
    batch: str = "batch",
    place: Sequence[str] = ("block_index", "row_in_block"),
) -> DataFrame:
    """Rows that know their batch, shuffled inside windows of ``buffer_batches`` consecutive batches and cut anew.

    Adds ``window_id`` and ``place``, the row's place in the shuffled window; ``batch`` becomes the
    new batch inside the window. A row's window follows from its batch, so one exchange by window does all. The order is a
    hash of (seed, place): a rerun or a recomputed task gives the same batches. With
    ``buffer_batches <= 1`` a window is a batch and rows keep their order.
    """
    window_id = F.floor(F.col(batch) / max(1, buffer_batches)).cast("bigint")
    order = [*([F.xxhash64(F.lit(seed), *place)] if buffer_batches > 1 else []), *place]
    at = F.row_number().over(Window.partitionBy("window_id").orderBy(*order)) - 1
    placed = rows.withColumn("window_id", window_id).withColumn("place", at.cast("int"))
    return placed.withColumn(batch, F.floor(F.col("place") / batch_size).cast("int"))


def write_shards(rows: DataFrame, n_shards: int, path: str, block: str = "block_index") -> None:
    """Write rows that know their block as one folder per shard, block index modulo shards.

    Rows are dealt out by block and not by shard: a shard is written by as many tasks as hold its
    blocks, in files that hold whole blocks.
    """
    sharded = rows.withColumn("shard", F.pmod(block, F.lit(n_shards)).cast("int"))
    sharded.repartition(block).sortWithinPartitions("shard", block).write.mode("overwrite").partitionBy("shard").parquet(path)


def place_shards(df: DataFrame, shard: str, n_shards: int) -> DataFrame:
    """Put every shard into the partition of its own number, ready for one reader each."""
    return df.repartitionById(n_shards, F.col(shard))

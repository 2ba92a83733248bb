"""Ordered work on groups of any size: indexes, running totals, bounded windows.

A plain window puts each key's rows into one task. The helpers here keep every
task bounded when one key, or one value, holds a large share of all rows, and
cost nothing extra beyond a count when no key does.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.session import write_and_read

# A window group up to this many rows is sorted by one task without trouble.
MAX_GROUP_ROWS = 1_000_000
# Hot keys up to this many are sent to every task; more are joined by shuffle.
MAX_BROADCAST_KEYS = 100_000

# Bins that a column is cut into, and the size parameter of the sketch behind them: its rank error is about a
# thousandth of the rows, below the share of a bin.
N_BINS = 512
SKETCH_SIZE = 4096

CHUNK = "_chunk"
CONTEXT = "_context"

# Layout of monotonically_increasing_id: partition number above, row number below.
_ROW_BITS = 33


def global_index(df: DataFrame, order: Sequence[str], name: str = "_index") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order, without one global task.

    Rows are range partitioned and sorted; each row's place inside its partition
    is recorded and the result written once, so the numbers stay fixed. Adding
    the sizes of the earlier partitions (one row per partition, hence safe to
    broadcast) makes the numbering global. ``order`` should be unique per row.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = write_and_read(placed, "index")
    part = F.shiftright("_place", _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + row)
        .drop("_part", "_start", "_place")
    )


def matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys``; null is a key like any other in a window."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def bounded_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    overlap: int,
    max_rows: int = MAX_GROUP_ROWS,
    sizes_from: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Split keys with more than ``max_rows`` rows into consecutive chunks.

    Adds a chunk column, 0 for ordinary keys, and a context flag. The last
    ``overlap`` rows of a chunk are repeated, flagged, in the next one, so a
    window over (keys, chunk) whose frame reaches back at most ``overlap`` rows
    is exact on the unflagged rows. The second result says whether any key was
    split. ``order`` must be unique inside a key. ``sizes_from`` may name a
    cheaper table with the same keys and row counts to find the hot keys in.
    """
    if overlap >= max_rows:
        raise ValueError("overlap must be smaller than max_rows")
    whole = df.withColumn(CHUNK, F.lit(0).cast("bigint")).withColumn(CONTEXT, F.lit(False))
    sizes = (df if sizes_from is None else sizes_from).groupBy(*keys).count()
    hot = sizes.filter(F.col("count") > max_rows).select(*keys)
    if hot.isEmpty():
        return whole, False
    # Written once, so that both sides of the split agree on which keys are hot.
    hot = write_and_read(hot, "hot-keys")
    if hot.count() <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = whole.join(hot, matches(whole, hot, keys), "left_anti")
    rows = global_index(df.join(hot, matches(df, hot, keys), "left_semi"), [*keys, *order])
    chunk = F.floor(F.col("_index") / max_rows)
    own = F.struct(chunk.alias("c"), F.lit(False).alias("x"))
    repeated = F.struct((chunk + 1).alias("c"), F.lit(True).alias("x"))
    near_end = F.col("_index") % max_rows >= max_rows - overlap
    split = (
        rows.withColumn("_copy", F.explode(F.when(near_end, F.array(own, repeated)).otherwise(F.array(own))))
        .withColumn(CHUNK, F.col("_copy.c"))
        .withColumn(CONTEXT, F.col("_copy.x"))
        .drop("_copy", "_index")
    )
    return cold.unionByName(split), True


def carry_over(
    df: DataFrame, keys: Sequence[str], maxima: dict[str, str], sums: dict[str, str] | None = None
) -> DataFrame:
    """Add maxima and sums over all earlier chunks of a split key, from one row per chunk.

    ``maxima`` and ``sums`` map columns to the names of their totals; a key's
    first chunk gets nulls.
    """
    sums = sums or {}
    names = [*maxima.values(), *sums.values()]
    per_chunk = df.groupBy(*keys, CHUNK).agg(
        *[F.max(c).alias(name) for c, name in maxima.items()], *[F.sum(c).alias(name) for c, name in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: f"_carried_{k}" for k in [*keys, CHUNK]}
    carried = per_chunk.select(
        *[F.col(k).alias(r) for k, r in renamed.items()],
        *[F.max(name).over(earlier).alias(name) for name in maxima.values()],
        *[F.sum(name).over(earlier).alias(name) for name in sums.values()],
    )
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(carried[r]) for k, r in renamed.items()])
    return df.join(carried, on, "left").select(*df.columns, *names)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Add each row's position in its key, from 0; hot keys are numbered chunk by chunk."""
    rows, split = bounded_groups(df, keys, order, 0, max_rows)
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(window).cast("bigint") - 1)
    if split:
        rows = carry_over(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, {}, {"_one": "_before"})
        rows = rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return rows.select(*df.columns, name)


def value_bins(df: DataFrame, column: str, n_bins: int = N_BINS, name: str = "_bin") -> DataFrame:
    """Cut a numeric column into ranges that hold about equally many rows.

    The edges come from a sketch of fixed size that tasks merge, and are constants of the plan, so
    a recomputed task bins exactly as before. They only decide balance, never
    results: equal values always share a bin and bins ascend with the values. A value that fills
    several bins by itself has one of its own, so cutting a bin again always parts its values. Null and NaN
    come last.
    """
    numeric = F.col(column).cast("double")
    ranks = F.lit([i / n_bins for i in range(1, n_bins)])
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(numeric), numeric), F.lit(SKETCH_SIZE)).alias("s")
    row = df.agg(sketch, F.count_if(~F.isnan(numeric)).alias("n")).select(
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks)).alias("edges")
    )
    found = Counter(row.first()["edges"] or [])
    edges = sorted({*found, *(math.nextafter(v, math.inf) for v, times in found.items() if times > 1)})
    splits = [e for e in edges if not math.isinf(e)]
    if not splits:
        return df.withColumn(name, F.lit(0))
    as_double = f"{name}_value"
    binned = Bucketizer(
        splits=[-math.inf, *splits, math.inf], inputCol=as_double, outputCol=name, handleInvalid="keep"
    ).transform(df.withColumn(as_double, numeric))
    return binned.withColumn(name, F.col(name).cast("int")).drop(as_double)


def running_totals(df: DataFrame, order: str, totals: dict[str, Column]) -> DataFrame:
    """Per row, the totals over all rows that come before it in ``order``.

    ``order`` is numeric and unique. A window runs inside each value bin; the
    totals of the earlier bins are added from a table of one row per bin.
    """
    binned = value_bins(df.select("*", *[c.alias(f"_t_{n}") for n, c in totals.items()]), order)
    per_bin = binned.groupBy("_bin").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bin.select("_bin", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    inside = Window.partitionBy("_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(F.broadcast(starts), "_bin").select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.coalesce(F.sum(f"_t_{n}").over(inside), F.lit(0))).alias(n) for n in totals],
    )


def select_first(df: DataFrame, take: Callable[[int], int], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first ``take(number of rows)`` rows by ``order``, a list of (numeric column, descending).

    For a selection that grows with the data, where sort-and-limit would pull
    all of it through one task. The cut value of the first column is found from
    counts; rows strictly before it are kept as they are and only its ties go on
    to the next column. The last column should be unique. ``df`` is scanned
    several times, so anything costly should be written before.
    """
    column, descending = order[0]
    n, total, cut = _cut(df.select(column), column, descending, take)
    if cut is None:
        return df if n >= total else df.limit(0)
    value, before, ties = cut
    here = F.col(column) == F.lit(value)
    first = F.col(column) > F.lit(value) if descending else F.col(column) < F.lit(value)
    missing = n - before
    if missing == ties or len(order) == 1:
        return df.filter(first | here)
    return df.filter(first).unionByName(select_first(df.filter(here), lambda _: missing, order[1:]))


def _cut(
    rows: DataFrame,
    column: str,
    descending: bool,
    take: Callable[[int], int],
    whole: bool = True,
) -> tuple[int, int, tuple[float, int, int] | None]:
    """(n, number of rows, (value of the n-th row, rows before that value, rows equal to it)).

    Counts per bin lead to the one bin that holds the n-th row; a bin still too
    large for one task is cut into bins again, also where all of it is taken (``whole`` is False then).
    """
    binned = value_bins(rows, column)
    # At most one row per bin reaches the driver.
    sizes = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(row["n"] for row in sizes)
    n = take(total)
    if n <= 0 or (whole and n >= total):
        return n, total, None
    before = 0
    for row in sorted(sizes, key=lambda r: r["_bin"], reverse=descending):
        if before + row["n"] >= n:
            break
        before += row["n"]
    here = binned.filter(F.col("_bin") == row["_bin"]).select(column)
    inside = n - before
    if len(sizes) > 1 and row["n"] > MAX_GROUP_ROWS:
        _, _, (value, earlier, ties) = _cut(here, column, descending, lambda _: inside, False)
        return n, total, (value, before + earlier, ties)
    # One row per distinct value is left after counting: a bin that can't be cut further holds one value.
    order = F.col(column).desc() if descending else F.col(column).asc()
    upto = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = here.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    hit = counts.filter((F.col("upto") >= inside) & (F.col("upto") - F.col("n") < inside)).first()
    return n, total, (hit[column], before + hit["upto"] - hit["n"], hit["n"])


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "_rank") -> DataFrame:
    """The first ``k`` rows of every key, with their rank.

    Spark cuts each task's share of a key to ``k`` rows before the shuffle (its
    window group limit), so a hot key never arrives whole at one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)

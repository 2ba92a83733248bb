"""Elapsed-time buckets for behaviour sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featlake.functions.ids import as_column, used_length

# Upper edges of the elapsed-time buckets, in seconds, from
# 5 seconds to one year. Bucket ids are 1..63; 0 is padding.
BUCKET_EDGES = (
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
)
N_BUCKETS = len(BUCKET_EDGES) + 1


def _even_stretches() -> list[tuple[int, int, int, int]]:
    """The edges as stretches of equal steps: (start, end, step, buckets before)."""
    stretches: list[list[int]] = []
    start = 0
    for i, edge in enumerate(BUCKET_EDGES):
        step = edge - start
        if stretches and step <= stretches[-1][2] and stretches[-1][1] - stretches[-1][0] == (i - stretches[-1][3]) * stretches[-1][2]:
            stretches[-1][1] = edge
        else:
            stretches.append([start, edge, step, i])
        start = edge
    return [tuple(s) for s in stretches]


def elapsed_bucket(seconds: Column | str) -> Column:
    """Bucket of a non-negative elapsed time: the first edge it does not exceed.

    The edges form a few stretches of equal steps, so a short CASE tree finds
    the stretch and a division the bucket. One CASE branch per edge would be too
    much generated code for the JVM to compile. Times past the last edge share
    the last bucket.
    """
    seconds = as_column(seconds)
    stretches = _even_stretches()

    def inside(start: int, end: int, step: int, before: int) -> Column:
        if end - start <= step:
            return F.lit(before + 1)
        steps = F.ceil((seconds - start) / F.lit(float(step)))
        return F.greatest(steps, F.lit(1)).cast("int") + before

    def choose(low: int, high: int) -> Column:
        if low == high:
            return inside(*stretches[low])
        middle = (low + high) // 2
        return F.when(seconds <= stretches[middle][1], choose(low, middle)).otherwise(choose(middle + 1, high))

    return choose(0, len(stretches) - 1)


def event_bucket(sample_time: Column | str, event_time: Column | str) -> Column:
    """Bucket id of one event; 0 for a missing or zero time, 1 for a later-than-sample one."""
    sample_time, event_time = as_column(sample_time), as_column(event_time)
    elapsed = F.greatest(sample_time - event_time, F.lit(0).cast("bigint"))
    return F.when(F.coalesce(event_time, F.lit(0)) == 0, F.lit(0)).otherwise(elapsed_bucket(elapsed))


def event_buckets(sample_time: Column | str, event_times: Column | str, width: int) -> Column:
    """Bucket ids of a whole list of event times, cut and padded to ``width``.

    The elapsed times are computed first, so the tree reads a bound variable
    instead of repeating the subtraction at each of its levels. Only the events
    that exist are visited; the padding is appended as one repeated value.
    """
    sample_time, event_times = as_column(sample_time), as_column(event_times)

    def elapsed(t: Column) -> Column:
        gap = F.greatest(sample_time - t, F.lit(0).cast("bigint"))
        return F.when(t != 0, gap).otherwise(F.lit(-1).cast("bigint"))

    cut = F.slice(F.coalesce(event_times, F.array().cast("array<bigint>")), 1, width)
    buckets = F.transform(
        F.transform(cut, elapsed), lambda g: F.when(g < 0, F.lit(0)).otherwise(elapsed_bucket(g))
    )
    return F.concat(buckets, F.array_repeat(F.lit(0), F.lit(width) - used_length(event_times, width)))


def shifted_bucket(bucket: Column, shift: Column) -> Column:
    """Move a real bucket id by ``shift`` inside 1..63; padding stays padding."""
    top = F.lit(len(BUCKET_EDGES))
    moved = F.least(F.greatest(bucket + shift, F.lit(1)), top)
    return F.when(bucket > 0, moved).otherwise(F.lit(0)).cast("int")

"""Profiling a wide sample table and inferring its feature catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.catalog import COLUMN_PREFIX

# Fixed value: vocabulary assumed for a column that holds no positive id.
VOCAB_WITHOUT_IDS = 100000

# Range of epoch seconds (2001-09-09 up to 2065-01-24) in which the largest
# value of a list column marks it as a time column.
EPOCH_SECONDS_RANGE = (1_000_000_000, 3_000_000_000)

_SEQ_COLUMN = re.compile(r"^(domain_([a-z]+)_seq)_(\d+)$")


def is_list_column(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def vocab_expr(df: DataFrame, name: str) -> Column:
    """Aggregate: largest positive id plus one, or the default when there is none."""
    value = F.array_max(name) if is_list_column(df, name) else F.col(name)
    return F.coalesce(F.max(F.when(value > 0, value)) + 1, F.lit(VOCAB_WITHOUT_IDS)).cast("bigint")


def dim_expr(df: DataFrame, name: str) -> Column:
    """Aggregate: length of the longest list, at least 1; 1 for a scalar column."""
    if not is_list_column(df, name):
        return F.lit(1)
    return F.greatest(F.coalesce(F.max(F.array_size(name)), F.lit(0)), F.lit(1))


def feature_columns(df: DataFrame) -> list[tuple[str, str, int, str]]:
    """(group, domain, fid, column) of every feature column, in layout order.

    Scalars come before lists inside an id group; ids ascend within each part.
    """
    found = []
    for order, (grp, prefix) in enumerate(COLUMN_PREFIX.items()):
        pattern = re.compile(rf"^{prefix}_(\d+)$")
        for name in df.columns:
            match = pattern.match(name)
            if match:
                listed = grp != "user_dense" and is_list_column(df, name)
                found.append(((order, "", listed, int(match[1])), (grp, "", int(match[1]), name)))
    for name in df.columns:
        match = _SEQ_COLUMN.match(name)
        if match:
            domain = f"seq_{match[2]}"
            found.append(((len(COLUMN_PREFIX), domain, True, int(match[3])), ("seq", domain, int(match[3]), name)))
    return [item for _, item in sorted(found)]


def infer_catalog(df: DataFrame, time_fids: dict[str, int] | None = None) -> DataFrame:
    """Profile every feature column in one pass and return the long catalog.

    One global aggregate holds all columns' expressions: each task reduces its
    rows to a single buffer, so the only thing shuffled is one row per task. The
    resulting single row is unpivoted into one row per feature. A table without feature columns has an empty catalog.
    """
    time_fids = time_fids or {}
    columns = feature_columns(df)
    if not columns:
        kind = "grp string, domain string, fid bigint, column string, vocab bigint, dim int, offset int, slot int, is_ts boolean"
        return df.sparkSession.createDataFrame([], kind)
    aggregates, entries = [], []
    offset: dict[str, Column] = {}
    slots: dict[tuple[str, str], int] = {}
    for i, (grp, domain, fid, name) in enumerate(columns):
        vocab, dim = F.lit(-1).cast("bigint"), F.lit(1)
        if grp != "user_dense":
            aggregates.append(vocab_expr(df, name).alias(f"v{i}"))
            vocab = F.col(f"v{i}")
        if grp != "seq":
            aggregates.append(dim_expr(df, name).alias(f"d{i}"))
            dim = F.col(f"d{i}")
        is_ts = grp == "seq" and time_fids.get(domain) == fid
        slot = -1 if is_ts else slots.get((grp, domain), 0)
        if not is_ts:
            slots[grp, domain] = slot + 1
        at = F.lit(-1)
        if grp != "seq":
            at = offset.get(grp, F.lit(0))
            offset[grp] = at + dim
        entries.append(
            F.struct(
                F.lit(grp).alias("grp"),
                F.lit(domain).alias("domain"),
                F.lit(fid).cast("bigint").alias("fid"),
                F.lit(name).alias("column"),
                vocab.alias("vocab"),
                dim.cast("int").alias("dim"),
                at.cast("int").alias("offset"),
                F.lit(slot).alias("slot"),
                F.lit(is_ts).alias("is_ts"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def detect_time_columns(df: DataFrame) -> DataFrame:
    """Sequence columns whose largest value looks like epoch seconds."""
    low, high = EPOCH_SECONDS_RANGE
    columns = [c for c in feature_columns(df) if c[0] == "seq"]
    if not columns:
        return df.sparkSession.createDataFrame([], "domain string, fid bigint, max_value bigint")
    row = df.agg(*[F.max(F.array_max(name)).alias(name) for *_, name in columns])
    entries = [
        F.struct(
            F.lit(domain).alias("domain"),
            F.lit(fid).cast("bigint").alias("fid"),
            F.col(name).cast("bigint").alias("max_value"),
        )
        for _, domain, fid, name in columns
    ]
    return row.select(F.inline(F.array(*entries))).filter(F.col("max_value").between(low, high))


def aligned_pair_audit(df: DataFrame) -> DataFrame:
    """For each id list and dense list that share a fid: rows where their lengths differ."""
    names = set(df.columns)
    lists = [
        (fid, name, f"{COLUMN_PREFIX['user_dense']}_{fid}")
        for grp, _, fid, name in feature_columns(df)
        if grp == "user_int" and is_list_column(df, name)
    ]
    pairs = [(fid, a, b) for fid, a, b in lists if b in names]
    aggregates, entries = [F.count(F.lit(1)).alias("n_rows")], []
    for fid, ints, floats in pairs:
        same = F.array_size(ints).eqNullSafe(F.array_size(floats))
        aggregates.append(F.count_if(~same).alias(f"m{fid}"))
        entries.append(
            F.struct(
                F.lit(fid).cast("bigint").alias("fid"),
                F.col("n_rows").alias("n_rows"),
                F.col(f"m{fid}").alias("n_mismatched"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))

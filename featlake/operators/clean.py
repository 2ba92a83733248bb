"""Cleaning, flattening and assembling model inputs; vocabulary audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.functions.ids import (
    conversion_label,
    in_vocab_or_zero,
    pad_dense,
    pad_ids,
    segment,
)
from featlake.operators.profile import is_list_column
from featlake.operators.sequence import domain_length, domain_stack, domain_time_buckets
from featlake.session import write_and_read

AUDIT_TYPE = "grp string, column string, vocab bigint, oob_count bigint, min_oob bigint, max_oob bigint, direction string"


def cleaned(df: DataFrame, f: Feature) -> Column:
    """One id feature as a list of exactly ``dim`` valid ids."""
    if is_list_column(df, f.column):
        return pad_ids(f.column, f.dim, f.vocab)
    return F.array(in_vocab_or_zero(f.column, f.vocab))


def flatten_group(df: DataFrame, catalog: Catalog, grp: str) -> Column:
    """All features of a group as one vector, each at its catalog offset."""
    features = catalog.group(grp)
    if grp == "user_dense":
        parts = [pad_dense(f.column, f.dim) for f in features]
        kind = "array<float>"
    else:
        parts = [cleaned(df, f) for f in features]
        kind = "array<bigint>"
    return F.concat(*parts) if parts else F.array().cast(kind)


def feature_segment(catalog: Catalog, grp: str, fid: int, vector: Column | str) -> Column:
    """The slice of a flattened vector that holds feature ``fid``."""
    f = catalog.find(grp, fid)
    return segment(vector, f.offset, f.dim)


def model_input(
    df: DataFrame,
    catalog: Catalog,
    seq_max_lens: dict[str, int] | None = None,
    with_label: bool = True,
    time_buckets: bool = True,
    on_oob: str = "clip",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The model-ready table: one select over the sample table, no shuffle.

    ``keep`` names further sample columns to pass through. With
    ``on_oob='error'`` the rows are written by ``audited_input`` now, and every bad column is reported at once.
    """
    if on_oob == "error":
        built, audit = audited_input(df, catalog, seq_max_lens, with_label, time_buckets, keep)
        require_clean(audit)
        return built
    if on_oob != "clip":
        raise ValueError("on_oob must be 'clip' or 'error'")
    columns = [
        *[F.col(c) for c in keep],
        F.col("user_id"),
        F.col("timestamp"),
        conversion_label("label_type", with_label).alias("label")
        if with_label
        else conversion_label(F.lit(None).cast("int"), False).alias("label"),
        flatten_group(df, catalog, "user_int").alias("user_int_feats"),
        flatten_group(df, catalog, "user_dense").alias("user_dense_feats"),
        flatten_group(df, catalog, "item_int").alias("item_int_feats"),
        F.array().cast("array<float>").alias("item_dense_feats"),
    ]
    for domain in catalog.domains:
        width = catalog.max_len(domain, seq_max_lens)
        columns += [
            domain_stack(catalog, domain, width).alias(domain),
            domain_length(catalog, domain, width).alias(f"{domain}_len"),
        ]
        if time_buckets:
            columns.append(domain_time_buckets(catalog, domain, "timestamp", width).alias(f"{domain}_time_bucket"))
    return df.select(*columns)


def audited_input(
    df: DataFrame,
    catalog: Catalog,
    seq_max_lens: dict[str, int] | None = None,
    with_label: bool = True,
    time_buckets: bool = True,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The model inputs, written to the shared folder, and the rows of ``oob_audit`` from the same scan.

    The audit's aggregates are observed while the rows pass on their way to the write, in the tasks that
    write them, so the samples are read once. An empty table has an empty audit. The lists hold over a thousand
    values a row: as ORC they are written in less than half the time of Parquet.
    """
    audited, aggregates = _audit_parts(df, catalog, seq_max_lens)
    observation = Observation("audit")
    seen = df.observe(observation, F.count(F.lit(1)).alias("n_rows"), *aggregates)
    built = write_and_read(model_input(seen, catalog, seq_max_lens, with_label, time_buckets, keep=keep), "model-input", "orc")
    found = observation.get
    rows = [
        (_side(f), f.column, f.vocab, found[f"n{i}"], found[f"l{i}"], found[f"h{i}"], "TOO_HIGH")
        for i, f in enumerate(audited)
        if found.get(f"n{i}")
    ]
    return built, df.sparkSession.createDataFrame(rows, AUDIT_TYPE)


def _side(f: Feature) -> str:
    return f.domain if f.grp == "seq" else f.grp


def _audit_parts(df: DataFrame, catalog: Catalog, seq_max_lens: dict[str, int] | None) -> tuple[list[Feature], list[Column]]:
    """The audited features, and for each the aggregates n, h and l: count, largest and smallest bad id."""
    audited = [f for f in catalog.features if f.vocab > 0 and not f.is_ts]
    aggregates = []
    for i, f in enumerate(audited):
        limit = catalog.max_len(f.domain, seq_max_lens) if f.grp == "seq" else f.dim
        n, high, low = _row_oob(df, f, limit)
        aggregates += [F.sum(n).alias(f"n{i}"), F.max(high).alias(f"h{i}"), F.min(low).alias(f"l{i}")]
    return audited, aggregates


def oob_audit(df: DataFrame, catalog: Catalog, seq_max_lens: dict[str, int] | None = None) -> DataFrame:
    """Per audited column: how many ids are at or above its vocabulary, and their range.

    Only the positions that survive the cut are looked at, and columns without
    a vocabulary are left out. Each row is first reduced to (count, max, min) per
    column; one global aggregate then shuffles a single row per task, however
    many ids the lists hold.
    """
    audited, aggregates = _audit_parts(df, catalog, seq_max_lens)
    entries = []
    for i, f in enumerate(audited):
        entries.append(
            F.struct(
                F.lit(_side(f)).alias("grp"),
                F.lit(f.column).alias("column"),
                F.lit(f.vocab).cast("bigint").alias("vocab"),
                F.col(f"n{i}").cast("bigint").alias("oob_count"),
                F.col(f"l{i}").alias("min_oob"),
                F.col(f"h{i}").alias("max_oob"),
            )
        )
    if not entries:
        return df.sparkSession.createDataFrame([], AUDIT_TYPE)
    # Only ids at or above the vocabulary are ever out of range, so the
    # direction has a single reachable value.
    return (
        df.agg(*aggregates)
        .select(F.inline(F.array(*entries)))
        .filter(F.col("oob_count") > 0)
        .withColumn("direction", F.when(F.col("min_oob") >= F.col("vocab"), "TOO_HIGH").otherwise("TOO_LOW"))
    )


def _row_oob(df: DataFrame, f: Feature, limit: int) -> tuple[Column, Column, Column]:
    if not is_list_column(df, f.column):
        c = F.col(f.column)
        bad = c >= f.vocab
        value = F.when(bad, c)
        return F.when(bad, 1).otherwise(0), value, value
    # slice() of a null list is null, and so are the sizes and extremes below;
    # the aggregates skip nulls. array_max is compared first so that a row
    # without a bad id, the usual case, never filters its list.
    cut = F.slice(f.column, 1, limit)
    any_bad = F.array_max(cut) >= f.vocab
    bad = F.filter(cut, lambda x: x >= f.vocab)
    return (
        F.when(any_bad, F.array_size(bad)).otherwise(0),
        F.when(any_bad, F.array_max(cut)),
        F.when(any_bad, F.array_min(bad)),
    )


def require_in_vocab(df: DataFrame, catalog: Catalog, seq_max_lens: dict[str, int] | None = None) -> None:
    """Raise ``ValueError`` naming every column with ids outside its vocabulary."""
    require_clean(oob_audit(df, catalog, seq_max_lens))


def require_clean(audit: DataFrame) -> None:
    """Raise ``ValueError`` naming every column of an audit; it has one row per bad column."""
    bad = audit.orderBy("grp", "column").collect()
    if bad:
        lines = [
            f"{r['column']} ({r['grp']}) has {r['oob_count']} ids between {r['min_oob']} and {r['max_oob']}, "
            f"but its vocabulary ends at {r['vocab'] - 1}"
            for r in bad
        ]
        raise ValueError("\n".join(lines))


def audit_report(audit: DataFrame) -> DataFrame:
    """Report lines, ordered by group and column."""
    line = F.format_string(
        "%s (%s): %d ids from %d to %d are %s for a vocabulary of %d",
        "column", "grp", "oob_count", "min_oob", "max_oob", "direction", "vocab",
    )
    return audit.orderBy("grp", "column").select(line.alias("value"))

"""Sample, sequence, score and embedding tables derived from the given tables.

Every function has a counterpart of the same name in ``sql_tables``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.operators.sequence import build_history, latest_events

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATUSES = ("F", "O", "P")
HISTORY = 256
ORDER_HISTORY = 256
BLOCK_ROWS = 500
#: Slots of a padded multi-hot feature; lists are cut to it by the padding itself.
MULTIHOT_DIM = 4

SEQ_MAX_LENS = {"seq_a": 256, "seq_b": 256}

# A catalog whose vocabularies are partly too small, so that clipping and the
# audit have work to do; feature 62 has no vocabulary at all.
CATALOG = Catalog(
    [
        Feature("user_int", 1, "user_int_feats_1", 90),
        Feature("user_int", 3, "user_int_feats_3", 25),
        Feature("user_int", 4, "user_int_feats_4", 6),
        Feature("user_int", 15, "user_int_feats_15", 45, 3),
        Feature("user_int", 62, "user_int_feats_62", 0, 2),
        Feature("item_int", 5, "item_int_feats_5", 5),
        Feature("item_int", 11, "item_int_feats_11", 95, 2),
        Feature("user_dense", 61, "user_dense_feats_61", -1, 4),
        Feature("user_dense", 62, "user_dense_feats_62", -1, 2),
        Feature("seq", 38, "domain_a_seq_38", 6, domain="seq_a"),
        Feature("seq", 39, "domain_a_seq_39", 3_000_000_000, domain="seq_a", is_ts=True),
        Feature("seq", 40, "domain_a_seq_40", 80, domain="seq_a"),
        Feature("seq", 67, "domain_b_seq_67", 3_000_000_000, domain="seq_b", is_ts=True),
        Feature("seq", 68, "domain_b_seq_68", 6, domain="seq_b"),
        Feature("seq", 69, "domain_b_seq_69", 3, domain="seq_b"),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(name: str) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session's time zone is."""
    day = F.unix_date(F.to_date(name)).cast("bigint") * 86400
    return day + F.hour(name) * 3600 + F.minute(name) * 60 + F.second(name)


def code_of(column: str, values: tuple[str, ...]) -> Column:
    """Position of a text value in a short list, from 1; null when it is not there."""
    code = F.when(F.col(column) == values[0], 1)
    for i, value in enumerate(values[1:], start=2):
        code = code.when(F.col(column) == value, i)
    return code.cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        epoch_seconds("ts").alias("timestamp"),
        code_of("event_type", EVENT_TYPES).alias("type_code"),
        F.when(kind == "purchase", 2).when(kind == "click", 1).when(kind != "error", 0).alias("label_type"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("user_id"),
        epoch_seconds("o_orderdate").alias("timestamp"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
        code_of("o_orderstatus", STATUSES).alias("status"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the scalar features of its user."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_nationkey").cast("bigint").alias("nation"),
        code_of("c_mktsegment", SEGMENTS).alias("segment"),
    )
    return (
        events(spark, sf_dir)
        .join(customers, "user_id", "left")
        .select(
            "event_id", "user_id", "timestamp", "label_type", "type_code", "k", "value", "nation", "segment",
            (F.col("k") - 1).alias("shifted"),
            F.floor(F.col("event_id") / BLOCK_ROWS).alias("block_id"),
        )
    )


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with up to 256 earlier events of its user: sequence domain a."""
    base = events(spark, sf_dir).select("event_id", "user_id", "timestamp", "type_code", "k")
    return build_history(
        base,
        ["user_id"],
        ["timestamp", "event_id"],
        {"types": F.col("type_code"), "times": F.col("timestamp"), "ks": F.col("k")},
        HISTORY,
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with up to 256 earlier orders of its customer: long gaps, tied dates."""
    return build_history(
        orders(spark, sf_dir),
        ["user_id"],
        ["timestamp", "o_orderkey"],
        {"statuses": F.col("status"), "times": F.col("timestamp"), "priorities": F.col("priority")},
        HISTORY,
    )


def wide_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample table in the flat column layout, with two sequence domains.

    The long history lists are built last, on top of the joined rows, so no join
    ever moves them.
    """
    k = F.col("k")

    def short(size: Column, kind: str, *values: Column) -> Column:
        return F.slice(F.array(*[v.cast(kind) for v in values]), F.lit(1), size.cast("int"))

    latest = latest_events(
        orders(spark, sf_dir),
        ["user_id"],
        ["timestamp", "o_orderkey"],
        {
            "domain_b_seq_67": F.col("timestamp"),
            "domain_b_seq_68": F.col("priority"),
            "domain_b_seq_69": F.col("status"),
        },
        ORDER_HISTORY,
    )
    value = F.col("value")
    base = samples(spark, sf_dir).select(
        "event_id",
        "user_id",
        k.alias("item_id"),
        "label_type",
        (F.col("timestamp") + k).alias("label_time"),
        "timestamp",
        F.col("shifted").alias("user_int_feats_1"),
        F.col("nation").alias("user_int_feats_3"),
        F.col("segment").alias("user_int_feats_4"),
        short(k % 5, "bigint", k % 10, k % 7 - 1, k - 50, k).alias("user_int_feats_15"),
        short(k % 4, "bigint", k, 99 - k, k % 3).alias("user_int_feats_62"),
        short(F.col("event_id") % 4, "float", value, value / 2, -value).alias("user_dense_feats_61"),
        short(
            k % 4 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0), "float", k / 2, k / 4, F.lit(1.5), F.lit(2.5)
        ).alias("user_dense_feats_62"),
        F.col("type_code").alias("item_int_feats_5"),
        short(k % 3 + 1, "bigint", k, k + 1, k + 2).alias("item_int_feats_11"),
    )
    return build_history(
        base.join(latest, "user_id", "left"),
        ["user_id"],
        ["timestamp", "event_id"],
        {
            "domain_a_seq_38": F.col("item_int_feats_5"),
            "domain_a_seq_39": F.col("timestamp"),
            "domain_a_seq_40": F.col("item_id"),
        },
        HISTORY,
        sizes_from=table(spark, sf_dir, "events"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logit and a label per event; some logits are NaN, as diverged models give."""
    logit = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise((F.col("value") - 30) / 50)
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "event_type",
        logit.alias("logit"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations in order, one run per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        F.col("value").alias("score"),
        F.col("event_type").alias("note"),
    )


def multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the part keys of all its lines."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return listed.select("l_orderkey", F.col("l.l_partkey").alias("parts"))


def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features' embedding tables: even vectors for feature 1, odd ones for feature 2."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 2 + 1).alias("fid"),
        (F.floor(F.col("vec_id") / 2) + 1).alias("id"),
        F.col("embedding").alias("vec"),
    )


EMBEDDING_WIDTH = 64


def joined_text(column: Column) -> Column:
    """An id list as comma-separated text, for comparing lists across engines."""
    return F.array_join(column.cast("array<string>"), ",")


def padded_text(column: Column, used: Column, width: int) -> Column:
    """``joined_text`` of a list of ``width`` ids without nulls that is 0 from position ``used`` on, as a rule.

    The padding is most of a list and is appended as one text; a list with an id behind ``used`` is printed in full.
    """
    behind = F.slice(column, used + 1, F.lit(width))
    zeros = F.coalesce((F.array_max(behind) == 0) & (F.array_min(behind) == 0), F.lit(False))
    padded = zeros & (used > 0) & (F.array_size(column) == width)
    return F.when(padded, F.concat(joined_text(F.slice(column, F.lit(1), used)), F.repeat(F.lit(",0"), F.lit(width) - used))).otherwise(
        joined_text(column)
    )


def rounded(column: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)

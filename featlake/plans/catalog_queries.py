"""Queries: scans, profiling, the feature catalog and feature groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.operators import embed, profile
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import query
from featlake.sources import catalog_json
from featlake.sources.samples import row_groups

TIME_FIDS = {"seq_a": 39, "seq_b": 67}
GROUPS_DOCUMENT = (
    '{"_note": "names starting with an underscore are notes", '
    '"user_ns_groups": {"U1": [1, 15], "U2": [62, 3], "U3": [4, 999]}, '
    '"item_ns_groups": {"I1": [11, 5]}}'
)

# (group, domain, fid, column, is list), in layout order
_COLUMNS = [
    ("user_int", "", 1, "user_int_feats_1", False),
    ("user_int", "", 3, "user_int_feats_3", False),
    ("user_int", "", 4, "user_int_feats_4", False),
    ("user_int", "", 15, "user_int_feats_15", True),
    ("user_int", "", 62, "user_int_feats_62", True),
    ("item_int", "", 5, "item_int_feats_5", False),
    ("item_int", "", 11, "item_int_feats_11", True),
    ("user_dense", "", 61, "user_dense_feats_61", True),
    ("user_dense", "", 62, "user_dense_feats_62", True),
    ("seq", "seq_a", 38, "domain_a_seq_38", True),
    ("seq", "seq_a", 39, "domain_a_seq_39", True),
    ("seq", "seq_a", 40, "domain_a_seq_40", True),
    ("seq", "seq_b", 67, "domain_b_seq_67", True),
    ("seq", "seq_b", 68, "domain_b_seq_68", True),
    ("seq", "seq_b", 69, "domain_b_seq_69", True),
]


def _catalog_sql() -> str:
    """The catalog profiled column by column, then laid out with windows."""
    parts = []
    for i, (grp, domain, fid, column, listed) in enumerate(_COLUMNS):
        value = f"list_max({column})" if listed else column
        vocab = "-1" if grp == "user_dense" else f"coalesce(max(CASE WHEN {value} > 0 THEN {value} END) + 1, 100000)"
        dim = f"greatest(coalesce(max(len({column})), 0), 1)" if listed and grp != "seq" else "1"
        is_ts = TIME_FIDS.get(domain) == fid
        parts.append(
            f"SELECT {i} AS pos, '{grp}' AS grp, '{domain}' AS domain, {fid}::BIGINT AS fid, '{column}' AS \"column\", "
            f"({vocab})::BIGINT AS vocab, ({dim})::INTEGER AS dim, {1 if is_ts else 0} AS is_ts FROM wide"
        )
    return (
        f"{sql.WIDE},\nprofiled AS (" + "\n  UNION ALL ".join(parts) + "),\n"
        "cat AS (SELECT grp, domain, fid, \"column\", vocab, dim, is_ts,\n"
        "  (CASE WHEN grp = 'seq' THEN -1 ELSE coalesce(sum(dim) OVER (PARTITION BY grp ORDER BY pos\n"
        "    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END)::INTEGER AS \"offset\",\n"
        "  (CASE WHEN is_ts = 1 THEN -1 ELSE count(*) FILTER (WHERE is_ts = 0) OVER (PARTITION BY grp, domain ORDER BY pos\n"
        "    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END)::INTEGER AS slot\n"
        "  FROM profiled)"
    )


CATALOG_SQL = _catalog_sql()
_CATALOG_COLUMNS = "grp, domain, fid, \"column\", vocab, dim, \"offset\", slot, is_ts"


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return profile.infer_catalog(t.wide_samples(spark, sf), TIME_FIDS)


def _flag(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("is_ts", F.col("is_ts").cast("int"))


@query(
    "scan_samples",
    f"WITH {sql.SAMPLES} SELECT event_id, user_id, timestamp, coalesce(label_type, -1) AS label_type, nation, segment FROM samples",
)
def scan_samples(spark: SparkSession, sf: str) -> DataFrame:
    return t.samples(spark, sf).select(
        "event_id", "user_id", "timestamp", F.coalesce("label_type", F.lit(-1)).alias("label_type"), "nation", "segment"
    )


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "row_group_inventory",
    " UNION ALL ".join(f"SELECT '{n}.parquet' AS file, count(*) AS total_rows FROM {n}" for n in _TABLES),
)
def row_group_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table's file, summed over its row groups."""
    groups = row_groups(spark, sf).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    return groups.groupBy("file").agg(F.sum("n_rows").alias("total_rows"))


@query(
    "infer_vocab_scalar",
    f"""WITH {sql.SAMPLES}
SELECT coalesce(max(CASE WHEN shifted > 0 THEN shifted END) + 1, 100000) AS shifted_vocab,
       coalesce(max(CASE WHEN nation > 0 THEN nation END) + 1, 100000) AS nation_vocab,
       coalesce(max(CASE WHEN segment > 0 THEN segment END) + 1, 100000) AS segment_vocab,
       coalesce(max(CASE WHEN -k > 0 THEN -k END) + 1, 100000)::BIGINT AS negative_vocab
FROM samples""",
)
def infer_vocab_scalar(spark: SparkSession, sf: str) -> DataFrame:
    df = t.samples(spark, sf).withColumn("negative", -F.col("k"))
    names = ["shifted", "nation", "segment", "negative"]
    return df.agg(*[profile.vocab_expr(df, c).alias(f"{c}_vocab") for c in names])


@query(
    "infer_vocab_list",
    f"WITH {sql.MULTIHOT} SELECT max(list_max(parts)) + 1 AS parts_vocab FROM multihot",
)
def infer_vocab_list(spark: SparkSession, sf: str) -> DataFrame:
    df = t.multihot(spark, sf)
    return df.agg(profile.vocab_expr(df, "parts").alias("parts_vocab"))


@query(
    "infer_max_dim",
    f"""WITH {sql.EVENT_HISTORY}
SELECT greatest(coalesce(max(len(types)), 0), 1)::INTEGER AS types_dim,
       greatest(coalesce(max(len(times)), 0), 1)::INTEGER AS times_dim, 1::INTEGER AS user_dim
FROM hist_a""",
)
def infer_max_dim(spark: SparkSession, sf: str) -> DataFrame:
    df = t.event_history(spark, sf)
    return df.agg(
        profile.dim_expr(df, "types").alias("types_dim"),
        profile.dim_expr(df, "times").alias("times_dim"),
        profile.dim_expr(df, "user_id").alias("user_dim"),
    )


@query("infer_catalog", f"WITH {CATALOG_SQL} SELECT grp, domain, fid, vocab, dim FROM cat")
def infer_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("grp", "domain", "fid", "vocab", "dim")


@query("feature_catalog", f"WITH {CATALOG_SQL} SELECT {_CATALOG_COLUMNS} FROM cat")
def feature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The profiled catalog, through its JSON document and back."""
    return _flag(catalog_json.parse_catalog(catalog_json.catalog_document(_catalog(spark, sf)), "doc"))


@query(
    "feature_layout",
    f"""WITH {CATALOG_SQL} SELECT slot, fid, "offset", dim AS length FROM cat WHERE grp = 'user_int'""",
)
def feature_layout(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_json.read_layout(catalog_json.layout_document(_catalog(spark, sf), "user_int"), "doc")


@query(
    "time_columns",
    f"""WITH {sql.WIDE}
SELECT * FROM (
  SELECT 'seq_a' AS domain, 39::BIGINT AS fid, max(list_max(domain_a_seq_39)) AS max_value FROM wide
  UNION ALL SELECT 'seq_b', 67::BIGINT, max(list_max(domain_b_seq_67)) FROM wide
  UNION ALL SELECT 'seq_a', 40::BIGINT, max(list_max(domain_a_seq_40)) FROM wide)
WHERE max_value BETWEEN {profile.EPOCH_SECONDS_RANGE[0]} AND {profile.EPOCH_SECONDS_RANGE[1]}""",
)
def time_columns(spark: SparkSession, sf: str) -> DataFrame:
    # Order dates all lie before the range, so only the event times are found.
    return profile.detect_time_columns(t.wide_samples(spark, sf))


@query(
    "aligned_pair_audit",
    f"""WITH {sql.WIDE}
SELECT 62::BIGINT AS fid, count(*) AS n_rows,
       count(*) FILTER (WHERE len(user_int_feats_62) IS DISTINCT FROM len(user_dense_feats_62)) AS n_mismatched
FROM wide""",
)
def aligned_pair_audit(spark: SparkSession, sf: str) -> DataFrame:
    return profile.aligned_pair_audit(t.wide_samples(spark, sf))


@query(
    "feature_specs",
    f"""WITH {CATALOG_SQL} SELECT grp, fid, vocab, "offset", dim AS length FROM cat WHERE grp IN ('user_int', 'item_int')""",
)
def feature_specs(spark: SparkSession, sf: str) -> DataFrame:
    return embed.feature_specs(_catalog(spark, sf))


@query(
    "slot_vocab",
    f"""WITH {CATALOG_SQL}
SELECT grp, fid, "offset" + i AS position, vocab
FROM (SELECT grp, fid, "offset", vocab, unnest(range(0, dim))::INTEGER AS i FROM cat WHERE grp IN ('user_int', 'item_int'))""",
)
def slot_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return embed.per_slot_vocab(_catalog(spark, sf))


def _groups(spark: SparkSession) -> DataFrame:
    return catalog_json.parse_groups(spark.createDataFrame([(GROUPS_DOCUMENT,)], "doc string"), "doc")


_GROUPS_SQL = """grps AS (
  SELECT * FROM (VALUES ('user_int', 'U1', 0, 1), ('user_int', 'U1', 1, 15), ('user_int', 'U2', 0, 62),
    ('user_int', 'U2', 1, 3), ('user_int', 'U3', 0, 4), ('user_int', 'U3', 1, 999),
    ('item_int', 'I1', 0, 11), ('item_int', 'I1', 1, 5)) g(side, group_name, pos, fid))"""


@query(
    "group_positions",
    f"""WITH {CATALOG_SQL}, {_GROUPS_SQL}
SELECT side, group_name, pos::INTEGER AS pos, g.fid::BIGINT AS fid, slot AS position
FROM grps g JOIN cat c ON c.grp = g.side AND c.fid = g.fid""",
)
def group_positions(spark: SparkSession, sf: str) -> DataFrame:
    return embed.group_positions(_groups(spark), _catalog(spark, sf))


@query(
    "group_validation",
    f"""WITH {CATALOG_SQL}, {_GROUPS_SQL}
SELECT side, group_name, pos::INTEGER AS pos, g.fid::BIGINT AS fid
FROM grps g WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.grp = g.side AND c.fid = g.fid)""",
)
def group_validation(spark: SparkSession, sf: str) -> DataFrame:
    return embed.unknown_group_fids(_groups(spark), _catalog(spark, sf))


@query(
    "singleton_groups",
    f"""WITH {CATALOG_SQL}
SELECT grp AS side, 'F' || fid AS group_name, 0::INTEGER AS pos, fid, slot AS position
FROM cat WHERE grp IN ('user_int', 'item_int')""",
)
def singleton_groups(spark: SparkSession, sf: str) -> DataFrame:
    return embed.singleton_groups(_catalog(spark, sf))


_TRIAGE = (1000, 50, 90)
_TRIAGE_SQL = f"""triage AS (
  SELECT grp, domain, fid, vocab,
         (vocab <= 0 OR vocab > {_TRIAGE[0]})::INTEGER AS skipped,
         (vocab > {_TRIAGE[1]})::INTEGER AS id_like,
         (NOT (vocab <= 0 OR vocab > {_TRIAGE[0]}) AND vocab > {_TRIAGE[2]})::INTEGER AS reset
  FROM cat WHERE grp <> 'user_dense')"""


@query("cardinality_triage", f"WITH {CATALOG_SQL}, {_TRIAGE_SQL} SELECT * FROM triage")
def cardinality_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Time columns count as features here: the catalog as inferred marks none."""
    triage = embed.cardinality_triage(profile.infer_catalog(t.wide_samples(spark, sf)), *_TRIAGE)
    flags = [F.col(c).cast("int").alias(c) for c in ("skipped", "id_like", "reset")]
    return triage.select("grp", "domain", "fid", "vocab", *flags)


@query(
    "cardinality_counts",
    f"""WITH {CATALOG_SQL}, {_TRIAGE_SQL}
SELECT grp, domain, count(*) AS n_features, sum(skipped)::BIGINT AS n_skipped, sum(id_like)::BIGINT AS n_id_like,
       sum(reset)::BIGINT AS n_reset, count(*) FILTER (WHERE skipped = 0 AND reset = 0) AS n_kept
FROM triage GROUP BY grp, domain""",
)
def cardinality_counts(spark: SparkSession, sf: str) -> DataFrame:
    return embed.triage_counts(
        embed.cardinality_triage(profile.infer_catalog(t.wide_samples(spark, sf)), *_TRIAGE)
    )

"""Queries: cleaning, padding, flattening, labels, the vocabulary audit, model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.catalog import Catalog
from featlake.functions import ids
from featlake.operators import clean
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import query

PART_VOCAB = 1500
DENSE_CUT, DENSE_PAD = 48, 80


def _cell(column: str, vocab: int) -> str:
    if vocab <= 0:
        return "[0]"
    return f"[CASE WHEN {column} > 0 AND {column} < {vocab} THEN {column} ELSE 0 END]"


def _group_sql(grp: str) -> str:
    """A flattened id group of the fixed catalog."""
    parts = []
    for f in t.CATALOG.group(grp):
        listed = f.column in ("user_int_feats_15", "user_int_feats_62", "item_int_feats_11")
        parts.append(sql.pad(f.column, f.dim, f.vocab) if listed else _cell(f.column, f.vocab))
    return "list_concat(" + ", ".join(parts) + ")"


def _milli(column: str, width: int) -> str:
    """Padded dense values in thousandths, which both engines print alike."""
    return f"list_transform(range(0, {width}), lambda i: round(coalesce(({column})[i + 1], 0)::DOUBLE * 1000)::BIGINT)"


def _dense_sql() -> str:
    return "list_concat(" + ", ".join(_milli(f.column, f.dim) for f in t.CATALOG.group("user_dense")) + ")"


def _milli_text(vector: str):
    return t.joined_text(F.transform(vector, lambda x: F.round(x.cast("double") * 1000).cast("bigint")))


@query(
    "clean_scalar",
    f"""WITH {sql.SAMPLES}
SELECT event_id, CASE WHEN shifted > 0 THEN shifted ELSE 0 END AS shifted, CASE WHEN nation > 0 THEN nation ELSE 0 END AS nation,
       (CASE WHEN label_type > 0 THEN label_type ELSE 0 END)::BIGINT AS label_type
FROM samples""",
)
def clean_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return t.samples(spark, sf).select(
        "event_id", *[ids.positive_or_zero(c).alias(c) for c in ("shifted", "nation", "label_type")]
    )


@query(
    "clip_vocab",
    f"""WITH {sql.SAMPLES}
SELECT event_id, CASE WHEN shifted > 0 AND shifted < 90 THEN shifted ELSE 0 END AS shifted,
       CASE WHEN nation > 0 AND nation < 20 THEN nation ELSE 0 END AS nation, 0::BIGINT AS no_vocab
FROM samples""",
)
def clip_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return t.samples(spark, sf).select(
        "event_id",
        ids.in_vocab_or_zero("shifted", 90).alias("shifted"),
        ids.in_vocab_or_zero("nation", 20).alias("nation"),
        ids.in_vocab_or_zero("segment", 0).alias("no_vocab"),
    )


@query(
    "pad_multihot",
    f"""WITH {sql.MULTIHOT}
SELECT l_orderkey, {sql.text(sql.pad('parts', t.MULTIHOT_DIM, PART_VOCAB))} AS padded,
       {sql.used('parts', t.MULTIHOT_DIM)}::INTEGER AS used
FROM multihot""",
)
def pad_multihot(spark: SparkSession, sf: str) -> DataFrame:
    return t.multihot(spark, sf).select(
        "l_orderkey",
        t.joined_text(ids.pad_ids("parts", t.MULTIHOT_DIM, PART_VOCAB)).alias("padded"),
        ids.used_length("parts", t.MULTIHOT_DIM).alias("used"),
    )


@query(
    "pad_dense",
    f"""SELECT vec_id, pos::INTEGER AS pos, {sql.r6('cut')} AS cut, {sql.r6('longer')} AS longer
FROM (SELECT vec_id, i AS pos, CASE WHEN i < {DENSE_CUT} THEN embedding[i + 1] ELSE -9 END AS cut,
             coalesce(embedding[i + 1], 0) AS longer
      FROM (SELECT vec_id, embedding, unnest(range(0, {DENSE_PAD})) AS i FROM embeddings))""",
)
def pad_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors cut to 48 values (-9 marks where they end) and padded to 80."""
    padded = t.table(spark, sf, "embeddings").select(
        "vec_id",
        ids.pad_dense("embedding", DENSE_CUT).alias("cut"),
        F.posexplode(ids.pad_dense("embedding", DENSE_PAD)).alias("pos", "longer"),
    )
    cut = F.coalesce(F.get("cut", F.col("pos")), F.lit(-9.0))
    return padded.select("vec_id", "pos", t.rounded(cut).alias("cut"), t.rounded("longer").alias("longer"))


@query(
    "flatten_user_int",
    f"WITH {sql.WIDE} SELECT event_id, {sql.text(_group_sql('user_int'))} AS user_int_feats FROM wide",
)
def flatten_user_int(spark: SparkSession, sf: str) -> DataFrame:
    df = t.wide_samples(spark, sf)
    return df.select("event_id", t.joined_text(clean.flatten_group(df, t.CATALOG, "user_int")).alias("user_int_feats"))


@query(
    "slice_feature",
    f"""WITH {sql.WIDE}
SELECT event_id, {sql.text(sql.pad('user_int_feats_15', 3, 45))} AS feature_15,
       {sql.text(sql.pad('item_int_feats_11', 2, 95))} AS feature_11
FROM wide""",
)
def slice_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Features cut back out of the flattened vectors."""
    df = t.wide_samples(spark, sf)
    flat = df.select(
        "event_id",
        clean.flatten_group(df, t.CATALOG, "user_int").alias("user"),
        clean.flatten_group(df, t.CATALOG, "item_int").alias("item"),
    )
    return flat.select(
        "event_id",
        t.joined_text(clean.feature_segment(t.CATALOG, "user_int", 15, "user")).alias("feature_15"),
        t.joined_text(clean.feature_segment(t.CATALOG, "item_int", 11, "item")).alias("feature_11"),
    )


@query(
    "derive_label",
    f"WITH {sql.EVENTS} SELECT event_id, (coalesce(label_type, 0) = 2)::INTEGER AS label, 0::INTEGER AS blind FROM ev",
)
def derive_label(spark: SparkSession, sf: str) -> DataFrame:
    return t.events(spark, sf).select(
        "event_id",
        ids.conversion_label("label_type").alias("label"),
        ids.conversion_label("label_type", with_label=False).alias("blind"),
    )


def _audited_sql() -> str:
    parts = []
    for f in t.CATALOG.features:
        if f.vocab <= 0 or f.is_ts:
            continue
        grp = f.domain if f.grp == "seq" else f.grp
        limit = t.SEQ_MAX_LENS[f.domain] if f.grp == "seq" else f.dim
        listed = f.grp == "seq" or f.column in ("user_int_feats_15", "item_int_feats_11")
        values = f"unnest(list_slice({f.column}, 1, {limit}))" if listed else f.column
        parts.append(
            f"SELECT '{grp}' AS grp, '{f.column}' AS \"column\", {f.vocab}::BIGINT AS vocab, v FROM (SELECT {values} AS v FROM wide)"
        )
    return (
        "oob AS (SELECT grp, \"column\", vocab, count(*) AS oob_count, min(v) AS min_oob, max(v) AS max_oob, "
        "'TOO_HIGH' AS direction FROM (" + "\n UNION ALL ".join(parts) + ") WHERE v >= vocab GROUP BY grp, \"column\", vocab)"
    )


@query("oob_audit", f"WITH {sql.WIDE}, {_audited_sql()} SELECT * FROM oob")
def oob_audit(spark: SparkSession, sf: str) -> DataFrame:
    return clean.oob_audit(t.wide_samples(spark, sf), t.CATALOG, t.SEQ_MAX_LENS)


@query("oob_audit_while_writing", f"WITH {sql.WIDE}, {_audited_sql()} SELECT * FROM oob")
def oob_audit_while_writing(spark: SparkSession, sf: str) -> DataFrame:
    """The audit as it is observed while the model inputs are written: one scan for both."""
    return clean.audited_input(t.wide_samples(spark, sf), t.CATALOG, t.SEQ_MAX_LENS, keep=["event_id"])[1]


@query(
    "oob_report",
    f"""WITH {sql.WIDE}, {_audited_sql()}
SELECT "column" || ' (' || grp || '): ' || oob_count || ' ids from ' || min_oob || ' to ' || max_oob || ' are ' || direction || ' for a vocabulary of ' || vocab AS value
FROM oob""",
)
def oob_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.audit_report(oob_audit(spark, sf))


def _model_input_sql() -> str:
    columns = [
        "event_id", "user_id", "timestamp", "(coalesce(label_type, 0) = 2)::INTEGER AS label",
        f"{sql.text(_group_sql('user_int'))} AS user_int_feats",
        f"{sql.text(_group_sql('item_int'))} AS item_int_feats",
        f"{sql.text(_dense_sql())} AS user_dense_feats",
        "0::INTEGER AS item_dense_width",
    ]
    for domain in t.CATALOG.domains:
        width = t.SEQ_MAX_LENS[domain]
        side = t.CATALOG.side_info(domain)
        stack = ", ".join(sql.pad(f.column, width, f.vocab) for f in side)
        lengths = ", ".join(sql.used(f.column, width) for f in side)
        time = t.CATALOG.time_column(domain).column
        bucket = sql.bucket("timestamp", f"({time})[i + 1]")
        columns += [
            f"{sql.text(f'list_concat({stack})')} AS {domain}",
            f"greatest({lengths})::INTEGER AS {domain}_len",
            f"{sql.text(f'list_transform(range(0, {width}), lambda i: {bucket})')} AS {domain}_time_bucket",
        ]
    return f"WITH {sql.WIDE} SELECT " + ",\n ".join(columns) + " FROM wide"


@query("model_input", _model_input_sql())
def model_input(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning projection; lists are printed so that they can be compared."""
    built = clean.model_input(t.wide_samples(spark, sf), t.CATALOG, t.SEQ_MAX_LENS, keep=["event_id"])
    return built.select(
        "event_id", "user_id", "timestamp", "label",
        t.joined_text(F.col("user_int_feats")).alias("user_int_feats"),
        t.joined_text(F.col("item_int_feats")).alias("item_int_feats"),
        _milli_text("user_dense_feats").alias("user_dense_feats"),
        F.array_size("item_dense_feats").alias("item_dense_width"),
        *_domain_texts(t.CATALOG),
    )


def _domain_texts(catalog: Catalog):
    for domain in catalog.domains:
        width, used = catalog.max_len(domain, t.SEQ_MAX_LENS), F.col(f"{domain}_len")
        rows = [t.padded_text(F.get(domain, F.lit(i)), used, width) for i in range(len(catalog.side_info(domain)))]
        yield F.concat_ws(",", *rows).alias(domain)
        yield used
        yield t.padded_text(F.col(f"{domain}_time_bucket"), used, width).alias(f"{domain}_time_bucket")

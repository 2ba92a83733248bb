"""Queries: building, aligning, cutting, bucketing and pooling sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.functions.timebuckets import event_bucket, event_buckets
from featlake.operators import sequence
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import query

K = 10
MASK_WIDTH = 20
SEED = 42


@query(
    "build_history",
    f"WITH {sql.EVENT_HISTORY} SELECT event_id, {sql.text('types')} AS types, {sql.text('times')} AS times, {sql.text('ks')} AS ks FROM hist_a",
)
def build_history(spark: SparkSession, sf: str) -> DataFrame:
    return t.event_history(spark, sf).select("event_id", *[t.joined_text(F.col(c)).alias(c) for c in ("types", "times", "ks")])


def _long_sql(domain: str) -> str:
    width = t.SEQ_MAX_LENS[domain]
    side = t.CATALOG.side_info(domain)
    lengths = ", ".join(sql.used(f.column, width) for f in side)
    cells = "\n UNION ALL ".join(
        f"SELECT event_id, pos, {f.slot} AS slot, CASE WHEN {f.column}[pos + 1] > 0 AND {f.column}[pos + 1] < {f.vocab} "
        f"THEN {f.column}[pos + 1] ELSE 0 END AS id FROM positions"
        for f in side
    )
    return (
        f"positions AS (SELECT *, unnest(range(0, greatest({lengths}))) AS pos FROM wide),\n"
        f"long_{domain} AS (SELECT event_id, pos::INTEGER AS pos, slot::INTEGER AS slot, id FROM ({cells}))"
    )


@query("seq_stack_long", f"WITH {sql.WIDE}, {_long_sql('seq_a')} SELECT * FROM long_seq_a")
def seq_stack_long(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.stack_long(t.wide_samples(spark, sf), t.CATALOG, "seq_a", ["event_id"], t.SEQ_MAX_LENS["seq_a"])


@query(
    "seq_length",
    "WITH " + sql.WIDE + " SELECT event_id, "
    + ", ".join(
        "greatest(" + ", ".join(sql.used(f.column, t.SEQ_MAX_LENS[d]) for f in t.CATALOG.side_info(d)) + f")::INTEGER AS {d}_len"
        for d in t.CATALOG.domains
    )
    + " FROM wide",
)
def seq_length(spark: SparkSession, sf: str) -> DataFrame:
    return t.wide_samples(spark, sf).select(
        "event_id",
        *[sequence.domain_length(t.CATALOG, d, t.SEQ_MAX_LENS[d]).alias(f"{d}_len") for d in t.CATALOG.domains],
    )


@query(
    "seq_truncate",
    "WITH " + sql.WIDE + " SELECT event_id, "
    + ", ".join(
        f"coalesce({sql.text(f'list_slice({f.column}, 1, {t.SEQ_MAX_LENS[f.domain]})')}, '') AS {f.column}"
        for f in t.CATALOG.group("seq")
    )
    + " FROM wide",
)
def seq_truncate(spark: SparkSession, sf: str) -> DataFrame:
    cut = t.wide_samples(spark, sf).select("event_id", *sequence.truncated(t.CATALOG, t.SEQ_MAX_LENS))
    return cut.select(
        "event_id",
        *[F.coalesce(t.joined_text(F.col(f.column)), F.lit("")).alias(f.column) for f in t.CATALOG.group("seq")],
    )


@query(
    "time_bucket",
    f"""WITH {sql.EVENT_HISTORY}
SELECT event_id, {sql.text(f"list_transform(range(0, {t.HISTORY}), lambda i: {sql.bucket('timestamp', '(times)[i + 1]')})")} AS buckets
FROM hist_a""",
)
def time_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return t.event_history(spark, sf).select(
        "event_id", t.joined_text(event_buckets("timestamp", "times", t.HISTORY)).alias("buckets")
    )


def _hist_sql(cte: str, name: str) -> str:
    return (
        f"WITH {cte}, long AS (SELECT timestamp, unnest(times) AS t FROM {name}) "
        f"SELECT {sql.bucket('timestamp', 't')}::INTEGER AS bucket, count(*) AS n FROM long GROUP BY 1"
    )


@query("time_bucket_hist", _hist_sql(sql.EVENT_HISTORY, "hist_a"))
def time_bucket_hist(spark: SparkSession, sf: str) -> DataFrame:
    long = t.event_history(spark, sf).select("timestamp", F.explode("times").alias("t"))
    return long.groupBy(event_bucket("timestamp", "t").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("time_bucket_hist_orders", _hist_sql(sql.ORDER_HISTORY_CTE, "hist_b"))
def time_bucket_hist_orders(spark: SparkSession, sf: str) -> DataFrame:
    long = t.order_history(spark, sf).select("timestamp", F.explode("times").alias("t"))
    return long.groupBy(event_bucket("timestamp", "t").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "seq_mask",
    f"""WITH {sql.EVENT_HISTORY}
SELECT event_id, {sql.text(f"list_transform(range(0, {MASK_WIDTH}), lambda i: (i >= len(types))::INTEGER)")} AS mask FROM hist_a""",
)
def seq_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform(sequence.sequence_mask(F.array_size("types"), MASK_WIDTH), lambda m: m.cast("int"))
    return t.event_history(spark, sf).select("event_id", t.joined_text(mask).alias("mask"))


@query(
    "seq_mean_pool",
    f"""WITH {sql.WIDE}, {_long_sql('seq_a')}
SELECT event_id, slot, {sql.r6('sum(id) / greatest(count(*), 1)')} AS pooled FROM long_seq_a GROUP BY event_id, slot""",
)
def seq_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    samples = t.wide_samples(spark, sf)
    pooled = sequence.slot_means(samples, t.CATALOG, "seq_a", ["event_id"], t.SEQ_MAX_LENS["seq_a"], "pooled")
    return pooled.withColumn("pooled", t.rounded("pooled"))


@query(
    "seq_latest_k",
    f"""WITH {sql.EVENT_HISTORY}
SELECT event_id,
  {sql.text(f"list_transform(range(0, {K}), lambda i: CASE WHEN len(ks) - {K} + i >= 0 THEN ks[len(ks) - {K} + i + 1] ELSE 0 END)")} AS latest,
  {sql.text(f"list_transform(range(0, {K}), lambda i: (len(ks) - {K} + i < 0)::INTEGER)")} AS mask
FROM hist_a""",
)
def seq_latest_k(spark: SparkSession, sf: str) -> DataFrame:
    size = F.array_size("ks")
    mask = F.transform(sequence.latest_positions(size, K), lambda p: (p < 0).cast("int"))
    return t.event_history(spark, sf).select(
        "event_id",
        t.joined_text(sequence.latest_k("ks", size, K)).alias("latest"),
        t.joined_text(mask).alias("mask"),
    )


@query(
    "latest_events",
    f"""WITH {sql.EVENTS}
SELECT user_id, array_to_string(list(k ORDER BY rk DESC), ',') AS ks, array_to_string(list(timestamp ORDER BY rk DESC), ',') AS times
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_id DESC) AS rk FROM ev)
WHERE rk <= {K} GROUP BY user_id""",
)
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    latest = sequence.latest_events(
        t.events(spark, sf), ["user_id"], ["timestamp", "event_id"], {"ks": F.col("k"), "times": F.col("timestamp")}, K
    )
    return latest.select("user_id", *[t.joined_text(F.col(c)).alias(c) for c in ("ks", "times")])


@query(
    "seq_stats",
    f"""WITH {sql.EVENT_HISTORY},
counts AS (SELECT event_id, v, count(*) AS c FROM (SELECT event_id, unnest(types) AS v FROM hist_a) GROUP BY event_id, v),
modes AS (SELECT event_id, v FROM counts QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY c DESC, v) = 1),
gaps AS (SELECT event_id, list_transform(range(1, len(times)), lambda i: times[i + 1] - times[i]) AS g FROM hist_a)
SELECT h.event_id, len(types)::INTEGER AS n, len(list_distinct(types))::INTEGER AS n_distinct, coalesce(m.v, -1) AS mode,
       coalesce(list_min(g), -1) AS min_gap, coalesce(list_max(g), -1) AS max_gap,
       {sql.r6('CASE WHEN len(times) > 1 THEN (times[-1] - times[1]) / (len(times) - 1) ELSE -1 END')} AS mean_gap
FROM hist_a h LEFT JOIN modes m ON h.event_id = m.event_id JOIN gaps ON h.event_id = gaps.event_id""",
)
def seq_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = t.event_history(spark, sf).select("event_id", *sequence.sequence_stats("types", "times"))
    return stats.withColumn("mean_gap", t.rounded("mean_gap"))


@query(
    "time_gap_features",
    f"""WITH {sql.EVENTS}
SELECT event_id, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id), -1) AS gap,
       ((timestamp % 86400) // 3600)::INTEGER AS hour, ((timestamp // 86400 + 3) % 7)::INTEGER AS weekday
FROM ev""",
)
def time_gap_features(spark: SparkSession, sf: str) -> DataFrame:
    base = t.events(spark, sf).select("event_id", "user_id", "timestamp")
    features = sequence.time_gap_features(base, ["user_id"], ["timestamp", "event_id"], "timestamp")
    return features.select("event_id", "gap", "hour", "weekday")


@query(
    "domain_pair_pool",
    f"""WITH {sql.WIDE},
means AS (
  SELECT event_id,
         coalesce(list_sum(list_slice(domain_a_seq_40, 1, {t.SEQ_MAX_LENS['seq_a']}))::DOUBLE, 0)
           / greatest({sql.used('domain_a_seq_40', t.SEQ_MAX_LENS['seq_a'])}, 1) AS a,
         coalesce(list_sum(list_slice(domain_b_seq_68, 1, {t.SEQ_MAX_LENS['seq_b']}))::DOUBLE, 0)
           / greatest({sql.used('domain_b_seq_68', t.SEQ_MAX_LENS['seq_b'])}, 1) AS b
  FROM wide)
SELECT event_id, 'seq_a' AS domain_1, 'seq_b' AS domain_2, {sql.r6('a')} AS pool_1, {sql.r6('b')} AS pool_2 FROM means""",
)
def domain_pair_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = {
        d: sequence.list_mean(c, sequence.used_length(c, t.SEQ_MAX_LENS[d]))
        for d, c in {"seq_a": "domain_a_seq_40", "seq_b": "domain_b_seq_68"}.items()
    }
    pairs = sequence.domain_pairs(pooled, ["event_id"], t.wide_samples(spark, sf))
    return pairs.select("event_id", "domain_1", "domain_2", t.rounded("pool_1").alias("pool_1"), t.rounded("pool_2").alias("pool_2"))


@query("bucket_jitter")
def bucket_jitter(spark: SparkSession, sf: str) -> DataFrame:
    """Random by a hash that other engines lack: checked by properties in the tests."""
    buckets = t.event_history(spark, sf).select("event_id", event_buckets("timestamp", "times", t.HISTORY).alias("buckets"))
    return buckets.select(
        "event_id",
        t.joined_text(F.col("buckets")).alias("buckets"),
        t.joined_text(sequence.jittered_buckets("buckets", SEED, "event_id")).alias("jittered"),
    )


@query("position_dropout")
def position_dropout(spark: SparkSession, sf: str) -> DataFrame:
    """Random by a hash that other engines lack: checked by properties in the tests."""
    return t.event_history(spark, sf).select(
        "event_id",
        t.joined_text(F.col("types")).alias("types"),
        t.joined_text(sequence.position_dropout("types", SEED, "event_id", 0.1)).alias("dropped"),
    )

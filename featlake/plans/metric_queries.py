"""Queries: scores, losses, AUC, early stopping, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.functions import scores as s
from featlake.operators import metrics, score, split
from featlake.plans import sql_tables as sql
from featlake.plans import tables as t
from featlake.plans.registry import query

PATIENCE = 5
SMOOTHING = 0.1
HARD_RATIO = 0.3
BATCH = 256

_VALID = "valid AS (SELECT * FROM scores WHERE NOT isnan(logit))"


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return t.scores(spark, sf).filter(s.not_nan("logit"))


@query(
    "sigmoid_scores",
    f"WITH {sql.SCORES}, {_VALID} SELECT event_id, {sql.r6(sql.sigmoid('logit'))} AS prob FROM valid",
)
def sigmoid_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf).select("event_id", t.rounded(s.sigmoid("logit")).alias("prob"))


@query(
    "bce_loss",
    f"WITH {sql.SCORES}, {_VALID} SELECT {sql.r6('avg(' + sql.bce('logit', 'label') + ')')} AS bce FROM valid",
)
def bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bce_loss(_valid(spark, sf), "logit", "label").select(t.rounded("bce").alias("bce"))


@query(
    "bce_smoothed",
    f"""WITH {sql.SCORES}, {_VALID}
SELECT {sql.r6('avg(' + sql.bce('logit', f'(label * {1 - SMOOTHING}::DOUBLE + {SMOOTHING / 2}::DOUBLE)') + ')')} AS bce FROM valid""",
)
def bce_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bce_loss(_valid(spark, sf), "logit", "label", SMOOTHING).select(t.rounded("bce").alias("bce"))


_FOCAL = sql.focal("logit", "label", s.FOCAL_ALPHA, s.FOCAL_GAMMA)


@query(
    "focal_loss",
    f"""WITH {sql.SCORES}, {_VALID}
SELECT {sql.r6(f'avg({_FOCAL})')} AS mean_loss, {sql.r6(f'sum({_FOCAL})')} AS sum_loss FROM valid""",
)
def focal_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = s.focal("logit", "label")
    return _valid(spark, sf).agg(t.rounded(F.avg(loss)).alias("mean_loss"), t.rounded(F.sum(loss)).alias("sum_loss"))


@query("focal_loss_rows", f"WITH {sql.SCORES}, {_VALID} SELECT event_id, {sql.r6(_FOCAL)} AS focal FROM valid")
def focal_loss_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.focal_loss(_valid(spark, sf), "logit", "label", reduction="none")
    return rows.select("event_id", t.rounded("focal").alias("focal"))


_AUC_SQL = """WITH {ctes},
ranked AS (SELECT {by} label, rank() OVER ({part} ORDER BY logit) + (count(*) OVER (PARTITION BY {by} logit) - 1) / 2.0 AS r
           FROM valid),
sums AS (SELECT {by} sum(CASE WHEN label = 1 THEN r ELSE 0 END)::DOUBLE AS rs, sum(label)::DOUBLE AS p,
                (count(*) - sum(label))::DOUBLE AS n
         FROM ranked {group})
SELECT {by} {auc} AS auc FROM sums"""
_AUC_VALUE = sql.r6("CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2) / (p * n) ELSE 0 END")


@query(
    "auc",
    _AUC_SQL.format(ctes=f"{sql.SCORES}, {_VALID}", by="", part="", group="", auc=_AUC_VALUE),
)
def auc(spark: SparkSession, sf: str) -> DataFrame:
    probs = t.scores(spark, sf).select(s.sigmoid("logit").alias("prob"), "label")
    return metrics.auc(probs, "prob", "label").select(t.rounded("auc").alias("auc"))


_DOC_SCORES = """valid AS (
  SELECT d.lang, d.n_chars::DOUBLE AS logit, l.quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@query(
    "auc_by_group",
    _AUC_SQL.format(ctes=_DOC_SCORES, by="lang,", part="PARTITION BY lang", group="GROUP BY lang", auc=_AUC_VALUE),
)
def auc_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """How well document length separates good documents, per language."""
    labels = t.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = t.table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"))
    area = metrics.auc(docs.join(labels, "doc_id"), "n", "label", ["lang"])
    return area.select("lang", t.rounded("auc").alias("auc"))


@query(
    "auc_by_user",
    _AUC_SQL.format(ctes=f"{sql.SCORES}, {_VALID}", by="user_id,", part="PARTITION BY user_id", group="GROUP BY user_id", auc=_AUC_VALUE),
)
def auc_by_user(spark: SparkSession, sf: str) -> DataFrame:
    area = metrics.auc(t.scores(spark, sf), "logit", "label", ["user_id"])
    return area.select("user_id", t.rounded("auc").alias("auc"))


_LOGLOSS = "coalesce(avg(CASE WHEN NOT isnan(logit) THEN " + sql.bce("logit", "label") + " END), 'inf'::DOUBLE)"


@query("logloss", f"WITH {sql.SCORES} SELECT {sql.r6(_LOGLOSS)} AS logloss FROM scores")
def logloss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.logloss(t.scores(spark, sf), "logit", "label").select(t.rounded("logloss").alias("logloss"))


@query(
    "evaluate",
    f"""WITH {sql.SCORES}, {_VALID},
ranked AS (SELECT label, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS r FROM valid),
sums AS (SELECT sum(CASE WHEN label = 1 THEN r ELSE 0 END)::DOUBLE AS rs, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS n FROM ranked)
SELECT (SELECT count(*) FROM scores) AS n_rows, {_AUC_VALUE} AS auc, (SELECT {sql.r6(_LOGLOSS)} FROM scores) AS logloss FROM sums""",
)
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    row = metrics.evaluate(t.scores(spark, sf), "logit", "label")
    return row.select("n_rows", t.rounded("auc").alias("auc"), t.rounded("logloss").alias("logloss"))


@query(
    "nan_audit",
    f"""WITH {sql.SCORES}
SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE isnan(logit)) AS n_nan,
       count(*) FILTER (WHERE NOT isnan(logit)) AS n_valid
FROM scores GROUP BY event_type""",
)
def nan_audit(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nan_audit(t.scores(spark, sf), "logit", ["event_type"])


_BATCH_LOSS = f"""{sql.SCORES}, {_VALID},
placed AS (SELECT {sql.bce('logit', 'label')} AS loss, event_id // {t.BLOCK_ROWS} AS block_id,
                  (row_number() OVER (PARTITION BY event_id // {t.BLOCK_ROWS} ORDER BY event_id) - 1) // {BATCH} AS batch FROM valid),
batches AS (SELECT block_id, batch, sum(loss) AS s, count(*) AS n FROM placed GROUP BY block_id, batch)"""


def _batch_losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = _valid(spark, sf).select(
        "event_id", F.floor(F.col("event_id") / t.BLOCK_ROWS).alias("block_id"), s.bce("logit", "label").alias("loss")
    )
    return split.assign_batches(rows, "block_id", "event_id", BATCH)


@query(
    "epoch_loss",
    f"""WITH {_BATCH_LOSS}
SELECT count(*) AS n_batches, {sql.r6('sum(s) / sum(n)')} AS row_mean, {sql.r6('avg(s / n)')} AS mean_of_batch_means FROM batches""",
)
def epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.epoch_loss(_batch_losses(spark, sf), "loss", ["block_id", "batch"])
    return loss.select("n_batches", *[t.rounded(c).alias(c) for c in ("row_mean", "mean_of_batch_means")])


@query(
    "metric_history",
    f"""WITH {_BATCH_LOSS}
SELECT 'epoch-1' AS run, block_id, batch::INTEGER AS batch, 'Loss/train' AS metric, {sql.r6('s / n')} AS value FROM batches""",
)
def metric_history(spark: SparkSession, sf: str) -> DataFrame:
    """Loss per batch, as rows of the metric history."""
    losses = _batch_losses(spark, sf).groupBy("block_id", "batch").agg(F.avg("loss").alias("value"))
    return losses.select(
        F.lit("epoch-1").alias("run"), "block_id", "batch", F.lit("Loss/train").alias("metric"), t.rounded("value").alias("value")
    )


# Scores of a run in order. A run that stops is cut there, so the recursion ends early.
_STOP_SQL = """WITH RECURSIVE {hist},
ordered AS (SELECT run, step, score, row_number() OVER (PARTITION BY run ORDER BY step) AS pos FROM hist),
fold AS (
  SELECT run, pos, step, score AS best, step AS best_step, 0 AS misses FROM ordered WHERE pos = 1
  UNION ALL
  SELECT o.run, o.pos, o.step,
         CASE WHEN o.score > f.best + {delta} THEN o.score ELSE f.best END,
         CASE WHEN o.score > f.best + {delta} THEN o.step ELSE f.best_step END,
         CASE WHEN o.score > f.best + {delta} THEN 0 ELSE f.misses + 1 END
  FROM fold f JOIN ordered o ON o.run = f.run AND o.pos = f.pos + 1 WHERE f.misses < {patience})
SELECT run, max_by(best, pos) AS best_score, max_by(best_step, pos) AS best_step,
       coalesce(max(CASE WHEN misses >= {patience} THEN step END), -1) AS stop_step, max(pos) AS n_evaluations
FROM fold GROUP BY run"""


def _stops(df: DataFrame) -> DataFrame:
    return df.withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


@query("early_stop", _STOP_SQL.format(hist=sql.METRIC_HISTORY, delta="0", patience=PATIENCE))
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _stops(metrics.early_stop(t.metric_history(spark, sf), "run", "step", "score", PATIENCE))


@query("early_stop_delta", _STOP_SQL.format(hist=sql.METRIC_HISTORY, delta="5::DOUBLE", patience=PATIENCE))
def early_stop_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _stops(metrics.early_stop(t.metric_history(spark, sf), "run", "step", "score", PATIENCE, delta=5.0))


@query(
    "best_checkpoint",
    f"""WITH {sql.METRIC_HISTORY}
SELECT run, step AS best_step, score AS best_score, note AS best_note
FROM hist QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, step) = 1""",
)
def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_checkpoint(t.metric_history(spark, sf), "run", "step", "score", ["note"])


@query(
    "leaderboard",
    f"""WITH {sql.METRIC_HISTORY}
SELECT run, best_score, rank() OVER (ORDER BY best_score DESC) AS place
FROM (SELECT run, max(score) AS best_score FROM hist GROUP BY run)""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.leaderboard(t.metric_history(spark, sf), "run", "score")


@query(
    "predictions_last_wins",
    f"""WITH {sql.SCORES}, {_VALID}
SELECT user_id, {sql.r6('max_by(' + sql.sigmoid('logit') + ', event_id)')} AS prob FROM valid GROUP BY user_id""",
)
def predictions_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = _valid(spark, sf).select("event_id", "user_id", s.sigmoid("logit").alias("prob"))
    return metrics.last_wins(rows, "user_id", "prob", "event_id").select("user_id", t.rounded("prob").alias("prob"))


@query(
    "prediction_coverage",
    """SELECT user_id, 'missing' AS problem FROM (SELECT DISTINCT o_custkey AS user_id FROM orders EXCEPT SELECT user_id FROM events)
UNION ALL
SELECT user_id, 'unexpected' FROM (SELECT DISTINCT user_id FROM events EXCEPT SELECT o_custkey FROM orders)""",
)
def prediction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    expected = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    return metrics.coverage(expected, t.table(spark, sf, "events").select("user_id"), "user_id")


@query(
    "hard_examples",
    f"""WITH {sql.SCORES}, {_VALID},
errors AS (SELECT event_id, label, abs({sql.sigmoid('logit')} - label) AS error FROM valid)
SELECT event_id, label, {sql.r6('error')} AS error
FROM errors QUALIFY row_number() OVER (ORDER BY error DESC, event_id) <= (SELECT floor(count(*) * {HARD_RATIO}::DOUBLE) FROM errors)""",
)
def hard_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = _valid(spark, sf).select("event_id", "label", s.sigmoid("logit").alias("prob"))
    hard = metrics.hard_examples(rows, "prob", "label", "event_id", HARD_RATIO)
    return hard.select("event_id", "label", t.rounded("error").alias("error"))


_COMBINED_FOCAL = sql.focal("logit", "label", s.COMBINED_FOCAL_ALPHA, s.FOCAL_GAMMA)


@query(
    "combined_loss",
    f"""WITH {sql.SCORES}, {_VALID},
parts AS (SELECT avg({sql.bce('logit', 'label')}) AS b, avg({_COMBINED_FOCAL}) AS f,
                 -sum({sql.sigmoid('logit')} * label) / (sum(label) + 1e-8) AS r FROM valid)
SELECT {sql.r6('b')} AS bce, {sql.r6('f')} AS focal, {sql.r6('r')} AS rank_term,
       {sql.r6('0.3::DOUBLE * b + 0.5::DOUBLE * f + 0.2::DOUBLE * r')} AS combined FROM parts""",
)
def combined_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.combined_loss(_valid(spark, sf), "logit", "label")
    return loss.select(*[t.rounded(c).alias(c) for c in ("bce", "focal", "rank_term", "combined")])


@query("score_samples")
def score_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted linear baseline: its weights depend on the optimizer, so rows only."""
    samples = t.samples(spark, sf).select(
        "event_id", "user_id", "value", "k", "nation", "segment",
        F.when(F.col("label_type") == 2, 1).otherwise(0).alias("label"),
    )
    filled = samples.fillna(0, ["k", "nation", "segment"])
    model = score.fit_linear(filled, "label", ["value"], ["k", "nation", "segment"])
    return score.score(filled, model, ["event_id", "user_id"])

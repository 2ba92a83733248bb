"""Losses, AUC, early stopping, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.functions.scores import (
    COMBINED_FOCAL_ALPHA,
    COMBINED_WEIGHTS,
    FOCAL_ALPHA,
    FOCAL_GAMMA,
    SMALL,
    bce,
    focal,
    not_nan,
    sigmoid,
    smoothed,
)
from featlake.operators.ordering import (
    CHUNK,
    MAX_GROUP_ROWS,
    bounded_groups,
    carry_over,
    numbered,
    running_totals,
    select_first,
    value_bins,
)
from featlake.session import write_and_read


def reduced(df: DataFrame, loss: Column, reduction: str, name: str) -> DataFrame:
    """Aggregate a row loss: 'mean', 'sum', or 'none' for one value per row."""
    if reduction == "mean":
        return df.agg(F.avg(loss).alias(name))
    if reduction == "sum":
        return df.agg(F.sum(loss).alias(name))
    return df.withColumn(name, loss)


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; NaN scores are dropped.

    0.0 when empty or when only one class is left.
    """
    return _ranked(df, score, label, by, {}).select(*by, "auc")


def _ranked(df: DataFrame, score: str, label: str, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """AUC, and sums of further row values taken along in the same pass.

    Rows are first counted per distinct score, so a score shared by very many
    rows becomes one row before the sort. Scores are then ranked inside quantile
    bins, and a table of one row per (group, bin) carries the negatives of the
    lower bins. The quantiles are a pass of their own: write ``df`` before if it
    is costly to compute.
    """
    kept = not_nan(score)
    # A NaN row keeps its group alive with no weight.
    value = F.when(kept, F.col(score)).otherwise(F.lit(0.0))
    weighted = df.select(
        *by,
        value.alias("_score"),
        F.when(kept, F.col(label)).otherwise(0).cast("bigint").alias("_pos"),
        F.when(kept, 1 - F.col(label)).otherwise(0).cast("bigint").alias("_neg"),
        *[c.alias(name) for name, c in sums.items()],
    )
    added = [F.sum(name).alias(name) for name in ["_pos", "_neg", *sums]]
    counts = value_bins(weighted, "_score").groupBy(*by, "_bin", "_score").agg(*added)
    lower = Window.partitionBy(*by, "_bin").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(lower), F.lit(0))
    per_bin = (
        counts.withColumn("_won", F.col("_pos") * (below + F.col("_neg") / 2.0))
        .groupBy(*by, "_bin")
        .agg(F.sum("_won").alias("_won"), *added)
    )
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).cast("double")
    total = (
        per_bin.withColumn("_won", F.col("_won") + F.col("_pos") * before)
        .groupBy(*by)
        .agg(F.sum("_won").alias("_won"), *added)
    )
    pairs = F.col("_pos").cast("double") * F.col("_neg")
    area = F.when(pairs > 0, F.col("_won") / pairs).otherwise(F.lit(0.0))
    return total.select(*by, area.alias("auc"), *sums)


def logloss(df: DataFrame, logit: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross entropy over non-NaN logits; infinity when none is left."""
    loss = F.avg(F.when(not_nan(logit), bce(logit, label)))
    return df.groupBy(*by).agg(F.coalesce(loss, F.lit(float("inf"))).alias("logloss"))


def evaluate(df: DataFrame, logit: str, label: str) -> DataFrame:
    """One row with AUC and logloss of a validation set; both 0.0 when it is empty."""
    kept = not_nan(logit)
    sums = {
        "_rows": F.lit(1),
        "_kept": F.when(kept, 1).otherwise(0),
        "_loss": F.when(kept, bce(logit, label)).otherwise(F.lit(0.0)),
    }
    scored = df.select("*", sigmoid(logit).alias("_prob"), *[c.alias(n) for n, c in sums.items()])
    row = _ranked(scored, "_prob", label, (), {n: F.col(n) for n in sums})
    n_rows = F.coalesce("_rows", F.lit(0))
    loss = (
        F.when(n_rows == 0, F.lit(0.0))
        .when(F.col("_kept") == 0, F.lit(float("inf")))
        .otherwise(F.col("_loss") / F.col("_kept"))
    )
    return row.select(n_rows.alias("n_rows"), "auc", loss.alias("logloss"))


def nan_audit(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.isnan(score)).alias("n_nan"),
        F.count_if(not_nan(score)).alias("n_valid"),
    )


def combined_loss(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Weighted sum of cross entropy, focal loss and the mean score of positives, in one pass."""
    y = F.col(label)
    w_bce, w_focal, w_rank = COMBINED_WEIGHTS
    rank = -F.sum(sigmoid(logit) * y) / (F.sum(y) + SMALL)
    parts = df.agg(
        F.avg(bce(logit, label)).alias("bce"),
        F.avg(focal(logit, label, COMBINED_FOCAL_ALPHA, FOCAL_GAMMA)).alias("focal"),
        rank.alias("rank_term"),
    )
    total = w_bce * F.col("bce") + w_focal * F.col("focal") + w_rank * F.col("rank_term")
    return parts.withColumn("combined", total)


def bce_loss(df: DataFrame, logit: str, label: str, smoothing: float = 0.0, reduction: str = "mean") -> DataFrame:
    target = smoothed(label, smoothing) if smoothing else F.col(label)
    return reduced(df, bce(F.col(logit), target), reduction, "bce")


def focal_loss(
    df: DataFrame, logit: str, label: str, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA, reduction: str = "mean"
) -> DataFrame:
    return reduced(df, focal(logit, label, alpha, gamma), reduction, "focal")


def epoch_loss(df: DataFrame, loss: str, batch_keys: Sequence[str]) -> DataFrame:
    """Row-weighted mean loss, and the mean of the batch means."""
    batches = df.groupBy(*batch_keys).agg(F.sum(loss).alias("s"), F.count(F.lit(1)).alias("n"))
    return batches.agg(
        F.count(F.lit(1)).alias("n_batches"),
        (F.sum("s") / F.sum("n")).alias("row_mean"),
        F.avg(F.col("s") / F.col("n")).alias("mean_of_batch_means"),
    )


def hard_examples(df: DataFrame, score: str, label: str, key: str, ratio: float) -> DataFrame:
    """The ``int(rows * ratio)`` rows whose score is farthest from the label; ties by key.

    A row without an error, as its score or label is null or NaN, counts as a row but comes after all others.
    """
    error = F.abs(F.col(score) - F.col(label))
    known = df.withColumn("error", error).withColumn("_hard", F.coalesce(F.when(not_nan("error"), F.col("error")), F.lit(-1.0)))
    return select_first(known, lambda n_rows: int(n_rows * ratio), [("_hard", True), (key, False)]).drop("_hard")


def last_wins(predictions: DataFrame, user: str, prob: str, order: str) -> DataFrame:
    """One prediction per user: the one with the greatest order key.

    An aggregate, not a window, so a task hands on one row per user.
    """
    return predictions.groupBy(user).agg(F.max_by(prob, order).alias(prob))


def coverage(expected: DataFrame, predicted: DataFrame, user: str) -> DataFrame:
    """Users missing from the predictions, and predicted users nobody asked for.

    Both sides are tagged and aggregated together: one shuffle of at most one
    row per user and task, instead of two anti joins.
    """
    tagged = expected.select(user, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(
        predicted.select(user, F.lit(0).alias("e"), F.lit(1).alias("p"))
    )
    sides = tagged.groupBy(user).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    return sides.filter(F.col("e") != F.col("p")).select(
        user, F.when(F.col("e") == 1, "missing").otherwise("unexpected").alias("problem")
    )


def best_checkpoint(history: DataFrame, run: str, step: str, score: str, extra: Sequence[str] = ()) -> DataFrame:
    """Per run the first step with the highest score, and the other metrics of that step."""
    at = F.struct(step, score, *extra)
    best = history.groupBy(run).agg(F.max_by(at, F.struct(F.col(score), -F.col(step))).alias("_at"))
    return best.select(
        run,
        F.col(f"_at.{step}").alias("best_step"),
        F.col(f"_at.{score}").alias("best_score"),
        *[F.col(f"_at.{c}").alias(f"best_{c}") for c in extra],
    )


def leaderboard(history: DataFrame, run: str, score: str) -> DataFrame:
    """Runs ranked by their best score; equal scores share a rank.

    Ranks come from counts per distinct score, so no task sorts all runs. The
    best scores, one row per run, are written once and looked at several times.
    """
    best = write_and_read(history.groupBy(run).agg(F.max(score).alias("best_score")), "best-scores")
    counts = best.groupBy("best_score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_order", -F.col("best_score"))
    ranks = running_totals(counts, "_order", {"_ahead": F.col("_n")}).select("best_score", "_ahead")
    return best.join(ranks, "best_score").select(run, "best_score", (F.col("_ahead") + 1).alias("place"))


def early_stop(
    history: DataFrame,
    run: str,
    step: str,
    score: str,
    patience: int = 5,
    delta: float = 0.0,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per run: best score and step, where it stopped (null if it did not), evaluations seen.

    The first score seeds; a later one improves only if it exceeds the best by
    more than ``delta``; ``patience`` misses in a row stop the run. Scores must
    not be NaN.
    """
    if delta < 0:
        raise ValueError(f"delta is {delta}, less than 0")
    seen, split = _records(history, run, step, score, max_rows)
    if delta > 0:
        return _stop_with_delta(seen, run, step, score, patience, delta, max_rows)
    here = Window.partitionBy(run, CHUNK).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    record = F.when(F.col("_record"), F.struct("_pos", F.col(score).alias("score"), F.col(step).alias("step")))
    last = seen.withColumn("_rec", record).withColumn("_last", F.max("_rec").over(here))
    if split:
        last = carry_over(last, [run], {"_rec": "_last_before"}).withColumn("_last", F.coalesce("_last", "_last_before"))
    stopped = F.col("_pos") - F.col("_last._pos") >= patience
    ends = last.groupBy(run).agg(
        F.min_by(
            F.struct(F.col(step).alias("step"), F.col("_pos").alias("pos"), F.col("_last").alias("last")),
            F.when(stopped, F.col("_pos")),
        ).alias("stop"),
        F.max_by("_last", "_pos").alias("last"),
        F.max("_pos").alias("n"),
    )
    best = F.coalesce("stop.last", "last")
    return ends.select(
        run,
        best["score"].alias("best_score"),
        best["step"].alias("best_step"),
        F.col("stop.step").alias("stop_step"),
        F.coalesce("stop.pos", "n").alias("n_evaluations"),
    )


def _records(history: DataFrame, run: str, step: str, score: str, max_rows: int) -> tuple[DataFrame, bool]:
    """Rows with their position in the run and whether they beat all earlier scores."""
    rows, split = bounded_groups(history.select(run, step, score), [run], [step], 0, max_rows)
    order = Window.partitionBy(run, CHUNK).orderBy(step)
    rows = rows.withColumn("_pos", F.row_number().over(order).cast("bigint")).withColumn(
        "_top", F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    if split:
        rows = rows.withColumn("_one", F.lit(1).cast("bigint"))
        rows = carry_over(rows, [run], {score: "_top_before"}, {"_one": "_rows_before"})
        rows = rows.withColumn("_top", F.greatest("_top", "_top_before")).withColumn(
            "_pos", F.col("_pos") + F.coalesce("_rows_before", F.lit(0))
        )
    record = F.col("_top").isNull() | (F.col(score) > F.col("_top"))
    return rows.withColumn("_record", record).select(run, step, score, CHUNK, "_pos", "_record"), split


def _stop_with_delta(
    seen: DataFrame, run: str, step: str, score: str, patience: int, delta: float, max_rows: int
) -> DataFrame:
    """Early stop with a minimum improvement, as a fold over the rows that beat all earlier ones.

    Only those can improve. They are listed per run in pieces of up to ``max_rows``, and the state a piece
    leaves (best score and its step and place, place of the stop) is what the next one starts
    from. One piece a run is the rule; further ones are folded one after the other, all runs at once.
    """
    records = numbered(seen.filter("_record").select(run, step, score, "_pos"), [run], ["_pos"], "_nth", max_rows)
    item = F.struct("_pos", F.col(score).cast("double").alias("score"), F.col(step).alias("step"))
    pieces = records.groupBy(run, F.floor(F.col("_nth") / max_rows).alias("_piece")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    pieces = write_and_read(pieces, "stop-pieces")
    kind = f"struct<score:double,step:{seen.schema[step].dataType.simpleString()},pos:bigint,stop:bigint>"

    def state(at: Column, value: Column, pos: Column, stop: Column) -> Column:
        return F.struct(value.alias("score"), at.alias("step"), pos.alias("pos"), stop.cast("bigint").alias("stop")).cast(kind)

    def fold(best: Column, x: Column) -> Column:
        lapsed = x["_pos"] - best["pos"] > patience
        return (
            F.when(best["pos"].isNull(), state(x["step"], x["score"], x["_pos"], F.lit(None)))
            .when(best["stop"].isNotNull(), best)
            .when(lapsed, state(best["step"], best["score"], best["pos"], best["pos"] + patience))
            .when(x["score"] > best["score"] + delta, state(x["step"], x["score"], x["_pos"], F.lit(None)))
            .otherwise(best)
        )

    empty = state(F.lit(None), F.lit(None), F.lit(None), F.lit(None))
    high = pieces.agg(F.max("_piece")).first()[0] or 0
    best = pieces.filter("_piece = 0").select(run, F.aggregate("_items", empty, fold).alias("_best"))
    for piece in range(1, high + 1):
        more = pieces.filter(F.col("_piece") == piece).select(F.col(run).alias("_run"), "_items")
        on = best[run].eqNullSafe(more["_run"])
        folded = F.when(F.col("_items").isNull(), F.col("_best")).otherwise(F.aggregate("_items", F.col("_best"), fold))
        best = write_and_read(best.join(more, on, "left").select(run, folded.alias("_best")), "stop-state")

    ends = seen.groupBy(F.col(run).alias("_run")).agg(F.max("_pos").alias("_n"))
    stop = F.coalesce("_best.stop", F.when(F.col("_n") - F.col("_best.pos") >= patience, F.col("_best.pos") + patience))
    known = best.join(ends, best[run].eqNullSafe(ends["_run"])).select(run, "_best", "_n", stop.alias("_stop"))
    at_stop = seen.select(F.col(run).alias("_run"), F.col("_pos").alias("_at"), F.col(step).alias("stop_step"))
    on = known[run].eqNullSafe(at_stop["_run"]) & (known["_stop"] == at_stop["_at"])
    return known.join(at_stop, on, "left").select(
        run,
        F.col("_best.score").alias("best_score"),
        F.col("_best.step").alias("best_step"),
        "stop_step",
        F.coalesce("_stop", "_n").alias("n_evaluations"),
    )

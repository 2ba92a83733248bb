"""Metrics against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from featlake.functions.scores import sigmoid
from featlake.operators import metrics, score
from featlake.plans import QUERIES
from featlake.sources import sinks

NAN = float("nan")


def pair_auc(rows):
    pos = [s for s, y in rows if y == 1 and not math.isnan(s)]
    neg = [s for s, y in rows if y == 0 and not math.isnan(s)]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def frame(spark, rows, kind="s double, y int"):
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("rows", [
    [], [(0.1, 1)], [(0.1, 1), (0.4, 1)], [(NAN, 1), (0.2, 0)], [(0.3, 1), (0.3, 0)], [(0.9, 1), (0.1, 0), (NAN, 0)],
    [(0.9, 0), (0.1, 1)]])
def test_auc_edges(spark, rows):
    assert metrics.auc(frame(spark, rows), "s", "y").first()["auc"] == pair_auc(rows)


def test_auc_with_a_hot_score_and_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.5, 0.5, round(rng.random(), 2), NAN]), int(rng.random() < 0.3), rng.randrange(4)) for _ in range(500)]
    rows += [(NAN, 1, 9), (0.5, 1, 8)]
    df = frame(spark, rows, "s double, y int, g int")
    assert metrics.auc(df, "s", "y").first()["auc"] == pytest.approx(pair_auc([r[:2] for r in rows]))
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert metrics.auc(flipped, "s", "y").first()["auc"] == pytest.approx(1 - pair_auc([r[:2] for r in rows]))
    got = {r["g"]: r["auc"] for r in metrics.auc(df, "s", "y", ["g"]).collect()}
    assert set(got) == {0, 1, 2, 3, 8, 9}
    for g, value in got.items():
        assert value == pytest.approx(pair_auc([r[:2] for r in rows if r[2] == g]))


def test_evaluate(spark):
    empty = metrics.evaluate(frame(spark, []), "s", "y").first()
    assert (empty["n_rows"], empty["auc"], empty["logloss"]) == (0, 0.0, 0.0)
    bad = metrics.evaluate(frame(spark, [(NAN, 1), (NAN, 0)]), "s", "y").first()
    assert (bad["n_rows"], bad["auc"], bad["logloss"]) == (2, 0.0, math.inf)
    rows = [(2.0, 1), (-1.0, 0), (0.5, 0), (NAN, 1)]
    row = metrics.evaluate(frame(spark, rows), "s", "y").first()
    losses = [math.log1p(math.exp(-x)) if y else math.log1p(math.exp(x)) for x, y in rows[:3]]
    assert row["auc"] == 1.0 and row["logloss"] == pytest.approx(sum(losses) / 3)


def test_reductions(spark):
    df = frame(spark, [(2.0, 1), (-1.0, 0)])
    rows = [r["focal"] for r in metrics.focal_loss(df, "s", "y", reduction="none").collect()]
    assert metrics.focal_loss(df, "s", "y", reduction="sum").first()["focal"] == pytest.approx(sum(rows))
    assert metrics.focal_loss(df, "s", "y").first()["focal"] == pytest.approx(sum(rows) / 2)
    p = 1 / (1 + math.exp(-2.0))
    assert rows[0] == pytest.approx(-0.1 * (1 - p) ** 2 * math.log(p))
    smooth = metrics.bce_loss(df, "s", "y", smoothing=0.1).first()["bce"]
    hard = metrics.bce_loss(df, "s", "y").first()["bce"]
    assert smooth > hard
    parts = metrics.combined_loss(df, "s", "y").first()
    assert parts["rank_term"] == pytest.approx(-p / (1 + 1e-8))
    assert parts["combined"] == pytest.approx(0.3 * parts["bce"] + 0.5 * parts["focal"] + 0.2 * parts["rank_term"])


def stop(scores, patience, delta):
    best = at = None
    misses = 0
    for i, s in enumerate(scores):
        if best is None or s > best + delta:
            best, at, misses = s, i, 0
        else:
            misses += 1
            if misses >= patience:
                return best, at, i, i + 1
    return best, at, None, len(scores)


@pytest.mark.parametrize("max_rows", [3, 20, 10_000])
@pytest.mark.parametrize("patience, delta", [(3, 0.0), (1, 0.0), (5, 0.0), (3, 0.05), (2, 0.01)])
def test_early_stop(spark, max_rows, patience, delta):
    rng = random.Random(11)
    runs = {
        "rising": [i / 100 for i in range(60)], "falling": [1 - i / 100 for i in range(30)], "one": [0.5],
        "shape": [0.5, 0.6, 0.6, 0.605, 0.59], "flat": [0.5] * 4, "late": [0.1, 0.0, 0.2, 0.0, 0.3, 0.0, 0.0, 0.9],
        **{f"r{k}": [round(rng.random() + i / 30, 3) for i in range(rng.randrange(1, 45))] for k in range(12)},
    }
    rows = [(name, i, s) for name, scores in runs.items() for i, s in enumerate(scores)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, step bigint, score double")
    got = {r["run"]: r for r in metrics.early_stop(df, "run", "step", "score", patience, delta, max_rows).collect()}
    assert set(got) == set(runs)
    for name, scores in runs.items():
        r = got[name]
        assert (r["best_score"], r["best_step"], r["stop_step"], r["n_evaluations"]) == stop(scores, patience, delta), name


def test_early_stop_example(spark):
    rows = [("a", i, s) for i, s in enumerate([0.5, 0.6, 0.6, 0.605, 0.59])]
    row = metrics.early_stop(spark.createDataFrame(rows, "run string, step bigint, score double"), "run", "step", "score", 3, 0.01).first()
    assert (row["best_score"], row["best_step"], row["stop_step"]) == (0.6, 1, 4)


def test_best_checkpoint_and_leaderboard(spark):
    rows = [("a", 1, 0.5, 0.9), ("a", 2, 0.7, 0.8), ("a", 3, 0.7, 0.1), ("b", 1, 0.7, 0.3), ("c", 1, 0.2, 0.4)]
    df = spark.createDataFrame(rows, "run string, step bigint, auc double, logloss double")
    best = {r["run"]: (r["best_step"], r["best_logloss"]) for r in metrics.best_checkpoint(df, "run", "step", "auc", ["logloss"]).collect()}
    assert best == {"a": (2, 0.8), "b": (1, 0.3), "c": (1, 0.4)}
    places = {r["run"]: r["place"] for r in metrics.leaderboard(df, "run", "auc").collect()}
    assert places == {"a": 1, "b": 1, "c": 3}


def test_last_wins_and_coverage(spark):
    df = spark.createDataFrame([(1, 0.1, 5), (1, 0.2, 9), (1, 0.3, 7), (2, 0.4, 1)], "user_id bigint, prob double, at bigint")
    assert {r["user_id"]: r["prob"] for r in metrics.last_wins(df, "user_id", "prob", "at").collect()} == {1: 0.2, 2: 0.4}
    asked = spark.createDataFrame([(2,), (3,), (3,)], "user_id bigint")
    assert {(r["user_id"], r["problem"]) for r in metrics.coverage(asked, df, "user_id").collect()} == {(1, "unexpected"), (3, "missing")}


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
def test_hard_examples_with_ties(spark, ratio):
    rng = random.Random(2)
    rows = [(i, rng.choice([0.5, 0.5, round(rng.random(), 1)]), rng.randrange(2)) for i in range(200)]
    got = metrics.hard_examples(spark.createDataFrame(rows, "id bigint, p double, y int"), "p", "y", "id", ratio)
    want = sorted(rows, key=lambda r: (-abs(r[1] - r[2]), r[0]))[: int(200 * ratio)]
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in want)


def test_epoch_loss(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "b int, loss double")
    row = metrics.epoch_loss(df, "loss", ["b"]).first()
    assert (row["n_batches"], row["row_mean"], row["mean_of_batch_means"]) == (2, 4.0, 5.0)


def test_predictions_document(spark, tmp_path):
    rows = [(f'u"{i}\\é', i / 7) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id string, prob double")
    for part, want in ((df, dict(rows)), (df.limit(1), None), (df.limit(0), {})):
        out = tmp_path / f"doc{part.count()}"
        sinks.write_predictions_document(part, str(out))
        text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
        found = json.loads(text)["predictions"]
        assert found == (want if want is not None else dict(map(tuple, part.collect())))
    out = str(tmp_path / "rows")
    sinks.write_predictions(df, out, "json")
    assert {r["user_id"]: r["prob"] for r in spark.read.json(out).collect()} == dict(rows)


def test_history_sink(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.append_history(spark, [("r", 1, "Loss/train", 0.5), ("r", 1, "AUC/valid", 0.6)], path)
    sinks.append_history(spark, [("r", 2, "Loss/train", 0.4)], path)
    got = sinks.read_history(spark, path).filter("metric = 'Loss/train'").orderBy("step").collect()
    assert [(r["run"], r["step"], r["value"]) for r in got] == [("r", 1, 0.5), ("r", 2, 0.4)]


def test_scores_are_probabilities(spark, sf_dir):
    row = QUERIES["score_samples"](spark, sf_dir).agg(F.count("*").alias("n"), F.min("prob").alias("a"), F.max("prob").alias("b")).first()
    assert row["n"] == 1000 and 0 <= row["a"] <= row["b"] <= 1


def test_fit_learns_and_predicts(spark, tmp_path):
    from featlake.plans.workflows import predict, validate

    rng = random.Random(4)
    rows = [(i // 2, i, float(x := rng.gauss(0, 1)), rng.randrange(5), int(x + rng.gauss(0, 0.3) > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id bigint, at bigint, x double, c bigint, y int")
    model = score.fit_linear(df, "y", ["x"], ["c"], n_hash=32)
    scored = score.score(df, model, ["at", "y"])
    assert validate(scored, "logit", "y").first()["auc"] > 0.9
    assert scored.filter(F.abs(sigmoid("logit") - F.col("prob")) > 1e-9).count() == 0
    predict(df, model, "at", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 200


def test_outside_model(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id bigint, x double")
    out = score.score_with(df, lambda batch: 1 / (1 + (-batch["x"]).map(math.exp)), ["id"]).collect()
    assert {r["id"]: round(r["prob"], 4) for r in out} == {1: 0.6225, 2: 0.8176}


def test_early_stop_with_delta_folds_pieces_in_the_jvm(spark):
    """One run of rising scores in several pieces, next to short runs and one that never improves."""
    rows = [("long", i, 0.01 * i + (0.5 if i % 7 == 0 else 0)) for i in range(40)]
    rows += [("flat", i, 1.0) for i in range(9)] + [(None, 0, 0.3), (None, 1, 0.9)] + [("one", 5, 0.1)]
    df = spark.createDataFrame(rows, "run string, step bigint, score double").repartition(4)

    def brute(scores, patience, delta):
        best, at, step = None, 0, None
        for pos, (s, v) in enumerate(scores, 1):
            if best is None or v > best + delta:
                best, at, step = v, pos, s
            elif pos - at >= patience:
                return best, step, s, pos
        return best, step, None, len(scores)

    by_run = {}
    for run, step, value in rows:
        by_run.setdefault(run, []).append((step, value))
    for patience, delta in ((3, 0.02), (8, 0.055), (50, 0.2)):
        stops = metrics.early_stop(df, "run", "step", "score", patience, delta, max_rows=15)
        assert "Python" not in stops._jdf.queryExecution().executedPlan().toString()
        assert {r[0]: tuple(r)[1:] for r in stops.collect()} == {run: brute(s, patience, delta) for run, s in by_run.items()}


def test_hard_examples_without_a_score_come_last(spark):
    rows = [(1, 0.9, 0), (2, None, 1), (3, float("nan"), 0), (4, 0.2, 0), (5, 0.5, None), (6, 0.7, 1)]
    df = spark.createDataFrame(rows, "id bigint, p double, y int")
    order = [{r["id"] for r in metrics.hard_examples(df, "p", "y", "id", k / 6).collect()} for k in range(7)]
    assert order == [set(), {1}, {1, 6}, {1, 4, 6}, {1, 2, 4, 6}, {1, 2, 3, 4, 6}, {1, 2, 3, 4, 5, 6}]
    assert metrics.hard_examples(df.select("id", F.lit(None).cast("double").alias("p"), "y"), "p", "y", "id", 0.5).count() == 3

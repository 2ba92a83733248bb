"""Embedding joins: the broadcast and the shuffled form against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.operators import embed

WIDTH = 6


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    return {(fid, i): rng.normal(size=WIDTH).astype(np.float32) for fid in (1, 2) for i in range(1, 21)}


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(fid, i, [float(x) for x in v]) for (fid, i), v in vectors.items()]
    return spark.createDataFrame(rows, "fid bigint, id bigint, vec array<float>").cache()


def vec(vectors, fid, i):
    return vectors.get((fid, i), np.zeros(WIDTH, np.float32))


@pytest.mark.parametrize("limit", [None, 0])
def test_lookup(spark, table, vectors, limit):
    df = spark.createDataFrame([(r, 7 if r % 3 else r % 25) for r in range(90)] + [(90, None), (91, 0)], "r bigint, i bigint")
    got = embed.lookup(df, "i", 1, table, WIDTH, limit=limit).collect()
    assert len(got) == 92
    for r in got:
        assert np.array_equal(np.float32(r["vec"]), vec(vectors, 1, r["i"]))


@pytest.mark.parametrize("limit", [None, 0])
def test_concat(spark, table, vectors, limit):
    df = spark.createDataFrame([(r, r % 25, r % 7, f"x{r}") for r in range(60)], "r bigint, a bigint, b bigint, note string")
    got = embed.lookup_concat(df, ["r"], [(2, "b"), (None, "a"), (1, "a")], table, WIDTH, limit=limit).collect()
    assert len(got) == 60
    for r in got:
        want = np.concatenate([vec(vectors, 2, r["b"]), np.zeros(WIDTH), vec(vectors, 1, r["a"])])
        assert np.allclose(r["vec"], want) and r["note"] == f"x{r['r']}"
    skipped = embed.lookup_concat(df, ["r"], [(None, "a")], table, WIDTH).first()
    assert skipped["vec"] == [0.0] * WIDTH


@pytest.mark.parametrize("limit", [None, 0])
def test_bag_mean_of_odd_lists(spark, table, vectors, limit):
    bags = [(0, [1, 2, 3]), (1, []), (2, None), (3, [-4, 5]), (4, [6, 0, 7]), (5, [8]), (5, [9]), (6, [None, 2]), (7, [99, 3])]
    df = spark.createDataFrame(bags, "r bigint, ids array<bigint>")
    got = sorted((r["r"], r["vec"]) for r in embed.bag_mean(df, ["r"], "ids", 2, 1, table, WIDTH, limit=limit).collect())
    want = []
    for r, ids in bags:
        used = [i for i in (ids or [])[:2] if i and i > 0]
        total = sum((vec(vectors, 1, i).astype(float) for i in used), np.zeros(WIDTH))
        want.append((r, (total / max(len(used), 1)).tolist()))
    want.sort()
    assert [r for r, _ in got] == [r for r, _ in want]
    assert np.allclose([v for _, v in got], [v for _, v in want])


@pytest.mark.parametrize("limit", [None, 0])
def test_concat_keeps_rows_that_repeat_a_key(spark, table, vectors, limit):
    df = spark.createDataFrame([(1, 2, 3), (1, 4, 5), (1, 4, 5)], "r bigint, a bigint, b bigint")
    got = embed.lookup_concat(df, ["r"], [(1, "a"), (2, "b")], table, WIDTH, limit=limit)
    assert got.columns == ["r", "a", "b", "vec"]
    rows = sorted((r["a"], r["vec"]) for r in got.collect())
    assert [a for a, _ in rows] == [2, 4, 4]
    for a, v in rows:
        assert np.allclose(v, np.concatenate([vec(vectors, 1, a), vec(vectors, 2, a + 1)]))


@pytest.mark.parametrize("limit, n_slots", [(None, 4), (0, 4), (None, 30)])
def test_bag_mean(spark, table, vectors, limit, n_slots):
    bags = [(0, [0, 0, 0, 0]), (1, [3, 3, 0, 5]), (2, [20, 21, 0, 0]), (3, []), (4, [1, 2, 3, 4])]
    padded = [(r, (b + [0] * n_slots)[:n_slots]) for r, b in bags]
    df = spark.createDataFrame(padded, "r bigint, ids array<bigint>")
    got = {r["r"]: r["vec"] for r in embed.bag_mean(df, ["r"], "ids", n_slots, 1, table, WIDTH, limit=limit).collect()}
    for r, ids in padded:
        used = [i for i in ids if i]
        want = sum((vec(vectors, 1, i).astype(float) for i in used), np.zeros(WIDTH)) / max(len(used), 1)
        assert np.allclose(got[r], want)


@pytest.mark.parametrize("limit", [None, 0])
def test_sequence_vectors(spark, table, vectors, limit):
    catalog = Catalog([Feature("seq", 1, "a", 15, domain="seq_a"), Feature("seq", 9, "z", 0, domain="seq_a"), Feature("seq", 2, "b", 99, domain="seq_a")])
    df = spark.createDataFrame([(1, [1, 20, 3, 4], [5], [0, 0]), (2, [], None, []), (3, None, [1], None)], "r bigint, a array<bigint>, b array<bigint>, z array<bigint>")
    got = {(r["r"], r["pos"]): r["vec"] for r in embed.sequence_vectors(df, catalog, "seq_a", ["r"], 3, table, WIDTH, limit=limit).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 0)}
    zero = np.zeros(WIDTH)
    assert np.allclose(got[1, 0], np.concatenate([vec(vectors, 1, 1), zero, vec(vectors, 2, 5)]))
    assert np.allclose(got[1, 1], np.concatenate([zero, zero, zero]))  # 20 is outside the vocabulary
    assert np.allclose(got[3, 0], np.concatenate([zero, zero, vec(vectors, 2, 1)]))


def test_broadcast_only_below_the_limit(spark, table):
    df = spark.createDataFrame([(1, 2)], "r bigint, i bigint")
    small = embed.lookup(df, "i", 1, table, WIDTH)._jdf.queryExecution().executedPlan().toString()
    large = embed.lookup(df, "i", 1, table, WIDTH, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small and "SortMergeJoin" in large
    assert embed.fits_broadcast(table, WIDTH) and not embed.fits_broadcast(table, WIDTH, 100)


def test_pooling_on_a_small_table_moves_no_rows(spark, table):
    df = spark.createDataFrame([(1, [1, 2])], "r bigint, ids array<bigint>").withColumn("r", F.col("r"))
    plan = embed.bag_mean(df, ["r"], "ids", 2, 1, table, WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_shuffled_pooling_adds_up_after_the_shuffle_only(spark, table, monkeypatch):
    df = spark.createDataFrame([(i, [1, 2, 3]) for i in range(10)], "r bigint, ids array<bigint>")
    plan = embed.bag_mean(df, ["r"], "ids", 3, 1, table, WIDTH, limit=0)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange hashpartitioning(_row")
    assert "partial_sum" in plan[:at] and "partial_sum" not in plan[at:]  # no map of sums in the tasks of the join
    monkeypatch.setattr(embed, "POOLED_IDS", 2)
    plan = embed.bag_mean(df, ["r"], "ids", 3, 1, table, WIDTH, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert ", 15), REPARTITION_BY_NUM" in plan  # tasks grow with the ids

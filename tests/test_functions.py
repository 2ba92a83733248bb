"""Edge rows of the column expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.functions import ids, scores
from featlake.functions.timebuckets import BUCKET_EDGES, N_BUCKETS, elapsed_bucket, event_buckets


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("value, expected", [(None, 0), (-1, 0), (0, 0), (7, 7), (8, 0)])
def test_scalar_ids(spark, value, expected):
    assert one(spark, "bigint", value, ids.in_vocab_or_zero("c", 8)) == expected
    assert one(spark, "bigint", value, ids.in_vocab_or_zero("c", 0)) == 0
    assert one(spark, "bigint", value, ids.positive_or_zero("c")) == max(value or 0, 0)


@pytest.mark.parametrize(
    "value, padded, used",
    [(None, [0, 0, 0, 0], 0), ([], [0, 0, 0, 0], 0), ([5, -1, None], [5, 0, 0, 0], 3), ([1, 2, 3, 4, 5], [1, 2, 3, 4], 4)],
)
def test_padding(spark, value, padded, used):
    assert one(spark, "array<bigint>", value, ids.pad_ids("c", 4)) == padded
    assert one(spark, "array<bigint>", value, ids.used_length("c", 4)) == used
    wide = one(spark, "array<bigint>", value, ids.pad_ids("c", 40))
    assert len(wide) == 40 and wide[:3] == (list(np.maximum([x or 0 for x in (value or [])], 0)) + [0] * 3)[:3]


@pytest.mark.parametrize("width", [3, 30])
def test_dense_padding_keeps_negatives(spark, width):
    assert one(spark, "array<float>", [-1.5], ids.pad_dense("c", width)) == [-1.5] + [0.0] * (width - 1)
    assert one(spark, "array<float>", None, ids.pad_dense("c", width)) == [0.0] * width
    assert one(spark, "array<float>", [1.0] * 50, ids.pad_dense("c", width)) == [1.0] * width


def test_zero_width(spark):
    assert one(spark, "array<bigint>", [1], ids.pad_ids("c", 0)) == []


@pytest.mark.parametrize("value, expected", [(None, 0), (1, 0), (2, 1)])
def test_label(spark, value, expected):
    assert one(spark, "int", value, ids.conversion_label("c")) == expected
    assert one(spark, "int", value, ids.conversion_label("c", with_label=False)) == 0


def test_mask_and_chunks(spark):
    assert one(spark, "int", 2, ids.padding_mask("c", 4)) == [False, False, True, True]
    assert one(spark, "array<float>", [1.0, 2.0, 3.0, 4.0, 5.0], ids.equal_chunks("c", 5, 2)) == [
        [1.0, 2.0, 3.0], [4.0, 5.0, 0.0]]
    assert one(spark, "array<bigint>", [1, 2, 3, 4], ids.segment("c", 1, 2)) == [2, 3]


def test_bucket_edges_are_63():
    assert len(BUCKET_EDGES) == 63 and N_BUCKETS == 64 and list(BUCKET_EDGES) == sorted(set(BUCKET_EDGES))


def test_buckets_equal_searchsorted(spark):
    edges = np.array(BUCKET_EDGES)
    seconds = sorted({0, 1, 10**9, *range(0, 700), *[int(e) + d for e in edges for d in (-1, 0, 1)]})
    expected = np.clip(np.searchsorted(edges, seconds), 0, len(edges) - 1) + 1
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint").select("s", elapsed_bucket("s").alias("b"))
    got = {r["s"]: r["b"] for r in df.collect()}
    assert [got[s] for s in seconds] == expected.tolist()


def test_bucket_list_edges(spark):
    df = spark.createDataFrame([(1000, [0, 2000, 995, 994, None, 1000])], "t bigint, l array<bigint>")
    assert df.select(event_buckets("t", "l", 8).alias("b")).first()["b"] == [0, 1, 1, 2, 0, 1, 0, 0]
    assert df.select(event_buckets("t", "l", 2).alias("b")).first()["b"] == [0, 1]
    assert df.select(event_buckets("t", F.lit(None).cast("array<bigint>"), 3).alias("b")).first()["b"] == [0, 0, 0]


def test_losses_at_large_logits(spark):
    for x in (-800.0, -1.0, 0.0, 1.0, 800.0):
        for y in (0, 1):
            row = spark.createDataFrame([(x, y)], "x double, y int").select(
                scores.sigmoid("x").alias("p"), scores.bce("x", "y").alias("b"), scores.focal("x", "y").alias("f"),
                scores.focal("x", "y", 0.5, 0.0).alias("half"),
            ).first()
            assert 0.0 <= row["p"] <= 1.0 and math.isfinite(row["b"]) and math.isfinite(row["f"])
            assert row["half"] == pytest.approx(row["b"] / 2)


def test_nan_logit_gives_nan(spark):
    assert math.isnan(one(spark, "double", float("nan"), scores.sigmoid("c")))

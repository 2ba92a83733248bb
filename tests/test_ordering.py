"""Ordered primitives: hot keys take the split path and give the same rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from featlake.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 12), rng.randrange(50), i, rng.randrange(1000) / 10) for i in range(600)]
    rows += [(None, rng.randrange(50), 1000 + i, 1.0) for i in range(80)]
    return spark.createDataFrame(rows, "key bigint, ts bigint, id bigint, value double").cache()


def test_global_index_is_dense_and_ordered(skewed):
    rows = ordering.global_index(skewed, ["ts", "id"]).select("_index", "ts", "id").collect()
    ordered = sorted((r["ts"], r["id"]) for r in rows)
    assert sorted(r["_index"] for r in rows) == list(range(len(rows)))
    assert all(ordered[r["_index"]] == (r["ts"], r["id"]) for r in rows)


@pytest.mark.parametrize("max_rows", [10, 37, 100, 10_000])
def test_bounded_groups_give_the_plain_window(skewed, max_rows):
    n = 5
    grouped, split = ordering.bounded_groups(skewed, ["key"], ["ts", "id"], n, max_rows)
    assert split == (max_rows < 10_000)
    frame = Window.partitionBy("key", ordering.CHUNK).orderBy("ts", "id").rowsBetween(-n, -1)
    got = grouped.withColumn("h", F.collect_list("id").over(frame)).filter(~F.col(ordering.CONTEXT))
    plain = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(-n, -1)
    want = skewed.withColumn("h", F.collect_list("id").over(plain))
    as_dict = lambda df: {r["id"]: r["h"] for r in df.select("id", "h").collect()}
    assert got.count() == skewed.count()
    assert as_dict(got) == as_dict(want)
    if split:
        biggest = grouped.groupBy("key", ordering.CHUNK).count().agg(F.max("count")).first()[0]
        assert biggest <= max_rows + n


@pytest.mark.parametrize("max_rows", [7, 60, 10_000])
def test_numbered(skewed, max_rows):
    got = {r["id"]: r["n"] for r in ordering.numbered(skewed, ["key"], ["ts", "id"], "n", max_rows).collect()}
    seen = {}
    for r in sorted(skewed.collect(), key=lambda r: (r["ts"], r["id"])):
        assert got[r["id"]] == seen.get(r["key"], 0)
        seen[r["key"]] = seen.get(r["key"], 0) + 1


def test_overlap_must_fit(skewed):
    with pytest.raises(ValueError):
        ordering.bounded_groups(skewed, ["key"], ["ts"], 10, 10)


def test_value_bins_ascend(skewed):
    rows = ordering.value_bins(skewed, "value", 9).select("value", "_bin").collect()
    ordered = sorted((r["value"], r["_bin"]) for r in rows)
    assert [b for _, b in ordered] == sorted(b for _, b in ordered)
    assert len({b for _, b in ordered}) > 1


def test_value_bins_of_nothing(skewed):
    assert ordering.value_bins(skewed.limit(0), "value").count() == 0


def test_running_totals(skewed):
    got = ordering.running_totals(skewed, "id", {"n_before": F.lit(1), "v_before": F.col("value")}).collect()
    n, v = 0, 0.0
    for row in sorted(got, key=lambda r: r["id"]):
        assert row["n_before"] == n and row["v_before"] == pytest.approx(v)
        n, v = n + 1, v + row["value"]


@pytest.mark.parametrize("n", [0, 1, 17, 300, 679, 680, 2000])
@pytest.mark.parametrize("descending", [True, False])
def test_select_first(skewed, n, descending):
    rows = skewed.select("ts", "id").collect()
    want = sorted(rows, key=lambda r: (-r["ts"] if descending else r["ts"], r["id"]))[:n]
    got = ordering.select_first(skewed, lambda _: n, [("ts", descending), ("id", False)]).collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in want)


def test_select_first_narrows_large_bins(skewed, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_GROUP_ROWS", 4)
    want = sorted((r["value"], r["id"]) for r in skewed.select("value", "id").collect())[:333]
    got = ordering.select_first(skewed, lambda n: 333, [("value", False), ("id", False)]).collect()
    assert sorted(r["id"] for r in got) == sorted(i for _, i in want)


def test_first_k_limits_before_the_shuffle(skewed):
    ranked = ordering.first_k(skewed, ["key"], [F.col("ts").desc(), F.col("id")], 3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert ranked.groupBy("key").count().agg(F.max("count")).first()[0] == 3


def test_a_value_that_fills_several_bins_has_its_own(spark):
    rows = [(k, 5.0) for k in range(900)] + [(1000 + k, 5.0 + k) for k in range(1, 60)] + [(2000 + k, -float(k)) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    bins = {}
    for r in ordering.value_bins(df, "v", 16).collect():
        bins.setdefault(r["_bin"], set()).add(r["v"])
    assert {5.0} in bins.values() and len(bins) >= 3


def test_select_first_cuts_a_bin_that_is_taken_whole(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_GROUP_ROWS", 3)
    df = spark.createDataFrame([(k, float(k)) for k in range(64)] + [(100 + k, 63.0) for k in range(50)], "id bigint, v double")
    for n in (1, 7, 32, 63, 64, 80, 113):
        got = sorted(r["id"] for r in ordering.select_first(df, lambda _: n, [("v", False), ("id", False)]).collect())
        assert got == [*range(64), *range(100, 150)][:n]

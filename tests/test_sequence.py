"""Sequence operators against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.operators import sequence
from featlake.plans import QUERIES


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 9), rng.randrange(60), i, rng.randrange(9)) for i in range(400)]
    return spark.createDataFrame(rows, "user bigint, ts bigint, id bigint, v bigint").cache()


def by_user(log):
    users = {}
    for r in sorted(log.collect(), key=lambda r: (r["ts"], r["id"])):
        users.setdefault(r["user"], []).append(r)
    return users


@pytest.mark.parametrize("max_rows", [9, 50, 10_000])
def test_history_with_and_without_hot_users(log, max_rows):
    n = 8
    got = sequence.build_history(log, ["user"], ["ts", "id"], {"vs": F.col("v"), "times": F.col("ts")}, n, max_rows)
    want = {r["id"]: rows[max(0, i - n):i] for rows in by_user(log).values() for i, r in enumerate(rows)}
    found = got.collect()
    assert len(found) == log.count()
    for r in found:
        assert r["vs"] == [x["v"] for x in want[r["id"]]] and r["times"] == [x["ts"] for x in want[r["id"]]]


@pytest.mark.parametrize("max_rows", [5, 10_000])
def test_gaps(log, max_rows):
    got = {r["id"]: r["gap"] for r in sequence.time_gap_features(log, ["user"], ["ts", "id"], "ts", max_rows).collect()}
    for rows in by_user(log).values():
        assert [got[r["id"]] for r in rows] == [-1] + [b["ts"] - a["ts"] for a, b in zip(rows, rows[1:])]


def test_latest_events(log):
    latest = sequence.latest_events(log, ["user"], ["ts", "id"], {"ids": F.col("id")}, 4)
    want = {user: [r["id"] for r in rows[-4:]] for user, rows in by_user(log).items()}
    assert {r["user"]: r["ids"] for r in latest.collect()} == want


@pytest.mark.parametrize("values, expected, positions", [
    ([1, 2, 3, 4, 5], [3, 4, 5], [2, 3, 4]), ([7], [0, 0, 7], [-2, -1, 0]), ([], [0, 0, 0], [-3, -2, -1])])
def test_latest_k_is_right_aligned(spark, values, expected, positions):
    df = spark.createDataFrame([(values,)], "c array<bigint>")
    row = df.select(
        sequence.latest_k("c", F.size("c"), 3).alias("v"), sequence.latest_positions(F.size("c"), 3).alias("p")).first()
    assert row["v"] == expected and row["p"] == positions


def test_domain_length_ignores_the_time_list(spark):
    catalog = Catalog([
        Feature("seq", 1, "a", 9, domain="seq_a"), Feature("seq", 2, "b", 9, domain="seq_a"),
        Feature("seq", 3, "c", 9, domain="seq_a"), Feature("seq", 4, "t", 9, domain="seq_a", is_ts=True)])
    df = spark.createDataFrame([([1] * 3, [1] * 5, [1] * 2, [1] * 9)], "a array<bigint>, b array<bigint>, c array<bigint>, t array<bigint>")
    assert df.select(sequence.domain_length(catalog, "seq_a", 4).alias("n")).first()["n"] == 4
    assert df.select(sequence.domain_length(catalog, "seq_a", 9).alias("n")).first()["n"] == 5
    long = sequence.stack_long(df.withColumn("sample", F.lit(1)), catalog, "seq_a", ["sample"], 4)
    assert long.count() == 12 and long.filter("slot = 2 and pos >= 2").agg(F.sum("id")).first()[0] == 0


def test_stats_against_counter(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(60)]
    rows = [(i, v, sorted(rng.randrange(100) for _ in v)) for i, v in enumerate(lists)]
    got = spark.createDataFrame(rows, "id int, v array<bigint>, t array<bigint>").select("id", *sequence.sequence_stats("v", "t"))
    for r in got.collect():
        _, v, t = rows[r["id"]]
        gaps = [b - a for a, b in zip(t, t[1:])]
        counts = Counter(v)
        assert r["n"] == len(v) and r["n_distinct"] == len(counts)
        assert r["mode"] == (min(counts, key=lambda x: (-counts[x], x)) if v else -1)
        assert r["min_gap"] == (min(gaps) if gaps else -1) and r["max_gap"] == (max(gaps) if gaps else -1)
        assert r["mean_gap"] == pytest.approx(sum(gaps) / len(gaps) if gaps else -1)


def test_list_mean(spark):
    df = spark.createDataFrame([([4, 0, 2, 9],), ([],), (None,)], "c array<bigint>")
    means = [r["m"] for r in df.select(sequence.list_mean("c", sequence.used_length("c", 3)).alias("m")).collect()]
    assert means == [2.0, 0.0, 0.0]


def ints(text):
    return [int(x) for x in text.split(",")] if text else []


def test_jitter(spark, sf_dir):
    rows = QUERIES["bucket_jitter"](spark, sf_dir).collect()
    again = QUERIES["bucket_jitter"](spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    moved = Counter()
    for r in rows:
        for a, b in zip(ints(r["buckets"]), ints(r["jittered"])):
            assert (a == 0) == (b == 0) and 0 <= b <= 63 and abs(a - b) <= 2
            moved[b - a] += 1
    assert set(moved) == {-2, -1, 0, 1, 2}


def test_dropout(spark, sf_dir):
    rows = QUERIES["position_dropout"](spark, sf_dir).collect()
    pairs = [(a, b) for r in rows for a, b in zip(ints(r["types"]), ints(r["dropped"]))]
    assert all(b in (a, 0) for a, b in pairs)
    dropped = sum(a != b for a, b in pairs) / len(pairs)
    assert 0.08 < dropped < 0.12
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["position_dropout"](spark, sf_dir).collect()))


def test_slot_means_equal_the_pooled_long_rows_without_a_shuffle(spark):
    rows = [(1, [3, 9, None, 2, 5], [1, 1]), (2, None, [7, 2]), (3, [], []), (4, None, None), (5, [4], [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "id bigint, a_seq_1 array<bigint>, a_seq_2 array<bigint>")
    catalog = Catalog(
        [
            Feature("seq", 1, "a_seq_1", 6, domain="seq_a"),
            Feature("seq", 2, "a_seq_2", 0, domain="seq_a"),
        ]
    )
    for catalog in (catalog, Catalog([Feature("seq", 2, "a_seq_2", 5, domain="seq_a")])):
        pooled = sequence.slot_means(df, catalog, "seq_a", ["id"], 3, "mean")
        long = sequence.stack_long(df, catalog, "seq_a", ["id"], 3)
        plan = pooled._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        got = {(r["id"], r["slot"]): r["mean"] for r in pooled.collect()}
        sums = {}
        for r in long.toDF("k", "pos", "slot", "value").collect():
            sums.setdefault((r["k"], r["slot"]), []).append(r["value"])
        assert got == {k: sum(v) / len(v) for k, v in sums.items()}

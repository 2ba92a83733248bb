"""Splits, batches and shuffles over key blocks and over row groups."""

import pytest
from pyspark.sql import functions as F

from featlake.operators import split
from featlake.plans import QUERIES
from featlake.plans.workflows import DEFAULT_SEQ_MAX_LENS, load_catalog, prediction_data, training_data
from featlake.sources import samples
from featlake.sources.samples import block_list, file_blocks, read_blocks, read_samples, row_group_blocks, row_groups


@pytest.mark.parametrize("n, ratio, train, expected", [
    (5, 0.1, 1.0, (4, 1)), (20, 0.1, 1.0, (18, 2)), (100, 0.29, 1.0, (72, 28)), (1, 0, 1.0, (1, 0)), (5, 0, 1.0, (4, 1)),
    (20, 0.1, 0.5, (9, 2)), (20, 0.1, 0.01, (1, 2))])
def test_sizes(n, ratio, train, expected):
    assert split.split_sizes(n, ratio, train) == expected


def test_a_single_block_cannot_be_split():
    with pytest.raises(ValueError):
        split.split_sizes(1, 0.1)


def blocked(spark, n=53, size=10, first=0):
    return spark.range(first, first + n).withColumn("block", F.floor(F.col("id") / size) * 7)


def test_split_is_disjoint_and_whole(spark):
    df = blocked(spark)
    train, valid = split.split_blocks(df, "block", "id", 0.4)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in valid.collect()}
    assert not a & b and a | b == set(range(53)) and min(b) == 40
    train, valid = split.split_blocks(df, "block", "id", 0.4, 0.5)
    assert train.count() == 20 and valid.count() == 13
    train, valid = split.split_blocks(df, "block", "id", 0.4, 0.5, "after_train")
    assert train.count() == 20 and valid.count() == 33
    with pytest.raises(ValueError):
        split.split_blocks(df, "block", "id", valid_from="head")


def test_split_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "b.parquet")
    blocked(spark).coalesce(1).write.parquet(path)
    train, _ = split.split_blocks(spark.read.parquet(path), "block", "id", 0.4)
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(block," in plan and "Join" not in plan


@pytest.mark.parametrize("max_rows", [3, 1000])
def test_batches(spark, max_rows):
    df = blocked(spark, 23, 10)
    batched = split.assign_batches(df, "block", "id", 4, max_rows)
    sizes = {(r["block"], r["batch"]): r["count"] for r in batched.groupBy("block", "batch").count().collect()}
    assert sizes == {(b, i): n for b, last in ((0, 10), (7, 10), (14, 3)) for i, n in enumerate([4, 4, 2] if last == 10 else [3])}
    assert split.batch_count(df, "block", 4).first()["n_batches"] == len(sizes) == 7


def test_shards(spark):
    got = split.shard_blocks(blocked(spark), "block", "id", 4).select("block", "shard").distinct().collect()
    assert {r["block"]: r["shard"] for r in got} == {0: 0, 7: 1, 14: 2, 21: 3, 28: 0, 35: 1}


def test_each_shard_gets_its_partition(spark):
    sharded = split.shard_blocks(blocked(spark), "block", "id", 4)
    placed = split.place_shards(sharded, "shard", 4)
    assert placed.rdd.getNumPartitions() == 4
    assert placed.filter(F.col("shard") != F.spark_partition_id()).count() == 0


@pytest.mark.parametrize("buffer", [1, 3])
def test_window_shuffle(spark, buffer):
    df = blocked(spark, 53, 10)
    one = split.window_shuffle(df, "block", "id", 4, buffer, seed=1)
    rows = one.collect()
    assert sorted(r["id"] for r in rows) == list(range(53))
    assert sorted(map(str, rows)) == sorted(map(str, split.window_shuffle(df, "block", "id", 4, buffer, seed=1).collect()))
    windows = {}
    for r in sorted(rows, key=lambda r: (r["window_id"], r["place"])):
        windows.setdefault(r["window_id"], []).append(r["id"])
    # Windows follow each other; rows only move inside them.
    assert [sorted(w) for w in windows.values()] == sorted(sorted(w) for w in windows.values())
    assert max(len(w) for w in windows.values()) <= 4 * buffer
    in_order = all(w == sorted(w) for w in windows.values())
    assert in_order == (buffer == 1)


def test_registered_shuffle_keeps_rows(spark, sf_dir):
    shuffled = QUERIES["window_shuffle"](spark, sf_dir)
    assert shuffled.select("event_id").distinct().count() == shuffled.count() == 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files; two of them with several row groups."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path_factory.mktemp("blocks")
    at = 0
    for name, n, size in (("b", 25, 10), ("a", 7, 10), ("c", 40, 20)):
        ids = list(range(at, at + n))
        at += n
        table = pa.table({
            "id": ids, "user_id": ids, "timestamp": [1000] * n, "label_type": pa.array([i % 3 for i in ids], pa.int32()),
            "user_int_feats_1": ids})
        pq.write_table(table, str(path / f"{name}.parquet"), row_group_size=size)
    (path / "notes.txt").write_text("not a sample file")
    (path / "schema.json").write_text('{"user_int": [[1, 1000, 1]], "item_int": [], "user_dense": [], "seq": {}}')
    return str(path)


def test_row_groups(spark, folder):
    rows = row_groups(spark, folder).collect()
    got = sorted((r["file"].rsplit("/", 1)[1], r["row_group"], r["n_rows"], r["first_row"]) for r in rows)
    assert got == [
        ("a.parquet", 0, 7, 0), ("b.parquet", 0, 10, 0), ("b.parquet", 1, 10, 10), ("b.parquet", 2, 5, 20),
        ("c.parquet", 0, 20, 0), ("c.parquet", 1, 20, 20)]
    per_file = {r["file"].rsplit("/", 1)[1]: r for r in file_blocks(row_groups(spark, folder), 4).collect()}
    assert [per_file[f"{n}.parquet"]["base"] for n in "abc"] == [0, 1, 4]
    assert [per_file[f"{n}.parquet"]["batch_base"] for n in "abc"] == [0, 2, 10]
    assert per_file["b.parquet"]["batches"] == [0, 3, 6]


def test_blocks_follow_row_groups(spark, folder):
    rows = read_blocks(spark, folder, batch_size=4).collect()
    # File a holds ids 25..31, file b 0..24, file c 32..71.
    expected = {i: (0, i - 25) for i in range(25, 32)}
    expected |= {i: (1 + i // 10, i % 10) for i in range(25)}
    expected |= {i: (4 + (i - 32) // 20, (i - 32) % 20) for i in range(32, 72)}
    assert {r["id"]: (r["block_index"], r["row_in_block"]) for r in rows} == expected
    assert {r["id"]: r["batch"] for r in rows}[20] == 2 + 6 and {r["id"]: r["batch"] for r in rows}[71] == 10 + 5 + 4
    part = read_blocks(spark, folder, 2, 5)
    assert sorted(r["block_index"] for r in part.select("block_index").distinct().collect()) == [2, 3, 4]
    assert read_blocks(spark, folder, 6, 9).count() == 0


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_samples(spark, str(tmp_path / "nothing"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        read_samples(spark, str(tmp_path / "empty"))


def test_training_data(spark, folder):
    catalog = load_catalog(spark, f"{folder}/schema.json")
    train, valid = training_data(spark, folder, catalog, batch_size=4, valid_ratio=0.34, buffer_batches=2)
    a, b = {r["user_id"] for r in train.collect()}, {r["user_id"] for r in valid.collect()}
    assert b == set(range(32, 72)) and a == set(range(32))
    windows = train.groupBy("window_id").count().collect()
    assert len(windows) == 5 and max(r["count"] for r in windows) <= 8
    assert train.select("shuffle_order").distinct().count() == 32
    test = prediction_data(spark, folder, catalog)
    assert test.count() == 72 and test.agg(F.max("label")).first()[0] == 0
    assert DEFAULT_SEQ_MAX_LENS == {"seq_a": 256, "seq_b": 256, "seq_c": 512, "seq_d": 512}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_range_is_a_filter_and_blocks_need_no_shuffle(spark, folder):
    blocks = block_list(spark, folder, 4)
    part = read_blocks(spark, folder, 2, 5, 4, blocks)
    plan = plan_of(part)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = sorted((r["block_index"], r["row_in_block"]) for r in part.collect())
    assert got == [(2, i) for i in range(10)] + [(3, i) for i in range(5)] + [(4, i) for i in range(20)]
    assert read_blocks(spark, folder, 3, 3).count() == 0
    assert read_blocks(spark, folder, 5, None, 4, blocks).count() == 20
    rows = {(r["file"].rsplit("/", 1)[1], r["row_group"]): (r["block_index"], r["batches_before"]) for r in row_group_blocks(blocks).collect()}
    assert rows["b.parquet", 2] == (3, 2 + 6) and rows["c.parquet", 1] == (5, 2 + 3 + 3 + 2 + 5)


def test_footers_of_a_store_that_only_spark_opens(spark, folder, monkeypatch):
    expected = sorted(map(tuple, row_groups(spark, folder).collect()))
    monkeypatch.setattr(samples, "OPENED_BY_TASKS", ())
    assert sorted(map(tuple, row_groups(spark, folder).collect())) == expected


def test_shuffled_batches_take_one_exchange(spark, folder):
    rows = read_blocks(spark, folder, batch_size=4)
    shuffled = split.shuffled_batches(rows, 4, 3, seed=1)
    assert plan_of(shuffled).count("Exchange hashpartitioning") == 1
    before = {r["id"]: r["batch"] for r in rows.collect()}
    found = shuffled.collect()
    assert sorted(map(str, found)) == sorted(map(str, split.shuffled_batches(rows, 4, 3, seed=1).collect()))
    assert all(r["window_id"] == before[r["id"]] // 3 and r["batch"] == r["place"] // 4 for r in found)
    windows = {}
    for r in found:
        windows.setdefault(r["window_id"], []).append((r["place"], r["id"]))
    assert all([p for p, _ in sorted(w)] == list(range(len(w))) for w in windows.values())
    assert any([i for _, i in sorted(w)] != sorted(i for _, i in w) for w in windows.values())
    in_order = split.shuffled_batches(rows, 4, 1).collect()
    assert all(r["window_id"] == before[r["id"]] and r["place"] == r["row_in_block"] % 4 for r in in_order)


def test_training_batches_are_cut_after_the_shuffle(spark, folder):
    catalog = load_catalog(spark, f"{folder}/schema.json")
    train, _ = training_data(spark, folder, catalog, batch_size=4, valid_ratio=0.34, buffer_batches=2)
    sizes = train.groupBy("window_id", "batch").count().collect()
    assert max(r["count"] for r in sizes) == 4 and {r["batch"] for r in sizes} == {0, 1}
    order = train.orderBy("window_id", "place").select("window_id", "shuffle_order").collect()
    assert order == sorted(order)


def test_shards_are_written_whole(spark, folder, tmp_path):
    out = str(tmp_path / "shards")
    for _ in range(2):  # a rerun replaces the first
        split.write_shards(read_blocks(spark, folder), 4, out)
    got = spark.read.parquet(out).groupBy("shard", "block_index").count().collect()
    assert {(r["shard"], r["block_index"]): r["count"] for r in got} == {(0, 0): 7, (1, 1): 10, (2, 2): 10, (3, 3): 5, (0, 4): 20, (1, 5): 20}

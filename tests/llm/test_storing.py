"""Intermediates leave no shuffle files behind; rows that a few keys don't name aren't shuffled."""

import time
from pathlib import Path

import corpus_pipeline as pipeline
from featlake.llm.common import apart
from featlake.session import STORING, storing, write_and_read
from pyspark.sql import functions as F


def _shuffle_files(root="/tmp"):
    return {str(p) for p in Path(root).glob("blockmgr-*/*/shuffle_*.data")}


def test_stored_rows_leave_no_shuffle_files(spark):
    before = _shuffle_files()
    counted = write_and_read(spark.range(20_000).groupBy(F.xxhash64("id").alias("h")).count(), "counted")
    assert counted.count() == 20_000 and counted.agg(F.sum("count")).first()[0] == 20_000
    left = counted.select("h").limit(0)
    assert left.count() == 0
    write_and_read(spark.range(20_000).groupBy(F.xxhash64("id").alias("g")).count(), "counted")
    for _ in range(50):
        new = {p for p in _shuffle_files() - before if Path(p).exists() and Path(p).stat().st_size > 50_000}
        if not new:
            break
        time.sleep(0.2)
    assert not new


def test_settings_are_the_sessions_own_again(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    with storing(spark):
        assert spark.conf.get(key) == STORING[key]
    assert spark.conf.get(key, None) == before


def test_apart_names_every_key_and_keeps_null(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(7, "again"), (None, "null")], "k int, t string")
    keys = spark.createDataFrame([(7,), (300,), (None,), (10_000,)], "k bigint")
    some, others = apart(rows, keys, "k")
    assert sorted((r.k, r.t) for r in some.collect()) == [(7, "again"), (7, "t7"), (300, "t300")]
    assert others.count() == 499 and others.where("k is null").count() == 1 and others.columns == ["k", "t"]
    some, others = apart(rows, keys.where("false"), "k")
    assert some.count() == 0 and others.count() == 502


def test_kept_documents_are_not_shuffled(spark, tmp_path, sf_dir):
    words = [f"w{i}x{j} " for i in range(12) for j in range(7)]
    rows = [(i, " ".join(words[(i * 5 + k * (i + 3)) % len(words)] + str(i) for k in range(30)), "en", "s", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (5, rows[5][1], "en", "s", 1), (5, rows[5][1], "en", "s", 1), (None, rows[3][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    placed = lambda df: df.select("doc_id", F.spark_partition_id().alias("p")).collect()
    place = {r.doc_id: r.p for r in placed(docs)}
    assert len(set(place.values())) > 1
    kept = placed(pipeline.near_duplicates(spark, docs, sf_dir))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in range(40)] + [(True, 0)]
    clean = placed(pipeline.decontamination(spark, docs, sf_dir))
    assert len(clean) == 44
    for found in (kept, clean):  # rows of a partition were together before
        assert len({(r.p, place[r.doc_id]) for r in found if r.doc_id != 5}) == len({r.p for r in found if r.doc_id != 5})

"""Cleaning projection, audit and their streaming form."""

import pytest
from pyspark.sql import functions as F

from featlake.catalog import Catalog, Feature
from featlake.operators import clean
from featlake.plans import tables as t
from featlake.sources.sinks import write_audit_report
from featlake.streaming.incremental import stream_model_input, write_available

CATALOG = Catalog(
    [
        Feature("user_int", 1, "user_int_feats_1", 8),
        Feature("user_int", 2, "user_int_feats_2", 9, 4),
        Feature("user_int", 3, "user_int_feats_3", 0),
        Feature("item_int", 5, "item_int_feats_5", 5),
        Feature("user_dense", 6, "user_dense_feats_6", -1, 3),
        Feature("seq", 38, "domain_a_seq_38", 10, domain="seq_a"),
        Feature("seq", 39, "domain_a_seq_39", 10**10, domain="seq_a", is_ts=True),
        Feature("seq", 40, "domain_a_seq_40", 10, domain="seq_a"),
        Feature("seq", 68, "domain_b_seq_68", 10, domain="seq_b"),
    ]
)
KIND = (
    "user_id bigint, timestamp bigint, label_type int, user_int_feats_1 bigint, user_int_feats_2 array<bigint>, "
    "user_int_feats_3 bigint, item_int_feats_5 bigint, user_dense_feats_6 array<float>, domain_a_seq_38 array<bigint>, "
    "domain_a_seq_39 array<bigint>, domain_a_seq_40 array<bigint>, domain_b_seq_68 array<bigint>"
)
ROWS = [
    (1, 1000, 2, 7, [1, 1, 1, 1, 99], 5, 1, [-1.5], [1, 2, 3], [995, 994, 0, 1, 1, 1, 1, 1, 1], [4, 5, 6, 11, 8], [1, 12]),
    (2, 1000, None, 8, [9, -1, None], 6, None, None, None, None, None, []),
    (3, 1000, 1, -1, None, None, 7, [1.0, 2.0, 3.0, 4.0], [], [], [10], None),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(ROWS, KIND).coalesce(1)


def test_model_input(samples):
    out = {r["user_id"]: r for r in clean.model_input(samples, CATALOG, {"seq_a": 4, "seq_b": 2}).collect()}
    a, b, c = out[1], out[2], out[3]
    assert (a["label"], b["label"], c["label"]) == (1, 0, 0)
    assert a["user_int_feats"] == [7, 1, 1, 1, 1, 0] and b["user_int_feats"] == [0, 0, 0, 0, 0, 0]
    assert c["user_int_feats"] == [0] * 6 and c["item_int_feats"] == [0]
    assert a["user_dense_feats"] == [-1.5, 0.0, 0.0] and c["user_dense_feats"] == [1.0, 2.0, 3.0]
    assert a["item_dense_feats"] == []
    assert a["seq_a"] == [[1, 2, 3, 0], [4, 5, 6, 0]] and a["seq_a_len"] == 4 and b["seq_a_len"] == 0
    assert a["seq_a_time_bucket"] == [1, 2, 0, 23]
    assert a["seq_b"] == [[1, 0]] and a["seq_b_time_bucket"] == [0, 0] and c["seq_b_len"] == 0


def test_inference_and_options(samples):
    out = clean.model_input(samples, CATALOG, with_label=False, time_buckets=False)
    assert out.agg(F.max("label")).first()[0] == 0
    assert "seq_a_time_bucket" not in out.columns
    assert out.select(F.size("seq_a")).first()[0] == 2
    assert out.select(F.size(F.get("seq_a", F.lit(0)))).first()[0] == 256
    with pytest.raises(ValueError):
        clean.model_input(samples, CATALOG, on_oob="drop")


def test_flatten_then_slice(samples):
    flat = samples.select(clean.flatten_group(samples, CATALOG, "user_int").alias("v"))
    width = {len(r["v"]) for r in flat.collect()}
    assert width == {CATALOG.total_dim("user_int")}
    back = [r["s"] for r in flat.select(clean.feature_segment(CATALOG, "user_int", 2, "v").alias("s")).collect()]
    assert back == [[1, 1, 1, 1], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_audit(samples, spark, tmp_path):
    audit = clean.oob_audit(samples, CATALOG, {"seq_a": 4, "seq_b": 2})
    found = {(r["grp"], r["column"]): (r["oob_count"], r["min_oob"], r["max_oob"], r["direction"]) for r in audit.collect()}
    assert found == {
        ("user_int", "user_int_feats_1"): (1, 8, 8, "TOO_HIGH"),
        ("user_int", "user_int_feats_2"): (1, 9, 9, "TOO_HIGH"),  # 99 lies past the cut
        ("item_int", "item_int_feats_5"): (1, 7, 7, "TOO_HIGH"),
        ("seq_a", "domain_a_seq_40"): (2, 10, 11, "TOO_HIGH"),
        ("seq_b", "domain_b_seq_68"): (1, 12, 12, "TOO_HIGH"),
    }
    write_audit_report(audit, str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    order = [tuple(reversed(line.split("):")[0].split(" ("))) for line in lines]
    assert len(lines) == 5 and order == sorted(order)
    assert "domain_a_seq_40 (seq_a): 2 ids from 10 to 11 are TOO_HIGH for a vocabulary of 10" in lines


def test_strict_mode_names_every_column(samples):
    with pytest.raises(ValueError) as error:
        clean.model_input(samples, CATALOG, {"seq_a": 4, "seq_b": 2}, on_oob="error")
    text = str(error.value)
    assert "user_int_feats_1" in text and "domain_b_seq_68" in text and "vocabulary ends at 7" in text
    good = samples.filter("user_id = -1")
    assert clean.model_input(good, CATALOG, on_oob="error").count() == 0


def test_cleaning_reads_only_its_columns(spark, samples, tmp_path):
    path = str(tmp_path / "s.parquet")
    samples.withColumn("unused", F.lit(1)).write.parquet(path)
    plan = clean.model_input(spark.read.parquet(path), CATALOG)._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "Exchange" not in plan


def test_stream_equals_batch(spark, samples, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    samples.write.parquet(source)
    stream = stream_model_input(spark, source, samples.schema, CATALOG)
    write_available(stream, out, str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(str, clean.model_input(samples, CATALOG).collect()))
    assert sorted(map(str, spark.read.parquet(out).collect())) == want
    samples.withColumn("user_id", F.col("user_id") + 10).write.mode("append").parquet(source)
    write_available(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2 * len(ROWS)


def test_audit_while_writing_equals_the_audit(samples):
    lens = {"seq_a": 4, "seq_b": 2}
    built, audit = clean.audited_input(samples, CATALOG, lens)
    assert sorted(map(tuple, audit.collect())) == sorted(map(tuple, clean.oob_audit(samples, CATALOG, lens).collect()))
    text = lambda df: sorted(map(str, df.collect()))
    assert text(built) == text(clean.model_input(samples, CATALOG, lens))
    empty, none = clean.audited_input(samples.limit(0), CATALOG, lens)
    assert empty.count() == 0 and none.count() == 0
    _, unaudited = clean.audited_input(samples, Catalog([Feature("user_int", 3, "user_int_feats_3", 0)]))
    assert unaudited.count() == 0


def test_padded_text_is_the_text_of_the_whole_list(spark):
    rows = [([1, 2, 0, 0], 2), ([0, 0, 0, 0], 0), ([0, 0, 0, 0], 2), ([1, 2, 3, 4], 4), ([1, 0, 5, 0], 1), ([1, 0, -5, 0], 1), ([1, 0], 1), ([], 0), (None, 0), ([7], 3)]
    df = spark.createDataFrame(rows, "a array<bigint>, n int")
    got = df.select(t.padded_text(F.col("a"), F.col("n"), 4).alias("x"), t.joined_text(F.col("a")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and got[0].x == "1,2,0,0"
    plan = df.select(t.padded_text(F.col("a"), F.col("n"), 4))._jdf.queryExecution().executedPlan().toString()
    assert "repeat(,0" in plan


def test_audited_input_is_read_back_whole(spark, sf_dir):
    wide = t.wide_samples(spark, sf_dir)
    built, _ = clean.audited_input(wide, t.CATALOG, t.SEQ_MAX_LENS, keep=["event_id"])
    plain = clean.model_input(wide, t.CATALOG, t.SEQ_MAX_LENS, keep=["event_id"])
    assert all(f.endswith(".orc") for f in built.inputFiles()) and built.schema.simpleString() == plain.schema.simpleString()
    assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()

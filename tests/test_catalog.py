"""Profiling, the catalog and its JSON forms, feature groups."""

import json

import pytest

from featlake.catalog import Catalog, Feature
from featlake.operators import embed, profile
from featlake.plans import workflows
from featlake.sources import catalog_json

DOCUMENT = {
    "user_int": [[1, 90, 1], [15, 45, 3], [62, 0, 2]],
    "item_int": [[11, 95, 2]],
    "user_dense": [[61, 4], [87, 2]],
    "seq": {
        "seq_b": {"prefix": "domain_b_seq", "ts_fid": 67, "features": [[67, 1000], [68, 6], [69, 3]]},
        "seq_a": {"prefix": "domain_a_seq", "ts_fid": None, "features": [[38, 6], [40, 80]]},
    },
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "schema.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    return catalog_json.read_catalog(spark, str(path)).cache()


def test_layout(parsed):
    rows = {r["column"]: r for r in parsed.collect()}
    assert [rows[f"user_int_feats_{f}"]["offset"] for f in (1, 15, 62)] == [0, 1, 4]
    assert rows["user_dense_feats_87"]["offset"] == 4 and rows["user_dense_feats_87"]["vocab"] == -1
    assert rows["domain_b_seq_67"]["is_ts"] and rows["domain_b_seq_67"]["slot"] == -1
    assert [rows[f"domain_b_seq_{f}"]["slot"] for f in (68, 69)] == [0, 1]
    assert rows["item_int_feats_11"]["dim"] == 2


def test_document_round_trip(spark, parsed, tmp_path):
    out = str(tmp_path / "out")
    catalog_json.write_catalog(parsed, out)
    text = spark.read.text(out).first()["value"]
    assert json.loads(text) == DOCUMENT


def test_layout_round_trip(parsed):
    rows = catalog_json.read_layout(catalog_json.layout_document(parsed, "user_int"), "doc").collect()
    assert [(r["fid"], r["offset"], r["length"]) for r in sorted(rows, key=lambda r: r["slot"])] == [
        (1, 0, 1), (15, 1, 3), (62, 4, 2)]


def test_python_catalog_agrees_with_dataframe(spark, parsed):
    catalog = Catalog.from_rows(parsed.collect())
    assert catalog.domains == ("seq_a", "seq_b")
    assert catalog.total_dim("user_int") == 6 and catalog.find("user_int", 62).offset == 4
    assert catalog.time_column("seq_a") is None and catalog.time_column("seq_b").fid == 67
    key = lambda r: (r["grp"], r["domain"], r["fid"])
    again = sorted(catalog.to_dataframe(spark).collect(), key=key)
    assert [tuple(r) for r in again] == [tuple(r) for r in sorted(parsed.collect(), key=key)]
    assert catalog.with_time_columns({"seq_a": 38}).time_column("seq_a").fid == 38
    with pytest.raises(KeyError):
        catalog.find("user_int", 5)


def test_inference_defaults(spark):
    rows = [(None, [], [1.0], None, 5), (-3, None, [1.0, 2.0], [7, -1], 9)]
    kind = "user_int_feats_9 bigint, user_int_feats_2 array<bigint>, user_dense_feats_4 array<float>, domain_c_seq_8 array<bigint>, item_int_feats_7 bigint"
    found = profile.infer_catalog(spark.createDataFrame(rows, kind + "")).collect()
    got = {r["column"]: (r["vocab"], r["dim"]) for r in found}
    assert got == {
        "user_int_feats_9": (100000, 1), "user_int_feats_2": (100000, 1), "item_int_feats_7": (10, 1),
        "user_dense_feats_4": (-1, 2), "domain_c_seq_8": (8, 1)}
    # Scalars are laid out before lists, whatever their ids.
    assert [r["fid"] for r in found if r["grp"] == "user_int"] == [9, 2]


def test_time_columns(spark):
    df = spark.createDataFrame([([1_700_000_000], [5])], "domain_a_seq_39 array<bigint>, domain_a_seq_40 array<bigint>")
    assert [(r["domain"], r["fid"]) for r in profile.detect_time_columns(df).collect()] == [("seq_a", 39)]


def test_pair_lengths(spark):
    rows = [([1], [1.0]), ([1], [1.0, 2.0]), (None, None), (None, [1.0])]
    df = spark.createDataFrame(rows, "user_int_feats_62 array<bigint>, user_dense_feats_62 array<float>")
    row = profile.aligned_pair_audit(df).first()
    assert (row["fid"], row["n_rows"], row["n_mismatched"]) == (62, 4, 2)


def test_groups(spark, parsed, tmp_path):
    path = tmp_path / "groups.json"
    path.write_text(json.dumps({"_note": "x", "user_ns_groups": {"U1": [15, 1], "_c": [7]}, "item_ns_groups": {"I1": [11]}}))
    groups = catalog_json.read_groups(spark, str(path))
    embed.require_known_groups(groups, parsed)
    rows = {(r["side"], r["group_name"], r["pos"]): r["position"] for r in embed.group_positions(groups, parsed).collect()}
    assert rows == {("user_int", "U1", 0): 1, ("user_int", "U1", 1): 0, ("item_int", "I1", 0): 0}
    bad = groups.unionByName(spark.createDataFrame([("item_int", "I1", 1, 999)], groups.schema))
    with pytest.raises(KeyError, match="item_int/I1: 999"):
        embed.require_known_groups(bad, parsed)
    assert embed.singleton_groups(parsed).count() == 4


def test_specs_and_triage(spark, parsed):
    specs = {r["fid"]: (r["vocab"], r["offset"], r["length"]) for r in embed.feature_specs(parsed).collect()}
    assert specs == {1: (90, 0, 1), 15: (45, 1, 3), 62: (0, 4, 2), 11: (95, 0, 2)}
    triage = {r["fid"]: r for r in embed.cardinality_triage(parsed, 80, 44, 40).collect()}
    assert 67 not in triage and 61 not in triage
    assert triage[62]["skipped"] and triage[1]["skipped"] and not triage[15]["skipped"]
    assert triage[15]["id_like"] and triage[15]["reset"] and not triage[1]["reset"]
    never = embed.cardinality_triage(parsed).collect()
    assert not any(r["reset"] for r in never) and [r["fid"] for r in never if r["skipped"]] == [62]


def test_slots_are_renumbered():
    catalog = Catalog([Feature("user_int", 3, "user_int_feats_3", 5, 2), Feature("user_int", 1, "user_int_feats_1", 5)])
    assert [(f.slot, f.offset) for f in catalog.features] == [(0, 0), (1, 2)]


@pytest.mark.parametrize("document, named", [("{not json", "MALFORMED"), ('{"user_int": []}', "group")])
def test_bad_catalog_documents_fail_loudly(spark, document, named):
    bad = spark.createDataFrame([(document,)], "doc string")
    with pytest.raises(Exception, match=f"(?i){named}"):
        catalog_json.parse_catalog(bad, "doc").collect()


def test_unknown_validation_choice_is_refused(spark):
    with pytest.raises(ValueError, match="valid_from"):
        workflows.training_data(spark, "/nowhere", None, valid_from="head")


def test_a_table_without_feature_columns_has_an_empty_catalog(spark):
    from featlake.operators import profile

    df = spark.createDataFrame([(1, 2)], "user_id bigint, other int")
    assert profile.infer_catalog(df).count() == 0 and profile.detect_time_columns(df).count() == 0
    assert profile.infer_catalog(df.withColumn("user_int_feats_1", profile.F.lit(3))).schema.names == profile.infer_catalog(df).schema.names


@pytest.mark.parametrize("bad", ["not json", "", '{"user_ns_groups": {"U1": "one"}}', '{"user_ns_groups": {"U1": [1, "x"]}}', '{"user_ns_groups": 7}'])
def test_a_bad_groups_document_raises(spark, bad):
    with pytest.raises(Exception, match="groups document|feature group|MALFORMED"):
        catalog_json.parse_groups(spark.createDataFrame([(bad,)], "doc string"), "doc").collect()


def test_notes_inside_a_side_of_any_type(spark):
    doc = '{"_note": 1, "user_ns_groups": {"_why": "text", "_n": {"a": 1}, "U1": [15, 1]}}'
    rows = catalog_json.parse_groups(spark.createDataFrame([(doc,)], "doc string"), "doc").collect()
    assert sorted(map(tuple, rows)) == [("user_int", "U1", 0, 15), ("user_int", "U1", 1, 1)]

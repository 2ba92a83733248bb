"""Stages against brute force on a small fixture; the whole pipeline on the smallest tables."""

import corpus_pipeline as pipeline


def test_stages_take_effect_and_keep_clean_rows(spark, sf_dir, docs, texts):
    kept = pipeline.language_id(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {4, 5, 6, 10} and kept.columns == pipeline.COLUMNS
    unique = pipeline.near_duplicates(spark, docs, sf_dir)
    assert {r.doc_id for r in unique.collect()} == set(texts) - {2, 3}
    cut = {r.doc_id: r for r in pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert 2 not in cut and cut[7].text == texts[7] and len(cut[8].text.split()) == len(texts[8].split()) - 45
    assert cut[8].n_chars == len(cut[8].text) and cut[14].text == texts[14]


def test_decontamination_drops_leaks_only(spark, sf_dir, docs, texts):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(500, f"before {item} after", "en", "s", 1)], docs.select(pipeline.COLUMNS).schema)
    found = pipeline.decontamination(spark, docs.select(pipeline.COLUMNS).unionByName(leak), sf_dir)
    assert {r.doc_id for r in found.collect()} == set(texts)


def test_run(spark, sf_dir):
    found = pipeline.run(spark, sf_dir)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)

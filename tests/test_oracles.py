"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    own = {name for name in QUERIES if name != "pipeline" and not name.startswith("op")}
    assert own - set(ORACLES) == {"bucket_jitter", "position_dropout", "window_shuffle", "score_samples"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 1000
    assert df.columns[:4] == ["event_id", "user_id", "timestamp", "label"]

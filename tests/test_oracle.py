"""Every registered query against its DuckDB oracle at the smallest scale; the rest must yield rows.

Queries are planned as at scale, that is without any table small enough to broadcast.
"""

import pytest

import __spark_entry__ as entry
from tests.oracle import EAGER, assert_scalable, connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
THRESHOLDS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
# The smallest scale has no series long enough to learn from in a back-test window.
MAY_BE_EMPTY = {"E16_rolling_origin_backtest_ml", "E16_rolling_origin_backtest_per_series"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def big(spark):
    for key in THRESHOLDS:
        spark.conf.set(key, "-1")
    yield spark
    for key in THRESHOLDS:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(big, duck, name):
    df = QUERIES[name](big, FOLDER)
    if not EAGER.match(name):
        assert_scalable(df)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Queries over daily bars of which some don't move, against their SQL."""

import math
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

DAY_MS = 86_400_000


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """One series with the same close and volume on all days, one with the same close, one with the same volume, one that moves."""
    start, rows = datetime(2023, 12, 1), []
    for day in range(75):
        c, v = 100 + 9 * math.sin(day * day), 50 + 20 * math.cos(3.0 * day * day)
        for symbol, close, volume in (("F", 5.0, 7.0), ("C", 5.0, v), ("V", c, 7.0), ("M", c, v)):
            at = start + timedelta(days=day)
            rows.append((symbol, "1d", (19_692 + day) * DAY_MS, at, close, close, close, close, volume, at))
    folder = tmp_path_factory.mktemp("flat")
    spark.createDataFrame(rows, "symbol string, tf string, ts_ms long, ts timestamp, o double, h double, l double, c double, v double, recv_ts timestamp").write.parquet(f"{folder}/bars.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["yearly_features", "roll_corr_beta"])
def test_as_the_sql(spark, flat, name):
    n, m, extra, missing = compare(spark, entry.queries()[name], entry.oracle_sql()[name], flat)
    assert n == m > 0 and not extra and not missing

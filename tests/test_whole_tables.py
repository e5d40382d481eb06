"""Queries that read all rows of their tables, whatever unit, year or group these are of."""

from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare
from tidemill.operators import joins, stats


@pytest.mark.parametrize("name", ["bh_stepup", "asof_backward", "asof_strict_recent", "thin_hourly", "time_slice", "unpivot_years", "config_subsets"])
def test_whole_table(spark, name):
    n, m, extra, missing = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert n == m > 0 and not extra and not missing


def test_ranks_across_ranges(spark):
    t = spark.range(5000).select("id", (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000).alias("p")).unionByName(spark.createDataFrame([(-1, None)], "id long, p double"))
    got = stats.benjamini_hochberg(t, "p", 0.5, key=["id"]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["id"] for r in sorted(got, key=lambda r: (r["p"], r["id"]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


def test_asof_over_a_gap(spark):
    left = spark.createDataFrame([("a", 5), ("a", 9), ("b", 9)], "symbol string, hour long")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 5, 2.0)], "symbol string, hour long, c double")
    rows = lambda df: sorted(map(tuple, df.select("symbol", "hour", "c").collect()))
    assert rows(joins.asof_backward(left, right, ["symbol"], "hour", ["c"])) == [("a", 5, 2.0), ("a", 9, 2.0), ("b", 9, None)]
    assert rows(joins.asof_backward(left, right, ["symbol"], "hour", ["c"], strict=True, lookback=3)) == [("a", 5, 1.0), ("a", 9, None), ("b", 9, None)]


@pytest.mark.parametrize("name", ["thin_hourly", "time_slice"])
def test_runs_in_other_units(spark, name):
    runs = duckdb.sql(f"SELECT count(DISTINCT (sim_id, v)) FROM '{SMALL}/ma_hourly.parquet'").fetchall()[0][0]
    assert entry.queries()[name](spark, SMALL).select("sim_id", "v").distinct().count() == runs


def test_all_subsets(spark):
    got = entry.queries()["config_subsets"](spark, SMALL).select("size", "first", "last", "total").collect()
    want = [(n, c[0], c[-1], sum(c)) for n in (2, 3, 4, 5) for c in combinations(range(25), n)]
    assert sorted(map(tuple, got)) == sorted(want)

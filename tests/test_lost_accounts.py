"""Ensembles of configurations of which some lose all in their first year, against the SQL."""

import random
from datetime import datetime

import __spark_entry__ as entry
from tests.oracle import compare

YEARS = [f"y{k}" for k in range(2018, 2027)]


def test_all_lost_in_the_first_year(spark, tmp_path):
    rnd, rows = random.Random(5), []
    for cfg in range(12):
        years = [round(rnd.gauss(0.1, 0.3), 4) for _ in YEARS]
        if cfg in (3, 7):
            years[0] = -1.0
        rows.append((cfg, *years, float(cfg), datetime(2024, 1, 1)))
    rows[5] = (5, None, -1.0, *rows[5][3:])
    rows[8] = (8, *rows[8][1:6], -1.0, *rows[8][7:])  # in the first of the later years
    spark.createDataFrame(rows, "cfg long, " + ", ".join(f"{y} double" for y in YEARS) + ", port_DD double, run_ts timestamp").write.parquet(f"{tmp_path}/config_year_matrix.parquet")
    n, m, extra, missing = compare(spark, entry.queries()["exhaustive_ensembles"], entry.oracle_sql()["exhaustive_ensembles"], str(tmp_path))
    assert n == m > 0 and not extra and not missing

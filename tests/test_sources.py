"""Readers, sinks and resumption, on files made here."""

import gzip
import json
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources import files, paged


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: [(x is None, x) for x in t])


def test_npz_with_and_without_optional_arrays(spark, tmp_path):
    ts = np.array([3, 1, 2]) * 60_000
    np.savez(tmp_path / "AAA_1m.npz", ts=ts, o=[1.0, 2, 3], h=[2.0, 3, 4], l=[0.5, 1, 2], c=[1.5, 2.5, 3.5], v=[9, 8, 7])
    np.savez(tmp_path / "BB_60m.npz", ts=ts[:1], h=[2.0], l=[0.5], c=[1.5])
    got = rows(files.read_npz(spark, str(tmp_path)), "symbol", "tf", "ts_ms", "o", "v")
    assert got == [("AAA", "1m", 60_000, 2.0, 8.0), ("AAA", "1m", 120_000, 3.0, 7.0), ("AAA", "1m", 180_000, 1.0, 9.0), ("BB", "60m", 180_000, 1.5, 0.0)]


def test_zipped_klines_with_header_and_microseconds(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ABC-1m-2024-01.zip", "w") as z:
        z.writestr("a.csv", "open_time,open,high,low,close,volume\n1700000000000,1,2,0.5,1.5,10,x\n")
        z.writestr("b.csv", "1735689600000000,2,3,1,2.5,11,x\n")
    assert rows(files.read_zip_klines(spark, str(tmp_path)), "symbol", "ts_ms", "c") == [("ABC", 1700000000000, 1.5), ("ABC", 1735689600000, 2.5)]
    assert files.months(date(2023, 11, 5), date(2024, 2, 1)) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]


def test_log_keeps_file_order_quotes_and_types(spark, tmp_path):
    head = ",".join(files.LOG_COLUMNS)
    lines = [head, '5,Execute,BUY,1.5,2,,,100,,,,,"a, b",x,3', "5,OpenOrder,BUY,1,2,,,100,,,,,l,x,3", "4,Close Position,SELL,bad,2,,,,,,,,l,,", "short,row", "6,StopLoose,,1,2,,,7,,,,"]
    for name in ("AbC_v3_log.csv.gz", "AbC_v4_log.csv"):
        data = "\n".join(lines).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    got = files.read_log(spark, str(tmp_path))
    assert rows(got.where("v = 3"), "sim_id", "row_no", "timestamp", "event_type", "price", "candle_level", "ma") == [("AbC", 1, 5, "Execute", 1.5, "a, b", 3.0), ("AbC", 3, 4, "Close Position", None, "l", None), ("AbC", 5, 6, "StopLoose", 1.0, None, None)]
    assert rows(got.where("v = 3"), "row_no", "balance") == rows(got.where("v = 4"), "row_no", "balance")
    assert files.read_log(spark, str(tmp_path), None).where("event_type = 'OpenOrder'").count() == 2


def test_quotes_in_local_time(spark, tmp_path):
    (tmp_path / "^GSPC_1d.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-07-02 00:00:00-04:00,1,2,0.5,2.5,\n2024-01-04,1,,0.5,1.5,10\n")
    got = rows(files.read_equities(spark, str(tmp_path), "1d", "America/New_York"), "symbol", "ts_ms", "c", "v")
    assert got == [("GSPC", 1704171600000, 1.5, 10.0), ("GSPC", 1719892800000, 2.5, 0.0)]


def test_sentiment(spark, tmp_path):
    (tmp_path / "fg.json").write_text(json.dumps({"name": "x", "data": [{"timestamp": "86400", "value": "40"}, {"timestamp": "90000", "value": "44"}, {"timestamp": 172800, "value": 50}, {"timestamp": "x", "value": "1"}]}))
    assert rows(files.read_sentiment(spark, str(tmp_path)), "day", "value") == [(1, 44.0), (2, 50.0)]


def test_tagged_csv(spark, tmp_path):
    for s in ("one", "two"):
        (tmp_path / f"{s}_positions.csv").write_text("a,b\n1,x\n2,\n")
    assert rows(files.read_tagged_csv(spark, str(tmp_path), "a int, b string", r"^(.*)_positions"), "series", "a", "b") == [("one", 1, "x"), ("one", 2, None), ("two", 1, "x"), ("two", 2, None)]


def test_configurations_under_other_names(spark):
    df = spark.createDataFrame([("2000", 0.1, 9, 1.0, 0.008, 2, 5.0), ("2600", 0.2, 3, 2.0, 0.01, 1, 9.0)], "longSMA string, tp_difference double, tp_count int, leverage double, SL double, stopLooseTP int, score double")
    got = files.resolve_configs(df, [F.col("score").desc()], 1).collect()
    assert [r.asDict() for r in got] == [{"w": 2600, "tpd": 0.2, "ntp": 3, "lev": 2.0, "stop": 0.01, "sltp": 1, "maxdist": None}]
    with pytest.raises(ValueError):
        files.resolve_configs(df.drop("leverage"))


def test_sinks_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0.1), (2, None, None)], "k int, t string, x double")
    files.write_json(df, f"{tmp_path}/j", True)
    files.write_csv(df, f"{tmp_path}/c")
    assert rows(spark.read.schema(df.schema).json(f"{tmp_path}/j"), "k", "t", "x") == rows(df, "k", "t", "x") == rows(spark.read.schema(df.schema).csv(f"{tmp_path}/c", header=True), "k", "t", "x")


def test_resumption(spark, tmp_path):
    work, place = spark.createDataFrame([(k,) for k in range(6)], "cfg int"), f"{tmp_path}/done"
    assert files.resume(work, place, ["cfg"]).count() == 6
    files.append(spark.createDataFrame([(1, 2.0), (1, 2.0), (4, 1.0)], "cfg int, score double"), place)
    assert rows(files.resume(work, place, ["cfg"]), "cfg") == [(0,), (2,), (3,), (5,)]


def test_report(spark):
    text = files.report(spark.createDataFrame([("a|b", 1.23456, None)], "n string, x double, y int"), "Runs")
    assert text.splitlines() == ["# Runs", "", "| n | x | y |", "|---|---|---|", "| a\\|b | 1.235 |  |"]


def test_paged_source_reads_each_window_once_and_the_later_page_wins(spark, tmp_path):
    (tmp_path / "AAA_1.json").write_text(json.dumps([[0, 1, 2, 0, 1, 5], [60_000, 1, 2, 0, 1, 5], [120_000, 1, 2, 0, 1, 5]]))
    (tmp_path / "AAA_2.json").write_text(json.dumps([[60_000, 9, 9, 9, 9, 9], [600_000, 1, 1, 1, 1, 1]]))
    spark.dataSource.register(paged.PagedBars)
    df = spark.read.format("paged_bars").options(symbols="AAA, BBB", from_ms="0", to_ms="180000", bar_ms="60000", page="2", folder=str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 4
    assert rows(df, "symbol", "ts_ms", "c") == [("AAA", 0, 1.0), ("AAA", 60_000, 9.0), ("AAA", 120_000, 1.0)]


def test_sql_functions(spark):
    from tidemill.functions import udfs

    udfs.register(spark)
    assert spark.sql("SELECT correlation_p(0.5D, 30D) AS p").first()["p"] == pytest.approx(0.00489, abs=2e-4)
    got = spark.sql("SELECT * FROM sobol_points(0, 4, 3, 0)").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3] and all(len(r["u"]) == 3 for r in got)



"""Streams over files: late ticks, bars that go out once, crossings, and a sink that redelivery doesn't change."""

from datetime import datetime, timedelta

import pytest

from tidemill.streaming import bars as sb

T0 = datetime(2024, 1, 1)
KIND = "symbol string, ts timestamp, seq long, price double"


def tick(minutes, price, symbol="a", seq=0):
    return (symbol, T0 + timedelta(minutes=minutes), seq, float(price))


@pytest.fixture
def folder(spark, tmp_path):
    """Ticks in files that come in their order."""

    def write(*parts):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            import os
            import time

            files = [f"{tmp_path}/in/{f}" for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")]
            newest = max(files, key=os.path.getmtime)
            os.utime(newest, (time.time() - 1000 + k, time.time() - 1000 + k))
        return sb.tick_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], KIND).schema, files_per_trigger=1)

    return write


def test_bars_go_out_once_and_late_ticks_are_dropped(folder, tmp_path):
    # a tick is late against the watermark of the trigger before the last one
    stream = folder([tick(0, 1), tick(5, 3), tick(14, 2)], [tick(40, 9)], [tick(42, 8.5)], [tick(1, 99), tick(41, 8)], [tick(90, 7)])
    got = sb.run_once(sb.windowed_ohlcv(stream, "15 minutes", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    rows = sorted((r["start_ms"], r["o"], r["h"], r["l"], r["c"], r["n"]) for r in got.collect())
    first = int(T0.timestamp() * 1000)
    assert [r[1:] for r in rows] == [(1.0, 3.0, 1.0, 2.0, 3), (9.0, 9.0, 8.0, 8.5, 3)]
    assert rows[1][0] - rows[0][0] == 30 * 60_000 and first % 1000 == 0


def test_a_second_run_goes_on_where_the_first_was(folder, tmp_path):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stream = folder([tick(0, 1), tick(60, 2)])
    assert sb.run_once(sb.windowed_ohlcv(stream, "15 minutes", "10 minutes"), out, state).count() == 1
    stream = folder([tick(120, 3)])
    assert sb.run_once(sb.windowed_ohlcv(stream, "15 minutes", "10 minutes"), out, state).count() == 2


def test_crossings_match_those_of_the_whole_series(spark, tmp_path):
    import random

    rnd, c, rows = random.Random(3), 100.0, []
    for k in range(200):
        c *= 1 + rnd.gauss(0, 0.01)
        rows.append(("a", k, c * 1.004, c * 0.996, c))
    kind = "symbol string, ts_ms long, h double, l double, c double"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * (k + 1)] + rows[:1], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(f"{tmp_path}/in")
    got = sorted((r["ts_ms"], r["signal"]) for r in sb.run_once(sb.crossings(stream, 10), f"{tmp_path}/out", f"{tmp_path}/state").collect())
    want, held = [], None
    for k in range(10, 200):
        ma = sum(r[4] for r in rows[k - 10 : k]) / 10
        now = rows[k][3] <= ma <= rows[k][2]
        if held and not now:
            want.append((k, 1 if rows[k][4] > ma else -1))
        held = now
    assert got == want and len(want) > 5


def test_sessions(spark):
    got = sb.sessions(spark.createDataFrame([tick(0, 1), tick(10, 1), tick(60, 1), tick(0, 1, "b")], KIND), "30 minutes").collect()
    assert sorted((r["symbol"], r["n"], (r["end_ms"] - r["begin_ms"]) // 60_000) for r in got) == [("a", 1, 0), ("a", 2, 10), ("b", 1, 0)]


def test_redelivery_counts_nothing_twice(spark, tmp_path):
    kind = "sim string, idx int, at int, score double"
    write = sb.upsert(f"{tmp_path}/t", ["sim", "idx"], "at")
    first = spark.createDataFrame([("s", 1, 1, 0.5), ("s", 1, 2, 0.7), ("s", 2, 1, None)], kind)
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([("s", 1, 1, 9.0), ("s", 3, 1, 0.1)], kind), 1)
    got = sorted(tuple(r[c] for c in ("sim", "idx", "at", "score")) for r in sb.read_latest(spark, f"{tmp_path}/t", ["sim", "idx"], "at").collect())
    assert got == [("s", 1, 2, 0.7), ("s", 2, 1, None), ("s", 3, 1, 0.1)]

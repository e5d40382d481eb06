"""Indicators by hand, from their definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, flags, grids, learn, smoothing
from tidemill.operators.windows import Frames

KEYS = ["symbol"]


def series(spark, closes, spread=1.0):
    rows = [("a", k, k, float(c), c + spread, c - spread, float(c), float(k + 1)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, _rn long, day long, o double, h double, l double, c double, v double")


def by_row(df, *columns):
    return {r["_rn"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def walk(n, seed=1):
    rnd, out = random.Random(seed), [100.0]
    while len(out) < n:
        out.append(out[-1] * math.exp(rnd.gauss(0, 0.02)))
    return out


def wilder(x, n):
    """x[0] is the first difference; result by place in x."""
    out = {n - 1: sum(x[:n]) / n}
    for k in range(n, len(x)):
        out[k] = (out[k - 1] * (n - 1) + x[k]) / n
    return out


def test_wilder_seed_is_the_mean_of_the_first_differences(spark):
    got = by_row(smoothing.wilder(series(spark, range(1, 31)).withColumn("x", F.when(F.col("_rn") > 0, F.col("c"))), KEYS, {"s": "x"}, 14), "s")
    assert all(got[k] is None for k in range(14))
    assert got[14] == pytest.approx(sum(range(2, 16)) / 14) and got[15] == pytest.approx((sum(range(2, 16)) / 14 * 13 + 16) / 14)


def test_rsi_and_adx(spark):
    c = walk(80)
    df = smoothing.rsi_wilder(smoothing.adx(series(spark, c), KEYS), KEYS)
    got = by_row(df, "atr", "rsi", "adx")
    d = [b - a for a, b in zip(c, c[1:])]
    up, down = wilder([max(x, 0) for x in d], 14), wilder([max(-x, 0) for x in d], 14)
    tr = wilder([max(b + 1, a) - min(b - 1, a) for a, b in zip(c, c[1:])], 14)
    plus, minus = wilder([x if x > 0 else 0 for x in d], 14), wilder([-x if x < 0 else 0 for x in d], 14)
    dx = [abs(plus[k] - minus[k]) / (plus[k] + minus[k]) * 100 if k >= 13 else 0.0 for k in range(len(d))]
    adx = wilder(dx, 14)
    for row in (14, 15, 40, 79):
        k = row - 1
        assert got[row] == pytest.approx((tr[k], 100 - 100 / (1 + up[k] / down[k]), adx[k]))
    assert got[13] == (None, None, None)


@pytest.mark.parametrize("adjusted", [True, False])
def test_exponential_means(spark, adjusted):
    c = walk(700)
    got = by_row((smoothing.ewm_adjusted if adjusted else smoothing.ewm)(series(spark, c), KEYS, "c", 12, "e"), "e")
    q, num, den, e = 11 / 13, 0.0, 0.0, c[0]
    for k, x in enumerate(c):
        num, den = num * q + x, den * q + 1
        e = e if k == 0 else e * q + x * (1 - q)
        if k in (0, 1, 5, 255, 256, 257, 699):
            assert got[k] == pytest.approx(num / den if adjusted else e, rel=1e-10)


def test_rank_across_blocks(spark):
    rnd = random.Random(2)
    x = [rnd.choice([None, *range(6)]) if k in (40, 41) else float(rnd.randrange(6)) for k in range(120)]
    df = spark.createDataFrame([("a", k, None if v is None else float(v)) for k, v in enumerate(x)], "symbol string, _rn long, x double")
    got = by_row(blocks.rank_pct(df, KEYS, "x", 10, "p", block=32), "p")
    for k in range(120):
        w = x[k - 9 : k + 1]
        want = None if k < 9 or None in w else (sum(v < x[k] for v in w) + (sum(v == x[k] for v in w) + 1) / 2) / 10
        assert got[k] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("p", [0.0, 0.2, 1 / 3, 0.5, 0.8, 1.0])
def test_growing_quantile(p):
    import numpy as np

    rnd, held, q = random.Random(3), [], blocks.Quantile(p)
    for _ in range(300):
        held.append(rnd.choice([rnd.random(), float(rnd.randrange(4))]))
        q.add(held[-1])
        assert q.value() == pytest.approx(np.quantile(held, p))


def test_expanding_quantile_leaves_out_nulls_and_the_row_itself(spark):
    x = [None, 1.0, 3.0, float("nan"), 2.0, 5.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "symbol string, _rn long, x double")
    assert by_row(blocks.expanding_quantiles(df, KEYS, "_rn", "x", {"m": 0.5}, 2), "m") == {0: None, 1: None, 2: None, 3: 2.0, 4: 2.0, 5: 2.0}
    assert by_row(blocks.expanding_quantiles(df, KEYS, "_rn", "x", {"m": 0.5}, 2, inclusive=True), "m")[5] == 2.5


def test_fills_go_on_over_chunks(spark):
    x = [None, 1.0, None, None, 4.0] + [None] * 20
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)] + [("b", 3, None)], "symbol string, _rn long, x double")
    got = {(r["symbol"], r["_rn"]): r["x"] for r in blocks.filled(df, KEYS, "_rn", ["x"], chunk=4).collect()}
    assert got["a", 0] is None and got["a", 3] == 1.0 and got["a", 24] == 4.0 and got["b", 3] is None


def test_a_block_gives_what_the_series_gives(spark):
    df = series(spark, walk(300))
    whole = by_row(df.withColumn("m", Frames(KEYS).mean(F.col("c"), 20)), "m")
    cut = by_row(blocks.windowed(df, KEYS, 20, lambda d, by: d.withColumn("m", Frames(by).mean(F.col("c"), 20)), block=64), "m")
    assert cut.keys() == whole.keys() and all(cut[k] == (None if whole[k] is None else pytest.approx(whole[k])) for k in whole)


def test_simple_rsi_needs_all_its_differences(spark):
    df = series(spark, walk(40)).withColumn("d", F.col("c") - F.lag("c").over(Frames(KEYS).by))
    got = by_row(df.withColumn("r", Frames(KEYS).rsi_simple("d", 14)), "r")
    assert got[13] is None and got[14] is not None


# ---- points --------------------------------------------------------------------------------------------------------------


def test_points_cover_the_cube(spark):
    import numpy as np

    u = np.array([r["u"] for r in grids.sobol(spark, 8192, 25, seed=7).collect()])
    cells = (u * 16).astype(int)
    for i in range(25):
        assert len(np.unique((u[:, i] * 8192).astype(int))) == 8192
        for j in range(i):
            assert len(np.unique(cells[:, i] * 16 + cells[:, j])) == 256
    with pytest.raises(ValueError):
        grids.sobol_points(np.arange(4), 26)


# ---- flags ---------------------------------------------------------------------------------------------------------------


def test_flags_of_an_engineered_series(spark):
    c = [100.0] * 30 + [94.0, 94.0, 101.0, 101.0, 101.0]
    rows = [("a", k, k, 100.0 if k != 32 else 93.0, max(c[k], 100.5), min(c[k], 99.0), c[k], 10.0 if k != 32 else 40.0) for k in range(len(c))]
    d = spark.createDataFrame(rows, "symbol string, _rn long, day long, o double, h double, l double, c double, v double")
    levels = spark.createDataFrame([("a", [101.2])], "symbol string, levels array<double>")
    got = {r["day"]: r for r in flags.daily_flags(d, levels).collect()}
    assert got[31]["dip5"] and not got[30]["dip5"] and not got[32]["dip5"]
    assert got[33]["breakout_highvol"] and not got[33]["breakout_lowvol"] and not got[32]["breakout_highvol"]
    assert got[33]["round_number"] and not got[32]["round_number"]
    assert not got[10]["bb_lower"] and got[31]["bb_lower"]
    assert set(flags.TECHNICAL) | set(flags.AFTER) | set(flags.CALENDAR) <= set(got[0].asDict())


def test_windows_after_events_go_by_days(spark):
    days = [*range(20), 40, 41]
    rows = [("a", k, d, 1.0, 1.0, 1.0, 1.0, 1.0) for k, d in enumerate(days)]
    d = spark.createDataFrame(rows, "symbol string, _rn long, day long, o double, h double, l double, c double, v double")
    x = d.withColumn("e", F.col("day") == 19).withColumn("near", Frames(KEYS, "day").after_event(F.col("e"), 20)).withColumn("later", Frames(KEYS, "day").after_event(F.col("e"), 21, False))
    got = {r["day"]: (r["near"], r["later"]) for r in x.collect()}
    assert got[19] == (True, False) and got[40] == (False, True) and got[18] == (False, False)


def test_outside_calendar_and_sessions(spark):
    d = series(spark, [1.0, 2.0, 3.0])
    got = {r["day"]: r["event_w"] for r in flags.daily_flags(d, spark.createDataFrame([], "symbol string, levels array<double>"), events=spark.createDataFrame([(1,), (1,)], "day long")).collect()}
    assert got == {0: False, 1: True, 2: False}
    s = spark.createDataFrame([(h * 3_600_000,) for h in (0, 7, 8, 12, 13, 20, 21)], "ms long").select(flags.session_of_day(F.col("ms")).alias("s"))
    assert [r["s"] for r in s.collect()] == ["asia", "asia", "other", "other", "us", "us", "other"]


def test_calendar_days(spark):
    days = {"2019-07-03": "pre_holiday", "2019-11-27": "pre_holiday", "2019-05-26": "pre_holiday", "2019-09-01": "pre_holiday", "2019-12-28": "santa", "2019-03-29": "opex_friday", "2000-01-07": "new_moon_pm3", "2021-01-01": "halving_yr1"}
    df = spark.createDataFrame([(k,) for k in days], "d string").select("d", *(v.alias(k) for k, v in flags.calendar_flags(F.to_date("d")).items()))
    for r in df.collect():
        assert r[days[r["d"]]], r["d"]
    late = spark.createDataFrame([("2026-07-03",)], "d string").select(flags.calendar_flags(F.to_date("d"))["pre_holiday"].alias("x")).first()["x"]
    assert not late


# ---- panels --------------------------------------------------------------------------------------------------------------


def test_hourly_panel_sees_nothing_later(spark):
    rnd = random.Random(4)
    rows = [("r", 0, k * 3_600_000 + rnd.randrange(3_000_000), 100 + rnd.random(), 100.0) for k in range(120) if k % 17]
    kind = "sim_id string, v int, ms long, p double, m double"
    run = lambda r: {x["slot"]: x for x in learn.hourly_features(learn.hourly_grid(spark.createDataFrame(r, kind), ["sim_id", "v"], "ms", "p", "m"), ["sim_id", "v"]).collect()}
    whole, part = run(rows), run(rows[:80])
    assert len(part) >= 80 and all(part[k].asDict() == {n: (pytest.approx(v) if isinstance(v, float) else v) for n, v in whole[k].asDict().items()} for k in part)
    assert set(learn.HOURLY) <= set(whole[100].asDict()) and len(learn.HOURLY) == 25 and len(learn.MINUTE) + len(learn.MARKET) == 23

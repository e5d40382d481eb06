"""Implausible readings, regular grids and trailing totals on small made inputs."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import compare
from tidemill.operators import regular_grid as rg
from tidemill.operators import spikes, trailing

BARS = "symbol string, tf string, ts_ms bigint, h double, l double, c double, recv_ts timestamp"
T0 = datetime(2024, 1, 1)
MIN = 60_000


@pytest.mark.parametrize("name", ["p1_rules", "p3_found", "p3_grid", "p3_counter", "p5_found", "p5_rolling"])
def test_against_sql(spark, name):
    n, m, extra, missing = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert n == m > 0 and not extra and not missing


# ---- spikes ----------------------------------------------------------------------------------------------------------


def series(seed: int, n: int = 4000) -> np.ndarray:
    rng = np.random.default_rng(seed)
    lively = np.exp(0.5 * np.sin(np.arange(n) / 300))
    return 100 * np.exp(np.cumsum(rng.standard_t(6, n) * 4e-4 * lively))


def made(sources: int = 6) -> tuple[pd.DataFrame, set]:
    rows, bad = [], set()
    for k in range(sources):
        c = series(k)
        h, lo = c * 1.0003, c * 0.9997
        for i in (500, 1700, 3300):
            h[i] = c[i] * 1.4
            bad.add((f"S{k}", i))
        c[900:912] = c[900]
        h[900:912], lo[900:912] = c[900] * 1.0003, c[900] * 0.9997
        bad |= {(f"S{k}", i) for i in range(900, 912)}
        lo[2100], lo[2500] = -1.0, h[2500] * 2
        bad |= {(f"S{k}", 2100), (f"S{k}", 2500)}
        c[3000:] *= 1.2  # a lasting change of level
        h[3000:] *= 1.2
        lo[3000:] *= 1.2
        rows.append(pd.DataFrame({"symbol": f"S{k}", "tf": "1m", "ts_ms": np.arange(len(c)) * MIN, "h": h, "l": lo, "c": c, "recv_ts": T0}))
    return pd.concat(rows), bad


def test_planted_bars_are_found(spark):
    pdf, bad = made()
    got = spikes.implausible_bars(spark.createDataFrame(pdf, BARS), F.lit(MIN)).collect()
    found = {(r["symbol"], r["ts_ms"] // MIN) for r in got}
    assert bad <= found and len(found - bad) <= 3
    assert len(got) == len(found)


def test_tail_follows_the_source_and_the_risk(spark):
    pdf, _ = made()
    resid = spikes.bar_residuals(spark.createDataFrame(pdf, BARS), F.lit(MIN)).cache()
    at = {risk: {r["symbol"]: r for r in spikes.tail_cutoffs(resid, risk).where("hour = 0").collect()} for risk in (1e-3, 1e-4, 1e-5)}
    for s in at[1e-4]:
        assert at[1e-3][s]["cutoff"] < at[1e-4][s]["cutoff"] < at[1e-5][s]["cutoff"]
    for column in ("xi", "sigma", "threshold", "cutoff"):
        assert len({round(r[column], 9) for r in at[1e-4].values()}) == 6, f"{column} is the sources' own"


def counted(excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins, n = np.unique(np.floor(np.log(excess) * 100), return_counts=True)
    return np.exp((bins + 0.5) / 100), n.astype(float)


@pytest.mark.parametrize("xi, sigma", [(-0.3, 1.0), (0.0, 0.5), (0.12, 1.1), (0.5, 2.0), (1.1, 0.7)])
def test_tail_is_recovered(xi, sigma):
    rng = np.random.default_rng(3)
    u = rng.random(200_000)
    e = -sigma * np.log(u) if xi == 0 else sigma / xi * (u**-xi - 1)
    tail, _ = spikes.robust_tail(*counted(e), 1e-3, 0.1)
    assert tail.xi == pytest.approx(xi, abs=0.03) and math.exp(tail.log_sigma) == pytest.approx(sigma, rel=0.05)


def test_own_tail_outweighs_the_prior_as_readings_grow():
    rng = np.random.default_rng(5)
    prior, got = spikes.Tail(0.1, 0.0), []
    for n in (100, 10_000, 1_000_000):
        u = rng.random(n)
        got.append(spikes.robust_tail(*counted((u**-0.4 - 1) / 0.4), 1e-3, 0.05, prior, spikes.SPREAD)[0].xi)
    assert got[0] < 0.2 < 0.35 < got[2] and got[0] < got[1] < got[2]


def test_readings_that_are_none(spark):
    rows = [("a", "1m", 0, None, 1.0, 1.0, T0), ("a", "1m", None, 1.0, 1.0, 1.0, T0), (None, "1m", 0, 1.0, 1.0, 1.0, T0), ("a", "1m", MIN, 0.0, 0.0, 0.0, T0), ("a", "1m", MIN, 0.0, 0.0, 0.0, T0)]
    got = spikes.implausible_bars(spark.createDataFrame(rows, BARS), F.lit(MIN)).collect()
    assert [(r["symbol"], r["ts_ms"], r["impossible"], r["spike"]) for r in got] == [("a", MIN, True, False)]
    assert spikes.implausible_bars(spark.createDataFrame([], BARS), F.lit(MIN)).collect() == []


def test_latest_version_counts_and_other_columns_do_not_matter(spark):
    pdf, _ = made(1)
    later = pdf[pdf.ts_ms == 500 * MIN].assign(h=lambda d: d.c * 1.0003, recv_ts=datetime(2024, 1, 2))
    df = spark.createDataFrame(pd.concat([pdf, later, later]), BARS).withColumns({"resid": F.lit("x"), "n": F.lit(None).cast("int"), "block": F.lit(1)})
    found = {r["ts_ms"] // MIN for r in spikes.implausible_bars(df, F.lit(MIN)).collect()}
    assert 500 not in found and 1700 in found


# ---- regular grid ----------------------------------------------------------------------------------------------------


def brute_counter(readings, cell):
    """{slot: increment} of one source, reading by reading and millisecond range by range."""
    out = {}
    for (t0, v0), (t1, v1) in zip(readings, readings[1:]):
        step = v1 if v1 < v0 else v1 - v0
        for k in range(t0 // cell, t1 // cell + 1):
            overlap = min((k + 1) * cell, t1) - max(k * cell, t0)
            if overlap > 0:
                out[k * cell] = out.get(k * cell, 0.0) + step * overlap / (t1 - t0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counter_with_resets(spark, seed):
    rnd = random.Random(seed)
    t, v, readings = 5, 0.0, []
    for _ in range(300):
        t += rnd.choice([1, 7, 40, 99, 100, 101, 900])
        v = 0.5 if rnd.random() < 0.05 else v + rnd.random()
        readings.append((t, v))
    df = spark.createDataFrame([("s", *x) for x in readings] + [("s", *readings[7])], "s string, t long, v double")
    got = {r["slot_ms"]: r for r in rg.regular_grid(rg.readings(df, F.col("s"), F.col("t"), F.col("v"), F.lit(100)), "counter").collect()}
    want = brute_counter(readings, 100)
    assert {k for k, r in got.items() if r["increment"] is not None} == set(want)
    assert all(got[k]["increment"] == pytest.approx(x) for k, x in want.items())
    held = {t // 100 * 100 for t, _ in readings}
    assert {k for k, r in got.items() if r["missing"]} == set(range(min(held), max(held) + 1, 100)) - held
    assert sum(want.values()) == pytest.approx(sum(b if b < a else b - a for (_, a), (_, b) in zip(readings, readings[1:])))


def test_counter_that_restarts_at_its_old_value(spark):
    df = spark.createDataFrame([("s", 0, 5.0), ("s", 100, 5.0), ("s", 200, 4.0)], "s string, t long, v double")
    got = {r["slot_ms"]: r["increment"] for r in rg.regular_grid(rg.readings(df, F.col("s"), F.col("t"), F.col("v"), F.lit(100)), "counter").collect()}
    assert got == {0: 0.0, 100: 4.0, 200: None}


def test_ends_nulls_and_gaps(spark):
    rows = [("s", 50, None), ("s", 250, 1.0), ("s", 550, float("nan")), ("s", 650, 4.0), ("s", 950, None), (None, 1, 1.0), ("s", None, 1.0), ("t", 10, None)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    got = rg.regular_grid(rg.readings(df, F.col("s"), F.col("t"), F.col("v"), F.lit(100))).collect()
    of = {(r["source"], r["slot_ms"]): r for r in got}
    assert sorted(k for k in of if k[0] == "s") == [("s", k) for k in range(0, 1000, 100)]
    assert [k for _, k in sorted(k for k, r in of.items() if k[0] == "s" and not r["missing"])] == [200, 600]
    assert of["s", 400]["level"] == pytest.approx(1 + 3 * 250 / 400) and of["s", 0]["level"] is None and of["s", 900]["level"] is None
    assert of["t", 0]["missing"]
    assert rg.regular_grid(rg.readings(df.limit(0), F.col("s"), F.col("t"), F.col("v"), F.lit(100))).collect() == []


def test_units_of_epochs(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,), (None,)], "t long")
    assert [r[0] for r in df.select(rg.epoch_ms(F.col("t"))).collect()] == [1_700_000_000_000] * 3 + [None]


# ---- trailing totals -------------------------------------------------------------------------------------------------


def test_trailing_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [("e", d, rnd.choice([None, float("nan"), rnd.random()]), 0) for d in range(0, 400) if rnd.random() < 0.4] + [("f", 7, None, 0), (None, 7, 1.0, 0), ("f", None, 1.0, 0)]
    rows += [(e, d, 9.0 if x is None else 1.0, 1) for e, d, x, _ in rows[:5]] + rows[:3]
    df = spark.createDataFrame(rows, "who string, d long, x double, ver int")
    got = {(r["entity"], r["day"]): r for r in trailing.trailing_windows(trailing.daily_values(df, "who", F.col("d"), "x", "ver"), (7, 30)).collect()}
    latest = {}
    for e, d, x, ver in rows:
        if e is not None and d is not None:
            key = (e, d)
            if key not in latest or ver > latest[key][0]:
                latest[key] = (ver, None if x is None or x != x else x)
    days = [d for e, d in latest if e == "e"]
    assert {k[1] for k in got if k[0] == "e"} == set(range(min(days), max(days) + 1))
    for (e, d), r in got.items():
        for n in (7, 30):
            held = [x for (e2, d2), (_, x) in latest.items() if e2 == e and d - n < d2 <= d and x is not None]
            assert r[f"n{n}"] == len(held)
            assert r[f"total{n}"] == (pytest.approx(sum(held)) if held else None)
            assert r[f"avg{n}"] == (pytest.approx(sum(held) / len(held)) if held else None)
    assert trailing.trailing_windows(trailing.daily_values(df.limit(0), "who", F.col("d"), "x", "ver")).collect() == []


def test_bounds_are_in_the_join(spark):
    df = spark.createDataFrame([("e", d, 1.0, 0) for d in range(0, 200)], "who string, d long, x double, ver int")
    plan = trailing.trailing_windows(trailing.daily_values(df, "who", F.col("d"), "x", "ver"))._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "at#" in join and ">=" in join and "<=" in join

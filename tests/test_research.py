"""Statistics, gates, search, regimes and baskets on small made inputs with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import engines
from tidemill.operators import ensembles as en
from tidemill.operators import fold, grids, regime, search, stats
from tidemill.operators import metrics as mt


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- statistics ----------------------------------------------------------------------------------------------------------


def test_rank_correlation_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 2.0, 5.0), ("a", 4.0, 9.0), ("a", None, 1.0), ("b", 1.0, 1.0)], "s string, x double, y double")
    got = dict(rows(stats.spearman(df, ["s"], "x", "y"), "s", "rho"))
    assert got["a"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 3, 4])[0, 1]) and got["b"] is None


@pytest.mark.parametrize("rho, n, p", [(0.5, 10, 0.14111), (0.0, 10, 1.0), (-0.9, 8, 0.0023), (1.0, 5, 0.0), (0.3, 100, 0.00243)])
def test_p_value_of_a_correlation(spark, rho, n, p):
    got = spark.createDataFrame([(rho, float(n))], "rho double, n double").select(stats.correlation_p("rho", "n").alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=2e-4)


def test_delta_by_all_pairs(spark):
    rnd = random.Random(1)
    data = [("a", float(rnd.randrange(6)), rnd.random() < 0.4) for _ in range(60)] + [("b", 1.0, True)]
    got = {r["s"]: r for r in stats.cliffs_delta(spark.createDataFrame(data, "s string, x double, g boolean"), ["s"], "x", "g").collect()}
    one, none = [x for s, x, g in data if s == "a" and g], [x for s, x, g in data if s == "a" and not g]
    want = np.mean([(a > b) - (a < b) for a in one for b in none])
    assert got["a"]["delta"] == pytest.approx(want) and got["a"]["auc"] == pytest.approx((want + 1) / 2) and got["b"]["delta"] is None


def test_step_up_and_per_rank_differ(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.035, 0.036, 0.039, 0.9, None])], "id int, p double")
    up, each = ({r["id"]: r["passed"] for r in stats.benjamini_hochberg(df, "p", 0.05, m, ["id"]).collect()} for m in ("step_up", "per_rank"))
    assert up == {0: True, 1: True, 2: True, 3: True, 4: False} and each == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_average_precision(spark):
    df = spark.createDataFrame([("m", 0.9, 1), ("m", 0.8, 0), ("m", 0.7, 1), ("m", 0.1, 0)], "m string, s double, y int")
    assert stats.average_precision(df, ["m"], "s", "y").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_rotation_null_by_brute_force(spark):
    rnd = random.Random(5)
    y, f = [rnd.gauss(0, 1) for _ in range(50)], [rnd.random() < 0.3 for _ in range(50)]
    got = stats.shift_null(spark.createDataFrame([("a", k, f[k], y[k]) for k in range(50)], "s string, t int, f boolean, y double"), ["s"], "t", "f", "y", 20).first()
    diff = lambda k: np.mean([y[(i + k) % 50] for i in range(50) if f[i]]) - np.mean([y[(i + k) % 50] for i in range(50) if not f[i]])
    others = [diff(50 * j // 21) for j in range(1, 21)]
    assert got["observed"] == pytest.approx(diff(0)) and got["beyond"] == sum(abs(d) >= abs(diff(0)) - 1e-12 for d in others)
    assert got["p"] == pytest.approx((got["beyond"] + 1) / 21)


def test_order_gate(spark):
    """Clustered losses: an idea that halves them where they cluster helps more in the true order; half of everything does not."""
    rnd = random.Random(2)
    base = [0.97 if 40 <= k % 100 < 52 else 1.004 + rnd.random() / 500 for k in range(400)]
    clever = [1 + (f - 1) * 0.2 if f < 1 else f for f in base]
    frame = lambda x: spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "s string, t int, f double")
    got = stats.shuffle_gate(frame(base), frame(clever), ["s"], "t", "f", 20, 60).first()
    assert got["real"] > 0
    same = stats.shuffle_gate(frame(base), frame(base), ["s"], "t", "f", 20, 20).first()
    assert same["real"] == 0 and not same["passed"]


def test_super_gate_needs_all_six(spark):
    good = dict(idea_rdd=5.0, base_rdd=4.0, matched_rdd=4.5, shuffle_passed=True, n5r_idea=3, n5r_base=3, oos_idea_rdd=2.0, oos_base_rdd=2.0, coins_passed=3, coins=4)
    bad = [dict(good, **x) for x in ({"idea_rdd": 4.0}, {"matched_rdd": 5.0}, {"shuffle_passed": False}, {"n5r_idea": 2}, {"oos_idea_rdd": 1.9}, {"coins_passed": 2}, {"oos_idea_rdd": None})]
    kind = "idea_rdd double, base_rdd double, matched_rdd double, shuffle_passed boolean, n5r_idea int, n5r_base int, oos_idea_rdd double, oos_base_rdd double, coins_passed int, coins int"
    cases = [good, dict(good, matched_rdd=None), *bad]
    got = stats.super_gate(spark.createDataFrame([(k, *c.values()) for k, c in enumerate(cases)], f"k int, {kind}"))
    assert [r["passed"] for r in got.orderBy("k").collect()] == [True, True] + [False] * len(bad)


def test_random_skip_of_everything_and_nothing(spark):
    df = spark.createDataFrame([("a", k, 0.1 if k % 2 else -0.05, True) for k in range(10)] + [("b", k, 0.1, False) for k in range(5)], "s string, t int, r double, keep boolean")
    got = {r["s"]: r for r in stats.random_skip(df, ["s"], "t", "r", "keep", 5).collect()}
    assert got["a"]["growth"] == pytest.approx((1.1 * 0.95) ** 5) == got["a"]["random_growth"] and got["b"]["growth"] == 1.0 == got["b"]["random_growth"]
    assert not got["a"]["better"]


# ---- space and search ----------------------------------------------------------------------------------------------------


def test_points_to_configurations(spark):
    lo, hi = [0.0] * search.DIMS, [0.999999] * search.DIMS
    c = {r["config_id"]: r for r in search.to_configs(spark.createDataFrame([(0, lo), (1, hi)], "id long, u array<double>"), 0.01).collect()}
    assert (c[0]["w"], c[0]["tpd"], c[0]["ntp"], c[0]["lev"], c[0]["stop"], c[0]["sltp"]) == (1500, 0.02, 1, 1.0, 0.003, 1)
    assert (c[1]["w"], c[1]["tpd"], c[1]["ntp"], c[1]["lev"], c[1]["stop"], c[1]["sltp"]) == (3500, 0.3, 15, 3.0, 0.02, 4)
    off = ("trail_mult", "stop_k", "risk_frac", "taper_ref", "boost", "vol_target")
    assert all(c[0][k] is None for k in off) and all(c[1][k] is not None for k in off)
    assert c[0]["runner"] == 0.0 and c[1]["runner"] == 0.25 and c[0]["max_lev"] == 1e9 and c[1]["max_lev"] == 1.0 and c[1]["liq_guard"]


def test_gates_open_at_their_number(spark):
    at = {name: k for k, (name, _, _) in enumerate(search.SPACE)}
    for gate, column, edge in (("trail_on", "trail_mult", 0.5), ("taper_on", "taper_ref", 0.45), ("boost_on", "boost", 0.55)):
        u = [[0.5] * search.DIMS for _ in range(2)]
        u[0][at[gate]], u[1][at[gate]] = edge - 1e-9, edge
        got = {r["config_id"]: r[column] for r in search.to_configs(spark.createDataFrame([(k, x) for k, x in enumerate(u)], "id long, u array<double>")).collect()}
        assert got[0] is None and got[1] is not None, gate


def test_inverse_map_and_box(spark):
    pts = grids.sobol(spark, 64, search.DIMS, 3)
    back = {r["config_id"]: r["u"] for r in search.to_points(search.to_configs(pts, 0.01)).collect()}
    for r in pts.collect():
        u, v = r["u"], back[r["id"]]
        assert v[1] == pytest.approx(u[1], abs=1e-3) and v[4] == pytest.approx(u[4], abs=0.02) and all(0 <= x <= 1 for x in v)
        for k, (name, kind, a) in enumerate(search.SPACE):
            if kind == "gate" and name != "risk_on":
                assert (v[k] >= a[0]) == (u[k] >= a[0]), name
    lo, hi = search.box_around(spark.createDataFrame([(0, [0.0, 0.5]), (1, [0.1, 0.7])], "config_id int, u array<double>"))
    assert lo == pytest.approx([0.0, 0.475]) and hi == pytest.approx([0.175, 0.725])
    inside = np.array([r["u"] for r in grids.sobol(spark, 256, 2, 1, lo, hi).collect()])
    assert (inside >= lo).all() and (inside <= hi).all()


def market(spark, symbols=4, n=1500):
    import pandas as pd

    out = []
    for k in range(symbols):
        b = engines.bars(20 + k, n)
        out.append(pd.DataFrame({"symbol": f"S{k}", "w": 12, "ts_ms": b["ts"] * 12, "o": b["o"], "h": b["h"], "l": b["l"], "c": b["c"], "ma": b["ma"], "vol": b["vol"], "vol_slow": b["slow"]}))
    return spark.createDataFrame(pd.concat(out)).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("ma", "vol", "vol_slow")})


def test_search_and_its_resumption(spark, tmp_path):
    args = dict(keys=["symbol"], n=48, topk=6, rounds=2, split_month=1970 * 12 + 16, base={"w": 12, "tpd": 0.05, "ntp": 3, "lev": 1.0, "stop": 0.02, "sltp": 2}, lengths=[12])
    found = search.search(market(spark), folder=f"{tmp_path}/s", **args)
    got = found.orderBy("round", "config_id").collect()
    assert {r["round"] for r in got} == {0, 1} and len(got) <= 12 and all(r["coins"] == 4 for r in got)
    for r in got:
        assert r["passed"] == all(r[c] for c in ("better", "beats_matched", "bootstrap", "tail_kept", "holdout", "breadth"))
    import shutil

    shutil.rmtree(f"{tmp_path}/s/round=1")
    second = search.search(market(spark), folder=f"{tmp_path}/s", **args)
    again = second.orderBy("round", "config_id").collect()
    assert [(r["round"], r["config_id"], r["passed"]) for r in again] == [(r["round"], r["config_id"], r["passed"]) for r in got]
    cal = search.calibration(second.where("round = 0").select("config_id", "objective"), second.where("round = 0"), 3).collect()
    assert len(cal) == 1 and -1 <= cal[0]["rho"] <= 1


def test_matched_leverage_is_that_of_the_trades(spark):
    b = market(spark, 1)
    configs = spark.createDataFrame([(0, 12, 0.02, 3, 1.0, 0.03, 2, 0.02, 1.0, 0.2)], "config_id long, w int, tpd double, ntp int, lev double, stop double, sltp int, taper_ref double, taper_near double, taper_far double")
    p = fold.replay_grid(b, configs).toPandas()
    got = search.matched_configs(fold.replay_grid(b, configs), configs).first()
    assert got["lev"] == pytest.approx((p.lev * p.qty * p.entry).sum() / (p.qty * p.entry).sum()) and got["lev"] < 1


# ---- regimes -------------------------------------------------------------------------------------------------------------


def test_labels_rest_on_earlier_days(spark):
    rnd = random.Random(8)
    x = [None if rnd.random() < 0.1 else rnd.random() for _ in range(60)]
    got = dict(rows(regime.labels(spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "s string, day int, x double"), ["s"], "day", "x", 10), "day", "label"))
    for t in range(60):
        hist = [v for v in x[:t] if v is not None]
        want = 1
        if t and len(hist) >= 10 and x[t - 1] is not None:
            lo, hi = np.quantile(hist, [1 / 3, 2 / 3])
            want = 0 if x[t - 1] <= lo else 2 if x[t - 1] >= hi else 1
        assert got[t] == want


def test_rotation_of_labels(spark):
    df = spark.createDataFrame([("a", 10 + k, k) for k in range(10)], "s string, day int, v int")
    got = rows(regime.rotated(df, ["s"], "day", "v", [0.0, 0.3]), "shift", "day", "v")
    assert [v for s, _, v in got if s == 0.0] == list(range(10)) and [v for s, _, v in got if s == 0.3] == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2]


def test_schedule_reaches_the_engine(spark):
    b = market(spark, 1).select("symbol", "w", "ts_ms", "o", "h", "l", "c", "ma")
    days = b.select("symbol", F.floor(F.col("ts_ms") / regime.DAY_MS).alias("day")).distinct().withColumn("label", F.lit(0))
    configs = spark.createDataFrame([(0, 12, 0.05, 3, 1.0, 0.02, 2), (1, 12, 0.05, 3, 2.0, 0.02, 2)], "config_id long, w int, tpd double, ntp int, lev double, stop double, sltp int")
    plan = regime.by_label(days, ["symbol"], "day", {0: {"lev": 2.0}}, F.lit(0))
    m = {r["config_id"]: r["growth"] for r in regime.equity_measures(fold.replay_regime(b, configs, plan), ["symbol", "config_id"]).collect()}
    assert m[0] == pytest.approx(m[1])
    still = regime.by_label(days, ["symbol"], "day", {0: {"lev": 0.0}}, F.lit(0))
    flat = {r["config_id"]: r["growth"] for r in regime.equity_measures(fold.replay_regime(b, configs, still), ["symbol", "config_id"]).collect()}
    assert flat[0] == 1.0 and flat[1] == pytest.approx(m[1])


def test_adaptive_rule_at_its_ends_is_a_fixed_parameter(spark):
    b = market(spark, 1).select("symbol", "w", "ts_ms", "o", "h", "l", "c", "ma", *(F.lit(1.0 if f == "er" else 0.0).alias(f) for f in regime.FEATURES))
    kind = "config_id long, w int, tpd double, ntp int, lev double, stop double, sltp int, param string, feature string, lo double, hi double, inverted boolean, shift double"
    base = (12, 0.05, 3, 1.0, 0.02, 2)
    cases = [(0, *base, "lev", "er", 0.5, 1.5, False, 0.0), (1, *base, "lev", "er", 0.5, 1.5, True, 0.3), (2, *base, None, None, None, None, None, 0.0), (3, *base, "stop", "er", 1.0, 2.0, False, 0.0)]
    got = regime.replay_adaptive(b, spark.createDataFrame(cases, kind)).toPandas()
    fixed = fold.replay_grid(b, spark.createDataFrame([(0, 12, 0.05, 3, 1.5, 0.02, 2), (1, 12, 0.05, 3, 0.5, 0.02, 2), (2, 12, 0.05, 3, 1.0, 0.02, 2), (3, 12, 0.05, 3, 1.0, 0.03, 2)], "config_id long, w int, tpd double, ntp int, lev double, stop double, sltp int")).toPandas()
    for k in range(4):
        a, z = (x[x.config_id == k].sort_values("exit_ts").balance.tolist() for x in (got, fixed))
        assert a == pytest.approx(z) and a, k
    assert len(regime.rules()) == 72


# ---- baskets -------------------------------------------------------------------------------------------------------------


def returns(spark, members=6, months=30, seed=3):
    rnd = random.Random(seed)
    data = {(f"m{k}", 24000 + t): rnd.gauss(0.01, 0.05) for k in range(members) for t in range(months) if rnd.random() > 0.05}
    return data, spark.createDataFrame([(m, t, x) for (m, t), x in data.items()], "m string, month long, ret double")


def measured(series):
    eq = np.cumprod([1 + x for x in series])
    return np.mean([x > 0 for x in series]) * 100, eq[-1], (1 - eq / np.maximum.accumulate(eq)).max() * 100


def test_exhaustive_search_by_brute_force(spark):
    data, df = returns(spark)
    split, names = 24018, [f"m{k}" for k in range(6)]
    got = en.exhaustive_ensembles(df, "m", split, (2, 3), 6, 400).collect()
    want = {}
    for size in (2, 3):
        for s in itertools.combinations(names, size):
            both = []
            for lo, hi in ((0, split), (split, 10**6)):
                series = [np.mean(v) for t in sorted({t for _, t in data if lo <= t < hi}) if (v := [data[m, t] for m in s if (m, t) in data])]
                both.append(measured(series))
            (g, w, d), (g2, w2, d2) = both
            want[s] = (g - 1.4 * d + 6 * math.log1p(max(w - 1, 0)), g2 - 1.4 * d2)
    assert {tuple(r["members"]): (pytest.approx(r["train_objective"]), pytest.approx(r["score"])) for r in got} == want


def test_pool_is_bounded(spark):
    with pytest.raises(ValueError):
        en.exhaustive_ensembles(returns(spark)[1], "m", 24018, pool=65)


def test_greedy_takes_the_best_step_each_time(spark):
    data, df = returns(spark)
    got = en.greedy_basket(df, "m", 3).orderBy("k").collect()
    months = sorted({t for _, t in data})
    chosen = [r["added"] for r in got]

    def score(basket):
        s = [np.mean([data.get((m, t), 0.0) for m in basket]) for t in months]
        pos, _, dd = measured(s)
        years = {}
        for t, x in list(zip(months, s))[1:]:
            years[t // 12] = years.get(t // 12, 1.0) * (1 + x)
        logs = [math.log(v) for v in years.values() if v > 1]
        return pos - 50 * (max(logs) / sum(logs) if logs else 1) - 0.3 * dd

    for k in (1, 2):
        options = {m: score([*chosen[:k], m]) for m in {m for m, _ in data} - set(chosen[:k])}
        assert max(options, key=options.get) == chosen[k]


def test_extreme_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 5, 0.5), ("a", "c", 5, -0.2), ("b", "c", 5, 0.9)], "a string, b string, n long, corr double")
    assert rows(mt.extreme_pairs(pairs), "which", "a", "b") == [("highest", "b", "c"), ("lowest", "a", "c"), ("mean", None, None)]


def test_leverage_map_and_normalised_share(spark):
    from tidemill.functions import scalars as sc

    df = spark.createDataFrame([(1,), (7,), (None,)], "m int").select(sc.by_month(F.col("m"), {7: 2.0}).alias("x"))
    assert [r["x"] for r in df.collect()] == [1.0, 2.0, 1.0]


def test_pairs_of_which_one_does_not_vary(spark):
    data = [("a", t, 0.0) for t in range(4)] + [("b", t, x) for t, x in enumerate((0.1, -0.2, 0.4, None))] + [("c", t, x) for t, x in enumerate((0.3, 0.1, 0.2, 9.0))]
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in mt.pairwise_corr(spark.createDataFrame(data, "m string, t long, x double"), "m", "t", "x").collect()}
    assert {k: n for k, (n, _) in got.items()} == {("a", "b"): 3, ("a", "c"): 4, ("b", "c"): 3}
    assert math.isnan(got["a", "b"][1]) and math.isnan(got["a", "c"][1])
    assert got["b", "c"][1] == pytest.approx(np.corrcoef([0.1, -0.2, 0.4], [0.3, 0.1, 0.2])[0, 1])


def test_a_search_plans_each_replay_once(spark, monkeypatch):
    replays, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: replays.append(df._jdf.queryExecution().analyzed().toString().count("FlatMapCoGroupsInArrow")) or cut(df))
    search.search(market(spark), keys=["symbol"], n=8, topk=3, rounds=1, split_month=1970 * 12 + 16, base={"w": 12, "tpd": 0.05, "ntp": 3, "lev": 1.0, "stop": 0.02, "sltp": 2}, lengths=[12])
    assert sum(replays) == 4 and max(replays) == 1  # the base, the screen, the ideas and their twins


def test_a_configuration_that_loses_all_in_its_first_month(spark):
    data = [("a", 1, 0, 9e3), ("a", 1, 1, 0.0), ("b", 1, 1, 9e3), ("b", 1, 2, 12e3), ("a", 2, 0, 9e3), ("a", 2, 1, 18e3), ("a", 2, 2, 9e3), ("a", 3, 0, 9e3), ("a", 3, 1, 18e3), ("a", 3, 2, 0.0)]
    closes = spark.createDataFrame([(s, c, m * 32 * 86_400_000, b) for s, c, m, b in data], "symbol string, config_id long, exit_ts long, balance double")
    got = rows(search.portfolio_measures(closes, ["symbol"], mode="any"), "config_id", "growth", "dd", "months", "ret_dd")
    assert got == [(1, 0.0, 100.0, 2, 0.0), (2, 1.0, 50.0, 2, 2.0), (3, 0.0, 100.0, 2, 0.0)]

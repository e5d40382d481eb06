"""The vector engine against the plain one, the semantics that differ between engines, and what must not matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import engines
from tests.conftest import SMALL
from tests.oracle import compare
from tidemill.operators import fold

BASE = {k: v for k, v in fold.DEFAULTS.items() if k != "w"}


def draw(rnd):
    g = dict(BASE)
    some = lambda p, v: v if rnd.random() < p else None
    g.update(tpd=rnd.choice([0.005, 0.02, 0.05]), ntp=rnd.choice([1, 2, 5, 9]), lev=rnd.choice([0.5, 1.0, 3.0, 25.0, 80.0]), stop=rnd.choice([0.004, 0.02, 0.3]), sltp=rnd.choice([0, 1, 2, 4]))
    g.update(maxdist=some(0.3, rnd.choice([0.01, 0.03])), fee=rnd.choice([0.0, 0.0005]), liq=rnd.random() < 0.7, stop_k=some(0.3, rnd.choice([0.5, 2.0])), risk_frac=some(0.3, 0.01), max_lev=rnd.choice([1e9, 2.0]))
    g.update(trail_mult=some(0.4, rnd.choice([0.5, 2.0])), runner=rnd.choice([0.0, 0.1]), taper_ref=some(0.3, 0.02), taper_near=1.4, taper_far=0.3)
    g.update(boost=some(0.4, 1.7), boost_from=rnd.choice([0.0, 0.05]), boost_decay=rnd.choice([0.0, 0.1]), liq_guard=rnd.random() < 0.3, vol_target=some(0.3, 0.012))
    return g


def vectors(configs):
    return fold.defaults(len(configs), **{k: [g[k] for g in configs] for k in BASE})


def as_bars(b, days=False):
    day = np.unique(b["ts"] // 86_400_000, return_inverse=True)[1] if days else None
    return fold.Bars(b["ts"], b["o"], b["h"], b["l"], b["c"], b["ma"], b["vol"], b["slow"], day)


def trades(columns, k):
    if not columns:
        return []
    m = columns[0] == k
    return [(int(t0), int(t1), "LONG" if p > 0 else "SHORT", e, x, str(fold.REASONS[why]), bal, lev) for t0, t1, p, e, x, bal, why, lev in zip(*(columns[j][m] for j in (1, 2, 3, 4, 5, 8, 9, 10)))]


def same(got, want):
    assert [g[:3] + (g[5],) for g in got] == [w[:3] + (w[5],) for w in want]
    for g, w in zip(got, want):
        assert g[3:5] + g[6:] == pytest.approx(w[3:5] + w[6:], rel=1e-9, abs=1e-9)


VARIANTS = {"plain": {}, "trail_now": {"trail_now": True}, "strict": {"strict": True}, "reenter": {"reenter": True}, "regime": {"strict": True, "carry": True, "reenter": True, "dust": 1e-12}}


@pytest.mark.parametrize("variant", VARIANTS)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vector_engine_is_the_plain_one(variant, seed):
    rnd = random.Random(seed)
    b = engines.bars(seed, gap=0.05)
    configs = [draw(rnd) for _ in range(60)]
    rules = fold.Rules(**VARIANTS[variant])
    columns, _, _ = fold.replay(as_bars(b), vectors(configs), floor=20, rules=rules)
    reasons = set()
    for k, g in enumerate(configs):
        want = engines.One(b, g, floor=20, **VARIANTS[variant]).trade().out
        same(trades(columns, k), want)
        reasons |= {w[5] for w in want}
    assert reasons == {"SL", "TP", "REVERSE", "LIQ"}


@pytest.mark.parametrize("seed", [4, 5])
def test_equity_schedule_and_breaker(seed):
    rnd = random.Random(seed)
    b = engines.bars(seed, gap=0.03)
    days = np.unique(b["ts"] // 86_400_000)
    configs = [dict(draw(rnd), liq=False) for _ in range(20)]
    plan = {int(d): {"lev": rnd.choice([0.0, 0.5, 2.0]), "tpd": rnd.choice([0.01, 0.03]), "ntp": rnd.choice([1, 4]), "stop": rnd.choice([0.01, 0.05]), "sltp": rnd.choice([1, 3])} for d in days}
    schedule = {c: np.array([[plan[int(d)][c]] * 20 for d in days], float) for c in fold.SCHEDULED}
    rules = fold.Rules.regime()
    columns, equity, slow = fold.replay(as_bars(b, True), vectors(configs), rules=rules, schedule=schedule, breaker=fold.Breaker(3, 5, 0.5), daily=len(days))
    seen = 0
    for k, g in enumerate(configs):
        one = engines.One(b, g, strict=True, carry=True, reenter=True, dust=1e-12, plan=plan, breaker=(3, 5, 0.5)).trade()
        same(trades(columns, k), one.out)
        assert equity[:, k] == pytest.approx([one.equity[int(d)] for d in days], rel=1e-9)
        assert {int(days[j]) for j in np.flatnonzero(slow[:, k])} == one.slowed
        seen += len(one.slowed)
    assert seen > 0


# ---- one small case per difference -------------------------------------------------------------------------------------


def tiny(rows, ma):
    """Bars (o, h, l, c) with the average given."""
    a = np.array(rows, float)
    n = len(rows)
    return fold.Bars(np.arange(n) * 60_000, a[:, 0], a[:, 1], a[:, 2], a[:, 3], np.array(ma, float), np.full(n, np.nan), np.full(n, np.nan))


ENTRY = [(100, 101, 99, 100), (101, 103, 101, 102)]  # holds 100, then clears it upwards: long at 102
CFG = {"tpd": 0.1, "ntp": 1, "stop": 0.05, "sltp": 1, "lev": 1.0, "fee": 0.0, "liq": False}


def run(rows, ma=None, rules=fold.Rules(), **cfg):
    columns, _, _ = fold.replay(tiny(rows, ma if ma is not None else [100.0] * len(rows)), fold.defaults(1, **(CFG | cfg)), rules=rules)
    return [(t[5], round(t[4], 6), round(t[6], 4)) for t in trades(columns, 0)]


def test_stop_fills_at_its_level_even_through_a_gap():
    assert run([*ENTRY, (90, 91, 80, 85)]) == [("SL", 96.9, 9500.0)]


def test_stop_comes_before_the_ladder_in_one_bar():
    assert run([*ENTRY, (102, 130, 90, 100)])[0][0] == "SL"


def test_several_rungs_in_one_bar_and_the_last_closes_the_rest():
    got = run([*ENTRY, (102, 150, 101, 140)], ntp=3)
    assert got == [("TP", 132.6, 12000.0)]


def test_stop_follows_the_average_once_enough_rungs_are_filled():
    rows = [*ENTRY, (102, 113, 103, 110), (110, 111, 104, 105)]
    assert run(rows, [100, 100, 100, 104.5], ntp=2, sltp=1)[0][:2] == ("SL", 104.5)
    assert run(rows, [100, 100, 100, 104.5], ntp=2, sltp=2) == []


def test_the_rung_of_this_bar_does_not_yet_arm_the_stop():
    assert run([*ENTRY, (102, 113, 101, 110)], [100, 100, 105], ntp=2, sltp=1) == []


def test_edge_counts_as_inside_unless_strict():
    edge = [(100, 100, 99, 99.5), (101, 103, 101, 102), (90, 91, 80, 85)]
    assert len(run(edge)) == 1 and run(edge, rules=fold.Rules(strict=True)) == []


def test_no_new_entry_on_the_bar_of_a_stop_unless_allowed():
    rows = [*ENTRY, (102, 102.5, 99.5, 101), (99, 99.5, 90, 91), (91, 92, 60, 65)]
    assert [r for r, *_ in run(rows)] == ["SL"]
    assert [r for r, *_ in run(rows, rules=fold.Rules(reenter=True))] == ["SL", "TP"]


def test_reverse_reopens_on_the_same_bar_unless_blocked():
    rows = [*ENTRY, (102, 102.5, 99.5, 101), (99, 99.5, 98, 98.5), (98, 110, 97, 109)]
    assert [r for r, *_ in run(rows)] == ["REVERSE", "SL"]
    assert [r for r, *_ in run(rows, maxdist=0.02, stop=0.2)] == ["REVERSE"], "98.5 is near, and 102 is not beyond 2 %"
    assert [r for r, *_ in run(rows, maxdist=0.021, stop=0.05)] == ["REVERSE", "SL"]


def test_an_average_that_fails_for_a_bar():
    rows = [(100, 101, 99, 100), (100, 101, 99, 100), (101, 103, 101, 102), (102, 103, 80, 85)]
    ma = [100, float("nan"), 100, 100]
    assert run(rows, ma) == [] and [r for r, *_ in run(rows, ma, rules=fold.Rules(carry=True))] == ["SL"]


def test_liquidation_needs_the_stop_beyond_it_or_an_opening_beyond_it():
    wide = {"lev": 20.0, "liq": True, "mmr": 0.005}
    level = 102 * (1 - 0.995 / 20)
    assert run([*ENTRY, (102, 102, 90, 92)], stop=0.5, **wide) == [("LIQ", round(level, 6), 0.0)]
    assert run([*ENTRY, (102, 102, 90, 92)], stop=0.01, **wide)[0][0] == "SL"
    assert run([*ENTRY, (95, 96, 90, 92)], stop=0.01, **wide)[0][0] == "LIQ"
    assert run([*ENTRY, (102, 102, 90, 92)], stop=0.5, lev=20.0, liq=False) == []


def test_a_dead_account_trades_no_more():
    rows = [*ENTRY, (102, 102, 50, 60), (60, 101, 99, 100), (101, 103, 101, 102), (102, 103, 50, 60)]
    assert len(run(rows, stop=0.9, lev=20.0, liq=True)) == 1


def test_partly_filled_ladder_loses_only_the_rest_in_a_liquidation():
    got = run([*ENTRY, (102, 113, 101, 110), (80, 81, 40, 70)], ntp=2, sltp=2, stop=0.9, lev=2.0, liq=True)
    assert got[0][0] == "LIQ" and got[0][2] == pytest.approx(10_000 * (1 + 2 * 0.1 / 2) - 5000)


def test_fee_is_taken_on_every_fill():
    free, paid = run([*ENTRY, (90, 91, 80, 85)])[0][2], run([*ENTRY, (90, 91, 80, 85)], fee=0.001)[0][2]
    assert free - paid == pytest.approx(10_000 * 0.001 * (1 + 0.95))


# ---- what must not matter ----------------------------------------------------------------------------------------------


def test_defaults_of_the_ideas_change_nothing():
    b = as_bars(engines.bars(8))
    plain, _, _ = fold.replay(b, fold.defaults(1, **CFG))
    off, _, _ = fold.replay(b, fold.defaults(1, **CFG, max_lev=1e9, taper_near=1.0, taper_far=1.0, boost_from=0.0, vol_lo=0.5, vol_hi=2.0))
    assert trades(plain, 0) == trades(off, 0) and len(trades(plain, 0)) > 5


@pytest.mark.parametrize("idea", [{"stop_k": 1.0}, {"risk_frac": 0.01}, {"taper_ref": 0.02, "taper_far": 0.2}, {"boost": 2.0}, {"vol_target": 0.02}, {"trail_mult": 1.0}, {"runner": 0.3}, {"fee": 0.001}, {"maxdist": 0.01}])
def test_each_idea_changes_the_result(idea):
    b = as_bars(engines.bars(8))
    base = dict(CFG, ntp=3, tpd=0.02, stop=0.03)
    assert trades(fold.replay(b, fold.defaults(1, **base))[0], 0) != trades(fold.replay(b, fold.defaults(1, **(base | idea)))[0], 0)


def test_later_bars_do_not_change_earlier_trades():
    b = engines.bars(9)
    whole = trades(fold.replay(as_bars(b), fold.defaults(1, **dict(CFG, ntp=3, tpd=0.02)))[0], 0)
    cut = {k: v[:900] for k, v in b.items()}
    part = trades(fold.replay(as_bars(cut), fold.defaults(1, **dict(CFG, ntp=3, tpd=0.02)))[0], 0)
    assert part == whole[: len(part)] and len(part) > 3


def test_grids_of_any_size_and_halves(spark):
    import pandas as pd

    b = engines.bars(10, 600)
    pdf = pd.DataFrame({"symbol": "A", "w": 12, "ts_ms": b["ts"], "o": b["o"], "h": b["h"], "l": b["l"], "c": b["c"], "ma": b["ma"], "junk": 1})
    pdf = pd.concat([pdf, pdf.assign(symbol="B", c=pdf.c * 2, h=pdf.h * 2, l=pdf.l * 2, o=pdf.o * 2, ma=pdf.ma * 2), pdf.head(3).assign(h=float("nan"))])
    frame = spark.createDataFrame(pdf).withColumn("h", F.nanvl("h", F.lit(None).cast("double"))).repartition(5)
    configs = spark.createDataFrame([(k, 12, 0.01 + 0.001 * (k % 7), 3, 0.02) for k in range(300)], "config_id long, w int, tpd double, ntp int, stop double")
    got = fold.replay_grid(frame, configs, ["symbol"]).toPandas()
    assert set(got.symbol) == {"A", "B"} and got.config_id.nunique() == 300
    a, z = (got[(got.symbol == s) & (got.config_id == 5)].sort_values("exit_ts") for s in "AB")
    assert a.balance.tolist() == pytest.approx(z.balance.tolist())
    assert fold.replay_grid(frame, configs.limit(0)).count() == 0 == fold.replay_grid(frame.limit(0), configs).count()
    halves = [fold.replay_grid(frame, configs.limit(5), ["symbol"], half=x).toPandas() for x in ("is", "oos")]
    middle = b["ts"][(13 + 600) // 2]
    assert (halves[0].exit_ts < middle).all() and (halves[1].open_ts >= middle).all() and len(halves[0]) and len(halves[1])


@pytest.mark.parametrize("name", ["trade_chain", "replay_fold"])
def test_against_sql(spark, name):
    n, m, extra, missing = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert n == m > 0 and not extra and not missing


def test_chain_is_the_fold(spark):
    """Fees, leverage, guards and liquidation over shared exits."""
    import pandas as pd

    from tidemill.operators import chain

    rnd = random.Random(12)
    b = engines.bars(12, 500)
    pdf = pd.DataFrame({"symbol": "A", "w": 12, "i": np.arange(500), "ts_ms": b["ts"], "o": b["o"], "h": b["h"], "l": b["l"], "c": b["c"], "ma": b["ma"]})
    frame = spark.createDataFrame(pdf).withColumn("ma", F.nanvl("ma", F.lit(None).cast("double")))
    rows = [(k, 12, rnd.choice([0.01, 0.03]), rnd.choice([1, 3]), rnd.choice([1.0, 20.0]), rnd.choice([0.02, 0.4]), rnd.choice([1, 2]), rnd.choice([None, 0.02]), rnd.choice([0.0, 0.001]), rnd.random() < 0.5) for k in range(60)]
    configs = spark.createDataFrame(rows, "config_id long, w int, tpd double, ntp int, lev double, stop double, sltp int, maxdist double, fee double, liq boolean")
    assert chain.geometries(configs).select("geo").distinct().count() < 60
    a = chain.trade_chain(frame, configs).select("config_id", "open_ts", "exit_ts", "reason", "balance").toPandas().sort_values(["config_id", "exit_ts"])
    z = fold.replay_grid(frame.drop("i"), configs).select("config_id", "open_ts", "exit_ts", "reason", "balance").toPandas().sort_values(["config_id", "exit_ts"])
    assert a.iloc[:, :4].values.tolist() == z.iloc[:, :4].values.tolist() and len(a) > 300
    assert a.balance.tolist() == pytest.approx(z.balance.tolist(), rel=1e-7, abs=1e-6)

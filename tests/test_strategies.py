"""The dip bracket, the straddle and the burst: a plain engine of each, small cases by hand, and what must hold in general."""

import random

import numpy as np
import pytest

from tests import engines
from tidemill.operators import strategies as st
from tidemill.operators.fold import Bars


def as_bars(b):
    return Bars(b["ts"], b["o"], b["h"], b["l"], b["c"], b["ma"])


def tiny(rows, ma=None):
    a = np.array(rows, float)
    n = len(rows)
    return Bars(np.arange(n) * 60_000, a[:, 0], a[:, 1], a[:, 2], a[:, 3], np.array(ma, float) if ma is not None else np.full(n, np.nan))


def trades(book, k=0):
    out = []
    for chunk in book.closed:
        for j in np.flatnonzero(chunk[0] == k):
            out.append((int(chunk[1][j]), int(chunk[2][j]), int(chunk[3][j]), float(chunk[4][j]), float(chunk[5][j]), str(st.REASONS[chunk[9][j]]), float(chunk[8][j])))
    return sorted(out, key=lambda t: t[1])


class Plain:
    """One configuration, one position; each strategy says when to enter and what closes."""

    def __init__(self, b, g, kind):
        self.b, self.g, self.kind, self.bal, self.side, self.out = b, g, kind, 10_000.0, 0, []

    def run(self):
        for i in range(1, len(self.b.c)):
            if self.side:
                self.manage(i)
            elif self.bal > 1e-9:
                side, price = getattr(self, f"{self.kind}_entry")(i)
                if side:
                    self.enter(i, side, price)
        return self.out

    def enter(self, i, side, price):
        self.side, self.entry, self.best, self.opened = side, price, price, int(self.b.ts[i])
        self.qty, self.bal0 = self.bal * self.g["lev"] / price, self.bal
        self.bal -= self.g["fee"] * self.qty * price
        self.liq = price * (1 - side * 0.995 / self.g["lev"])
        self.stop = price * (1 - side * self.g["stop"]) if "stop" in self.g else None
        self.take = price * (1 + side * self.g["take"]) if "take" in self.g else None

    def past(self, price, level):
        return price <= level if self.side > 0 else price >= level

    def close(self, i, price, why):
        if why == "LIQ":
            self.bal = max(0.0, self.bal - self.bal0)
        else:
            self.bal += (price - self.entry) * self.side * self.qty - self.g["fee"] * self.qty * price
        self.out.append((self.opened, int(self.b.ts[i]), self.side, self.entry, price, why, self.bal))
        self.side = 0

    def manage(self, i):
        b = self.b
        worst, best = (b.l[i], b.h[i]) if self.side > 0 else (b.h[i], b.l[i])
        self.best = max(self.best, b.h[i]) if self.side > 0 else min(self.best, b.l[i])
        reached = lambda level: best >= level if self.side > 0 else best <= level
        beyond = self.past(b.o[i], self.liq) or (self.stop is not None and self.past(self.stop, self.liq))
        if self.past(worst, self.liq) and beyond:
            return self.close(i, self.liq, "LIQ")
        if self.stop is not None and self.past(worst, self.stop):
            return self.close(i, self.stop, "SL")
        back = self.g.get("callback", 0) / 100
        trail = self.best * (1 - self.side * back)
        if self.kind == "dip":
            if reached(self.take):
                self.close(i, self.take, "TP")
        elif self.kind == "burst":
            if self.past(worst, trail):
                self.close(i, trail, "TRAIL")
        else:
            pulled = back > 0 and self.past(worst, trail)
            if pulled or (self.g["take"] > 0 and reached(self.take)):
                price, side = trail if pulled else self.take, -self.side
                self.close(i, price, "REVERSE")
                if self.bal > 1e-9:
                    self.enter(i, side, price)
        return None

    def dip_entry(self, i):
        b, before = self.b, self.b.c[i - 1]
        side = 1
        if self.g["mode"] != "long":
            if np.isnan(b.ma[i]) or b.ma[i] <= 0:
                return 0, 0
            side = (1 if before > b.ma[i] else -1) * (1 if self.g["mode"] == "trend" else -1)
        limit = before * (1 - side * self.g["dip"])
        if side > 0:
            return (1, min(limit, b.o[i])) if b.l[i] <= limit else (0, 0)
        return (-1, max(limit, b.o[i])) if b.h[i] >= limit else (0, 0)

    def straddle_entry(self, i):
        b, before = self.b, self.b.c[i - 1]
        up, down = before * (1 + self.g["gap"]), before * (1 - self.g["gap"])
        over, under = b.h[i] >= up, b.l[i] <= down
        if over and (not under or abs(b.o[i] - up) <= abs(b.o[i] - down)):
            return 1, up
        return (-1, down) if under else (0, 0)

    def burst_entry(self, i):
        if i <= sum(self.g["windows"]):
            return 0, 0
        at, moves = i, []
        for w in self.g["windows"]:
            moves.append(self.b.c[at] / self.b.c[at - w] - 1)
            at -= w
        if min(moves) >= self.g["rise"]:
            return 1, self.b.c[i]
        return (-1, self.b.c[i]) if max(moves) <= -self.g["rise"] else (0, 0)


def draw(rnd, kind):
    g = {"lev": rnd.choice([0.5, 1.0, 5.0, 30.0]), "fee": rnd.choice([0.0, 0.001])}
    if kind == "dip":
        return g | {"dip": rnd.choice([0.0, 0.003, 0.01]), "take": rnd.choice([0.01, 0.04]), "stop": rnd.choice([0.01, 0.4]), "mode": rnd.choice(["long", "trend", "revert"])}
    if kind == "straddle":
        return g | {"gap": rnd.choice([0.002, 0.01]), "callback": rnd.choice([0.0, 0.5, 3.0]), "take": rnd.choice([0.0, 0.03]), "stop": rnd.choice([0.02, 0.5])}
    return g | {"windows": rnd.choice([[2], [1, 2], [3, 1, 2]]), "rise": rnd.choice([0.001, 0.008]), "callback": rnd.choice([0.5, 2.0, 40.0])}


@pytest.mark.parametrize("kind", st.ENGINES)
@pytest.mark.parametrize("seed", [1, 2])
def test_vector_engine_is_the_plain_one(kind, seed):
    rnd = random.Random(seed)
    b = as_bars(engines.bars(seed, 1200, 0.03))
    configs = [draw(rnd, kind) for _ in range(40)]
    engine, columns = st.ENGINES[kind]
    book = engine(b, st.vectors(40, columns, **{k: [g[k] for g in configs] for k in configs[0]}))
    reasons = set()
    for k, g in enumerate(configs):
        got, want = trades(book, k), Plain(b, g, kind).run()
        assert [t[:3] + (t[5],) for t in got] == [t[:3] + (t[5],) for t in want]
        for x, y in zip(got, want):
            assert x[3:5] + x[6:] == pytest.approx(y[3:5] + y[6:], rel=1e-9, abs=1e-9)
        reasons |= {t[5] for t in want}
    assert reasons == {"dip": {"SL", "TP", "LIQ"}, "straddle": {"SL", "REVERSE", "LIQ"}, "burst": {"TRAIL", "LIQ"}}[kind]


def test_dip_is_filled_at_the_opening_when_that_is_beyond_it():
    g = st.vectors(1, st.DIP, dip=0.01, take=0.05, stop=0.5)
    assert trades(st.dip_bracket(tiny([(100, 101, 99, 100), (97, 98, 96, 97), (97, 103, 97, 102)]), g))[0][3] == 97.0
    assert trades(st.dip_bracket(tiny([(100, 101, 99, 100), (99.5, 100, 98, 98.5), (99, 110, 98, 109)]), g))[0][3] == 99.0


def test_nothing_leaves_on_the_bar_that_opened_it():
    g = st.vectors(1, st.DIP, dip=0.01, take=0.02, stop=0.02)
    got = trades(st.dip_bracket(tiny([(100, 101, 99, 100), (100, 110, 90, 95), (99, 100, 98, 99), (99, 102, 99, 101)]), g))
    assert [(t[1], t[5]) for t in got] == [(180_000, "TP")]


def test_straddle_takes_the_order_nearer_to_the_opening():
    g = st.vectors(1, st.STRADDLE, gap=0.01, callback=50.0, take=0.02, stop=0.5)
    up = trades(st.breakout_straddle(tiny([(100, 100, 100, 100), (100.5, 102, 98, 100), (100, 110, 100, 109)]), g))
    down = trades(st.breakout_straddle(tiny([(100, 100, 100, 100), (99.5, 102, 98, 100), (100, 100, 90, 91)]), g))
    even = trades(st.breakout_straddle(tiny([(100, 100, 100, 100), (100, 102, 98, 100), (100, 110, 100, 109)]), g))
    assert (up[0][2], down[0][2], even[0][2]) == (1, -1, 1)


def test_callback_goes_before_the_target_and_takes_in_the_bars_own_high():
    g = st.vectors(1, st.STRADDLE, gap=0.01, callback=1.0, take=0.02, stop=0.5)
    got = trades(st.breakout_straddle(tiny([(100, 100, 100, 100), (100, 101.5, 100, 101), (101, 105, 103, 104), (104, 104, 104, 104)]), g))
    assert got[0][5] == "REVERSE" and got[0][4] == pytest.approx(105 * 0.99)


@pytest.mark.parametrize("fee", [0.0002, 0.001])
def test_fees_never_help(fee):
    b = as_bars(engines.bars(5, 2000))
    for kind, (engine, columns) in st.ENGINES.items():
        last = [trades(engine(b, st.vectors(1, columns, fee=f)))[-1][6] for f in (0.0, fee)]
        assert last[1] <= last[0], kind


def test_wide_stops_and_high_leverage_are_liquidated_unless_told_not_to():
    b = as_bars(engines.bars(6, 2000))
    cfg = {"dip": 0.0, "take": 0.5, "stop": 0.5, "lev": 20.0}
    on, off = (trades(st.dip_bracket(b, st.vectors(1, st.DIP, liq=x, **cfg))) for x in (True, False))
    assert any(t[5] == "LIQ" for t in on) and not any(t[5] == "LIQ" for t in off)


def test_a_dip_that_never_comes():
    assert trades(st.dip_bracket(as_bars(engines.bars(6)), st.vectors(1, st.DIP, dip=0.99))) == []


def test_modes_differ():
    b = as_bars(engines.bars(7, 2000))
    assert len({round(trades(st.dip_bracket(b, st.vectors(1, st.DIP, dip=0.005, mode=m)))[-1][6], 6) for m in ("long", "trend", "revert")}) == 3


def test_wider_callback_fewer_turns_and_stricter_rise_fewer_entries():
    b = as_bars(engines.bars(8, 2000))
    turns = [len(trades(st.breakout_straddle(b, st.vectors(1, st.STRADDLE, gap=0.01, callback=x, take=0.5, stop=0.4)))) for x in (0.5, 5.0)]
    bursts = [len(trades(st.momentum_burst(b, st.vectors(1, st.BURST, windows=[2, 2], rise=x)))) for x in (0.001, 0.01)]
    assert turns[1] < turns[0] and bursts[1] <= bursts[0]


def test_over_tables(spark):
    import pandas as pd

    b = engines.bars(9, 400)
    pdf = pd.DataFrame({"symbol": "A", "w": 12, "ts_ms": b["ts"], "o": b["o"], "h": b["h"], "l": b["l"], "c": b["c"], "ma": b["ma"], "config_id": 5})
    frame = spark.createDataFrame(pd.concat([pdf, pdf.assign(symbol="B")])).repartition(4)
    configs = spark.createDataFrame([(1, 12, 0.003, None), (2, 12, None, "trend")], "config_id long, w int, dip double, mode string")
    got = st.replay_strategy(frame, configs, "dip").toPandas()
    assert set(zip(got.symbol, got.config_id)) == {(s, k) for s in "AB" for k in (1, 2)}
    s = {(r["symbol"], r["config_id"]): r for r in st.summary(st.replay_strategy(frame, configs, "dip"), ["symbol", "config_id"], liquidations="stop").collect()}
    one = got[(got.symbol == "A") & (got.config_id == 1)].sort_values("exit_ts")
    assert s["A", 1]["n_trades"] == len(one) and s["A", 1]["growth"] == pytest.approx(one.balance.iloc[-1] / 10_000)
    assert s["A", 1]["max_dd"] == pytest.approx((1 - one.balance / one.balance.cummax()).max() * 100)
    assert st.replay_strategy(frame.limit(0), configs, "dip").count() == 0

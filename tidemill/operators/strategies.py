"""Three further strategies over bars, many configurations at once: a dip bracket, a breakout straddle, a momentum burst.

As in ``fold``, prices that a position waits for are kept times its direction, and all configurations of a series are
stepped together. None of them leaves a position on the bar that opened it, and only the straddle opens one on a bar
that closed another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import fold
from tidemill.operators import metrics as mt
from tidemill.operators.fold import DEAD, Bars

#: Columns of the configurations of each strategy and their defaults; ``windows`` are lengths in bars, nearest first.
COMMON: dict[str, Any] = {"w": 0, "lev": 1.0, "fee": 0.0, "mmr": 0.005, "liq": True}
DIP = COMMON | {"dip": 0.01, "take": 0.03, "stop": 0.02, "mode": "long"}
STRADDLE = COMMON | {"gap": 0.01, "callback": 1.0, "take": 0.05, "stop": 0.05}
BURST = COMMON | {"windows": [15, 15], "rise": 0.01, "callback": 1.0}
REASONS = np.array(["SL", "TP", "REVERSE", "LIQ", "TRAIL"])


class _Book:
    def __init__(self, cfg: dict[str, np.ndarray], start: float) -> None:
        k = len(cfg["lev"])
        self.cfg, self.bal, self.pos = cfg, np.full(k, start), np.zeros(k)
        self.entry, self.qty, self.bal0, self.risk = (np.zeros(k) for _ in range(4))
        self.best, self.stop, self.liq = (np.full(k, -np.inf) for _ in range(3))
        self.take = np.full(k, np.inf)
        self.opened = np.zeros(k, np.int64)
        self.closed: list[tuple[np.ndarray, ...]] = []

    def enter(self, q: np.ndarray, t: int, side: np.ndarray, price: np.ndarray, stop: np.ndarray | None, take: np.ndarray | None, risk: np.ndarray) -> None:
        """``stop`` and ``take`` are shares of the entry price; ``risk`` is a share of the notional."""
        c = self.cfg
        self.pos[q], self.entry[q], self.best[q], self.opened[q] = side, price, side * price, t
        self.qty[q] = self.bal[q] * c["lev"][q] / price
        self.bal0[q] = self.bal[q]
        self.bal[q] -= c["fee"][q] * self.qty[q] * price
        self.risk[q] = risk * self.qty[q] * price
        self.stop[q] = -np.inf if stop is None else side * (price * (1 - side * stop))
        self.take[q] = np.inf if take is None else side * (price * (1 + side * take))
        self.liq[q] = np.where(c["liq"][q], side * (price * (1 - side * (1 - c["mmr"][q]) / c["lev"][q])), -np.inf)

    def leave(self, q: np.ndarray, t: int, price: np.ndarray, why: int) -> None:
        """At ``price``; a liquidation takes what was put in."""
        if not len(q):
            return
        c = self.cfg
        if REASONS[why] == "LIQ":
            self.bal[q] = np.maximum(self.bal[q] - self.bal0[q], 0.0)
        else:
            self.bal[q] += (price - self.entry[q]) * self.pos[q] * self.qty[q] - c["fee"][q] * self.qty[q] * price
        notional = self.qty[q] * self.entry[q]
        self.closed.append((q, self.opened[q], np.full(len(q), t, np.int64), self.pos[q], self.entry[q], price, self.qty[q], self.bal[q] - self.bal0[q], self.bal[q], np.full(len(q), why), c["lev"][q], self.risk[q], self.risk[q] / np.where(notional > 0, notional, 1.0)))
        self.pos[q] = 0
        self.stop[q], self.liq[q], self.take[q] = -np.inf, -np.inf, np.inf


def _seen(a: _Book, b: Bars, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(held, worst, best, opening) of the bar, prices times direction."""
    up = a.pos > 0
    return a.pos != 0, np.where(up, b.l[i], -b.h[i]), np.where(up, b.h[i], -b.l[i]), a.pos * b.o[i]


def dip_bracket(b: Bars, cfg: dict[str, np.ndarray], start: float = 10_000.0, floor: int = 1) -> _Book:
    """A limit order ``dip`` below the last close (above it for a short), then one stop and one target.

    An order that the bar opens beyond is filled at the opening. ``mode``: "long", "trend" (long above the average,
    short below) or "revert" (the reverse); without an average there is no side.
    """
    a = _Book(cfg, start)
    long, sign = cfg["mode"] == "long", np.where(cfg["mode"] == "revert", -1.0, 1.0)
    usable = (~np.isnan(b.ma)) & (b.ma > 0)
    for i in range(max(1, floor), len(b.c)):
        held, worst, best, opening = _seen(a, b, i)
        if held.any():
            dead = held & (worst <= a.liq) & ((a.stop <= a.liq) | (opening <= a.liq))
            stopped = held & ~dead & (worst <= a.stop)
            done = held & ~dead & ~stopped & (best >= a.take)
            for mask, at, why in ((dead, a.liq, 3), (stopped, a.stop, 0), (done, a.take, 1)):
                q = np.flatnonzero(mask)
                a.leave(q, b.ts[i], a.pos[q] * at[q], why)
        trend = np.where(b.c[i - 1] > b.ma[i], sign, -sign) if usable[i] else np.zeros(len(sign))
        side = np.where(long, 1.0, trend)
        limit = side * (b.c[i - 1] * (1 - side * cfg["dip"]))
        q = np.flatnonzero(~held & (a.bal > DEAD) & (side != 0) & (np.where(side > 0, b.l[i], -b.h[i]) <= limit))
        if len(q):
            a.enter(q, b.ts[i], side[q], side[q] * np.minimum(limit[q], side[q] * b.o[i]), cfg["stop"][q], cfg["take"][q], cfg["stop"][q])
    return a


def breakout_straddle(b: Bars, cfg: dict[str, np.ndarray], start: float = 10_000.0, floor: int = 1) -> _Book:
    """Orders ``gap`` above and below the last close; then turned round by a trailing callback (percent) or the target.

    If both orders are touched, the one nearer to the opening is filled (the upper one if equally near), at its own
    price. The best price takes in the bar's own extreme before the callback is tested, the callback goes before the
    target, and a hard stop leaves the market.
    """
    a = _Book(cfg, start)
    back = cfg["callback"] / 100
    for i in range(max(1, floor), len(b.c)):
        held, worst, best, opening = _seen(a, b, i)
        if held.any():
            a.best = np.where(held, np.maximum(a.best, best), a.best)
            trail = a.best * (1 - a.pos * back)
            dead = held & (worst <= a.liq) & ((a.stop <= a.liq) | (opening <= a.liq))
            stopped = held & ~dead & (worst <= a.stop)
            pulled = (back > 0) & (worst <= trail)
            turned = held & ~dead & ~stopped & (pulled | ((cfg["take"] > 0) & (best >= a.take)))
            for mask, at, why in ((dead, a.liq, 3), (stopped, a.stop, 0)):
                q = np.flatnonzero(mask)
                a.leave(q, b.ts[i], a.pos[q] * at[q], why)
            q = np.flatnonzero(turned)
            if len(q):
                side = a.pos[q].copy()
                price = side * np.where(pulled[q], trail[q], a.take[q])
                a.leave(q, b.ts[i], price, 2)
                on = a.bal[q] > DEAD
                q, side, price = q[on], -side[on], price[on]
                a.enter(q, b.ts[i], side, price, cfg["stop"][q], cfg["take"][q], cfg["stop"][q])
        up, down = b.c[i - 1] * (1 + cfg["gap"]), b.c[i - 1] * (1 - cfg["gap"])
        over, under = b.h[i] >= up, b.l[i] <= down
        nearer_up = np.abs(b.o[i] - up) <= np.abs(b.o[i] - down)
        side = np.where(over & (~under | nearer_up), 1.0, np.where(under, -1.0, 0.0))
        q = np.flatnonzero(~held & (a.bal > DEAD) & (side != 0))
        if len(q):
            a.enter(q, b.ts[i], side[q], np.where(side > 0, up, down)[q], cfg["stop"][q], cfg["take"][q], cfg["stop"][q])
    return a


def _changes(c: np.ndarray, windows: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) change over consecutive windows back from each bar; NaN where they don't fit or a price is no price."""
    n, off = len(c), 0
    lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
    bad = np.arange(n) <= sum(windows)
    for w in windows:
        change = np.full(n, np.nan)
        first, last = c[: n - off - w], c[w : n - off]
        with np.errstate(divide="ignore", invalid="ignore"):
            change[off + w :] = np.where(first > 0, (last - first) / first, np.nan)
        bad |= np.isnan(change)
        lo, hi = np.fmin(lo, change), np.fmax(hi, change)
        off += w
    return np.where(bad, np.nan, lo), np.where(bad, np.nan, hi)


def momentum_burst(b: Bars, cfg: dict[str, np.ndarray], start: float = 10_000.0, floor: int = 0) -> _Book:
    """Enters at the close when every window rose (fell) by ``rise``; leaves by a trailing callback (percent)."""
    a = _Book(cfg, start)
    kinds = sorted({tuple(w) for w in cfg["windows"]})
    of = np.array([kinds.index(tuple(w)) for w in cfg["windows"]])
    spans = [_changes(b.c, w) for w in kinds]
    back = cfg["callback"] / 100
    for i in range(max(1, floor), len(b.c)):
        held, worst, best, opening = _seen(a, b, i)
        if held.any():
            a.best = np.where(held, np.maximum(a.best, best), a.best)
            trail = a.best * (1 - a.pos * back)
            dead = held & (worst <= a.liq) & (opening <= a.liq)
            out = held & ~dead & (worst <= trail)
            for mask, at, why in ((dead, a.liq, 3), (out, trail, 4)):
                q = np.flatnonzero(mask)
                a.leave(q, b.ts[i], a.pos[q] * at[q], why)
        least, most = (np.array([s[k][i] for s in spans])[of] for k in (0, 1))
        with np.errstate(invalid="ignore"):
            side = np.where(least >= cfg["rise"], 1.0, np.where(most <= -cfg["rise"], -1.0, 0.0))
        q = np.flatnonzero(~held & (a.bal > DEAD) & (side != 0))
        if len(q):
            a.enter(q, b.ts[i], side[q], np.full(len(q), b.c[i]), None, None, np.where(back[q] > 0, back[q], 1.0))
    return a


ENGINES: dict[str, tuple[Callable[..., _Book], dict[str, Any]]] = {"dip": (dip_bracket, DIP), "straddle": (breakout_straddle, STRADDLE), "burst": (momentum_burst, BURST)}


def vectors(k: int, columns: dict[str, Any], **given: Any) -> dict[str, np.ndarray]:
    """Parameters of k configurations, ``given`` as one value or one for each."""
    out = {}
    for name, v in columns.items():
        x = given.get(name, v)
        each = list(x) if isinstance(x, (list, tuple, np.ndarray)) and (name != "windows" or (len(x) and isinstance(x[0], (list, tuple, np.ndarray)))) else [x] * k
        if name == "windows":
            out[name] = np.empty(k, object)
            out[name][:] = [tuple(int(y) for y in w) for w in each]
        else:
            out[name] = np.array(each, bool if name == "liq" else object if name == "mode" else float)
    return out


def _completed(configs: DataFrame, columns: dict[str, Any]) -> DataFrame:
    kinds = {"w": "int", "liq": "boolean", "mode": "string", "windows": "array<int>"}
    whole = lambda name, v: F.array(*map(F.lit, v)) if name == "windows" else F.lit(v)
    have = set(configs.columns)
    return configs.select("config_id", *((F.coalesce(F.col(n), whole(n, v)) if n in have else whole(n, v)).cast(kinds.get(n, "double")).alias(n) for n, v in columns.items()))


def replay_strategy(bars: DataFrame, configs: DataFrame, kind: str, keys: Sequence[str] = ("symbol",), start: float = 10_000.0, floor_per_w: int = 0) -> DataFrame:
    """(keys, POSITION) of every configuration of strategy ``kind`` (a name of ENGINES) on every series.

    ``bars`` is (keys, w, ts_ms, o, h, l, c, ma); strategies without an average have w = 0 and a null ma. Columns that the
    configurations lack, and nulls in them, take the strategy's defaults. Empty inputs give no positions.
    """
    engine, columns = ENGINES[kind]
    names = list(keys)
    handed, work = fold.spread(fold.cleaned(bars, names), _completed(configs, columns), names)
    schema = fold.arrow_schema(bars, names, fold.POSITION)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = tuple(k.as_py() for k in key)[: len(names)]
        right = right.sort_by("config_id")
        b, ids = fold.series_of(left), right["config_id"].to_numpy()
        given = {n: right[n].to_pylist() for n in columns}
        found = []
        for s in range(0, len(ids), fold.VECTOR):
            part = {n: v[s : s + fold.VECTOR] for n, v in given.items()}
            floor = floor_per_w * int(part["w"][0])
            closed = engine(b, vectors(len(part["lev"]), columns, **part), start, max(1, floor)).closed
            found.append(_table(key, closed, ids[s : s + fold.VECTOR], schema))
        return pa.concat_tables(found)

    by = [*names, "w", "chunk"]
    return handed.groupBy(*by).cogroup(work.groupBy(*by)).applyInArrow(run, f"{fold.kinds_of(bars, names)}, {fold.POSITION}")


def _table(key: tuple, closed: list[tuple[np.ndarray, ...]], ids: np.ndarray, schema: pa.Schema) -> pa.Table:
    if not closed:
        return schema.empty_table()
    c = [np.concatenate(x) for x in zip(*closed)]
    out = [pa.repeat(k, len(c[0])) for k in key]
    out += [pa.array(x) for x in (ids[c[0]], c[1], c[2], np.where(c[3] > 0, "LONG", "SHORT"), *c[4:9], REASONS[c[9]], *c[10:])]
    return pa.table([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)


def summary(positions: DataFrame, by: Sequence[str], start: float = 10_000.0, liquidations: str = "apart") -> DataFrame:
    """(by, n_trades, growth, max_dd, green, stop_share, liquidations, gt5r) of runs with two closes or more.

    The drawdown's peak begins at the first close; green is the share of calendar months, in percent, that end above
    the month before. Liquidations are "apart" (no trades), count as "stop" or as "exit" (trades, but no stops).
    """
    by = list(by)
    counted = F.lit(True) if liquidations != "apart" else F.col("reason") != "LIQ"
    stops = F.col("reason").isin("SL", "LIQ") if liquidations == "stop" else F.col("reason") == "SL"
    base = positions.groupBy(*by).agg(
        F.count_if(counted).alias("n_trades"), (F.max_by("balance", "exit_ts") / start).alias("growth"), F.coalesce(F.avg(F.when(counted, stops.cast("double"))), F.lit(0.0)).alias("stop_share"),
        F.count_if(F.col("reason") == "LIQ").alias("liquidations"), F.count_if((F.col("risk") > 0) & (F.try_divide("pnl", "risk") > 5)).alias("gt5r"), F.count("*").alias("_closes"),
    )
    dd = mt.drawdown(positions, by, "exit_ts", "balance")
    green = mt.green_share(mt.monthly(positions, by, "exit_ts", "balance"), by).drop("months")
    return base.where("_closes >= 2").drop("_closes").join(dd, by).join(green, by, "left")


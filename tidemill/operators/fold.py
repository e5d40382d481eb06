"""Replay of the moving-average crossing strategy over bars, for many configurations at once.

``replay`` is the ordered fold: one pass over the bars of a series, with the state of all configurations in NumPy
vectors. Prices that a position waits for are kept times its direction (+1 or -1), so that one comparison serves long
and short positions: the worst price of a bar falls to a stop, the best one rises to a rung. A bar is screened for all
configurations in a dozen vector operations; those for which something happens are then settled together.

``replay_grid`` runs it over tables. Where a trade's outcome doesn't depend on the balance, ``chain.trade_chain`` gives
the same trades as a relational plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a configuration and their defaults; None is off. ``w`` is the length of the average.
DEFAULTS: dict[str, Any] = {
    "w": 0, "tpd": 0.01, "ntp": 5, "lev": 1.0, "stop": 0.01, "sltp": 2, "maxdist": None, "fee": 0.0, "mmr": 0.005, "liq": True,
    "stop_k": None, "risk_frac": None, "max_lev": 1e9, "trail_mult": None, "runner": 0.0, "taper_ref": None, "taper_near": 1.0, "taper_far": 1.0,
    "boost": None, "boost_from": 0.0, "boost_decay": 0.0, "liq_guard": False, "vol_target": None, "vol_lo": 0.5, "vol_hi": 2.0,
}
#: Parameters that a schedule may change from row to row; a position keeps those of its entry.
SCHEDULED = ("tpd", "ntp", "lev", "stop", "sltp")
#: Switches among the parameters.
SWITCHES = ("liq", "liq_guard")
POSITION = "config_id bigint, open_ts bigint, exit_ts bigint, side string, entry double, exit double, qty double, pnl double, balance double, reason string, lev double, risk double, eff_stop double"
REASONS = np.array(["SL", "TP", "REVERSE", "LIQ"])
DEAD = 1e-9
#: Configurations that are stepped together.
VECTOR = 4096


@dataclass(frozen=True)
class Rules:
    """How a variant of the engine differs; the defaults are the plain one.

    strict: a bar holds the average only if that lies inside, not on the edge. carry: whether the last bar with an
    average held it counts, however far back, and positions are managed on every bar that has one. reenter: a signal
    opens a position on the bar on which another was closed, whatever closed it. trail_now: the volatility trail takes
    the bar's own close, which looks ahead within the bar. dust: quantity that counts as none.
    """

    strict: bool = False
    carry: bool = False
    reenter: bool = False
    trail_now: bool = False
    dust: float = 1e-9

    @staticmethod
    def regime() -> "Rules":
        """The engine with parameters by day and equity marked to market."""
        return Rules(strict=True, carry=True, reenter=True, dust=1e-12)


@dataclass(frozen=True)
class Breaker:
    """After ``streak`` losing exits in a row, entries within ``cooldown`` days get ``mult`` times the leverage."""

    streak: int
    cooldown: int
    mult: float


@dataclass
class Bars:
    """One series in time order; ``ma`` is NaN before the average exists, ``day`` numbers the rows of a schedule."""

    ts: np.ndarray
    o: np.ndarray
    h: np.ndarray
    l: np.ndarray  # noqa: E741
    c: np.ndarray
    ma: np.ndarray
    vol: np.ndarray | None = None
    slow: np.ndarray | None = None
    day: np.ndarray | None = None


def signals(b: Bars, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(signal, live): +1 or -1 where the average lay in the bar before and not in this one; bars on which anything happens."""
    valid = ~np.isnan(b.ma)
    with np.errstate(invalid="ignore"):
        inside = (b.l < b.ma) & (b.ma < b.h) if rules.strict else (b.l <= b.ma) & (b.ma <= b.h)
    signal = np.zeros(len(b.c), np.int8)
    at = np.flatnonzero(valid)
    if not rules.carry:
        live = valid.copy()
        live[1:] &= valid[:-1]
        live[:1] = False
        before = np.flatnonzero(live) - 1
        now = before + 1
    else:
        live, now, before = valid, at[1:], at[:-1]
    cross = now[inside[before] & ~inside[now]]
    signal[cross] = np.where(b.c[cross] > b.ma[cross], 1, -1)
    return signal, live


class Tally:
    """Running measures of K accounts, taken at every close: what a sweep keeps instead of the trades themselves."""

    def __init__(self, k: int, start: float, month: np.ndarray) -> None:
        self.start, self.month = start, month
        self.trades, self.stops, self.liquidated, self.months, self.green = (np.zeros(k, np.int64) for _ in range(5))
        self.last, self.top, self.fall = np.full(k, np.nan), np.full(k, -np.inf), np.zeros(k)
        self.at, self.end = np.full(k, -1, np.int64), np.full(k, np.nan)

    def add(self, q: np.ndarray, i: int, bal: np.ndarray, reason: int) -> None:
        self._turn(q[(self.at[q] >= 0) & (self.at[q] != self.month[i])])
        self.at[q], self.last[q] = self.month[i], bal
        self.trades[q] += reason != 3
        self.liquidated[q] += reason == 3
        self.stops[q] += reason == 0
        self.top[q] = np.maximum(self.top[q], bal)
        self.fall[q] = np.maximum(self.fall[q], 1 - bal / np.where(self.top[q] > 0, self.top[q], 1.0))

    def _turn(self, q: np.ndarray) -> None:
        """The months of these accounts are over."""
        known = ~np.isnan(self.end[q])
        self.months[q] += known
        self.green[q] += known & (self.last[q] > np.nan_to_num(self.end[q]))
        self.end[q] = self.last[q]

    def columns(self) -> list[np.ndarray]:
        self._turn(np.flatnonzero(self.at >= 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            return [self.trades, self.last / self.start, self.fall * 100, self.stops / np.where(self.trades > 0, self.trades, np.nan), self.green / np.where(self.months > 0, self.months, np.nan) * 100, self.liquidated]


@dataclass
class _Book:
    """State of K configurations. ``stop``, ``liq``, ``rung`` and ``trail`` are prices times the direction."""

    k: int
    start: float
    bal: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        k = self.k
        self.bal, self.peak = np.full(k, self.start), np.full(k, self.start)
        self.pos = np.zeros(k)
        self.entry, self.qty, self.rem, self.bal0, self.lev, self.risk, self.es = (np.zeros(k) for _ in range(7))
        self.opened, self.hit = np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.stop, self.liq, self.trail = (np.full(k, -np.inf) for _ in range(3))
        self.rung = np.full(k, np.inf)
        self.armed = np.zeros(k, bool)  # enough rungs are filled: the stop follows the average or the trail
        self.tpd, self.ntp, self.sltp = np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.streak, self.until = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        self.closed: list[tuple[np.ndarray, ...]] = []
        self.tally: Tally | None = None


def replay(b: Bars, cfg: dict[str, np.ndarray], start: float = 10_000.0, floor: int = 0, rules: Rules = Rules(), schedule: dict[str, np.ndarray] | None = None, breaker: Breaker | None = None, stop_at: int | None = None, daily: int = 0, tally: Tally | None = None) -> tuple[list[np.ndarray], np.ndarray | None, np.ndarray]:
    """(columns of POSITION with the place in ``cfg`` for config_id, equity by day, throttled days) of all configurations.

    ``floor`` is the least bar number that trades, ``stop_at`` the first that no longer does. ``schedule`` gives
    SCHEDULED parameters as (row, configuration) matrices, rows named by ``b.day``. With ``daily`` days the equity,
    marked to the close, is kept as of each day's last bar (NaN for a day without one); on a bar without an average it
    is the balance. With a ``tally`` the closes go there and no positions are kept.
    """
    k = len(cfg["lev"])
    a = _Book(k, start)
    a.tally = tally
    signal, live = signals(b, rules)
    n = len(b.c) if stop_at is None else min(stop_at, len(b.c))
    equity = np.full((daily, k), np.nan) if daily else None
    throttled = np.zeros((daily, k), bool)
    limit = np.nan_to_num(cfg["maxdist"], nan=0.0)
    guarded = bool((limit > 0).any())
    trailing = np.nan_to_num(cfg["trail_mult"], nan=0.0)
    trails = b.vol is not None and bool((trailing > 0).any())
    for i in range(0 if daily else min(max(floor, 1), n), n):
        if live[i] and i >= floor:
            sig, ma = int(signal[i]), b.ma[i]
            before = a.pos if sig == 0 else a.pos.copy()
            done = _manage(a, i, b, cfg, rules, sig, trailing if trails else None, breaker)
            if sig:
                free = (a.pos == 0) & (a.bal > (0.0 if rules.carry else DEAD))
                if not rules.reenter:  # flat before the bar, or just reversed
                    free &= (before == 0) | done
                if guarded and ma:
                    free &= ~((limit > 0) & (abs(b.c[i] - ma) / ma > limit))
                if free.any():
                    _open(a, np.flatnonzero(free), i, sig, b, cfg, schedule, breaker, throttled)
        if equity is not None:
            equity[b.day[i]] = a.bal + (b.c[i] - a.entry) * a.pos * a.rem if live[i] else a.bal
    columns = [np.concatenate(x) for x in zip(*a.closed)] if a.closed else []
    return columns, equity, throttled


def _manage(a: _Book, i: int, b: Bars, cfg: dict, rules: Rules, sig: int, trailing: np.ndarray | None, breaker: Breaker | None) -> np.ndarray:
    """Liquidation, stop, ladder and reverse, in this order; which configurations were reversed."""
    up = a.pos > 0
    worst, best = np.where(up, b.l[i], -b.h[i]), np.where(up, b.h[i], -b.l[i])
    follow = a.pos * b.ma[i]
    if trailing is not None:
        at = i if rules.trail_now else i - 1
        if np.isfinite(b.vol[at]):
            lifted = a.armed & (trailing > 0)
            a.trail = np.where(lifted, np.maximum(a.trail, a.pos * b.c[at] - trailing * b.vol[at] * b.c[at]), a.trail)
        follow = np.where(trailing > 0, a.trail, follow)
    level = np.where(a.armed, np.maximum(a.stop, follow), a.stop)
    dead = worst <= a.liq
    touched = (worst <= level) | dead | (best >= a.rung)
    if sig:
        touched |= a.pos == -sig
    reversed_ = np.zeros(a.k, bool)
    j = np.flatnonzero(touched & (a.pos != 0))
    if not len(j):
        return reversed_
    dead = dead[j]
    if dead.any():
        open_price = a.pos[j] * b.o[i]
        dead &= (level[j] <= a.liq[j]) | (open_price <= a.liq[j])
        q = j[dead]
        if len(q):
            a.bal[q] = np.maximum(a.bal[q] - a.rem[q] / a.qty[q] * a.bal0[q], 0.0)
            _close(a, q, i, b.ts[i], a.pos[q] * a.liq[q], 3)
        j = j[~dead]
    hit = worst[j] <= level[j]
    q = j[hit]
    if len(q):
        price = a.pos[q] * level[q]
        _fill(a, q, price, a.rem[q], cfg)
        if breaker is not None:
            _count(a, q, (price - a.entry[q]) * a.pos[q] <= 0, b.day[i], breaker)
        _close(a, q, i, b.ts[i], price, 0)
    j = j[~hit]
    q = j[best[j] >= a.rung[j]]
    while len(q):
        price = a.pos[q] * a.rung[q]
        last = a.hit[q] == a.ntp[q] - 1
        part = np.where(last, np.maximum(a.rem[q] - cfg["runner"][q] * a.qty[q], 0.0), a.qty[q] / a.ntp[q])
        _fill(a, q, price, np.minimum(part, a.rem[q]), cfg)
        a.hit[q] += 1
        a.armed[q] = a.hit[q] >= a.sltp[q]
        a.streak[q] = 0
        a.rung[q] = np.where(a.hit[q] < a.ntp[q], a.pos[q] * (a.entry[q] * (1 + a.pos[q] * a.tpd[q] * (a.hit[q] + 1))), np.inf)
        gone = a.rem[q] <= rules.dust
        if gone.any():
            _close(a, q[gone], i, b.ts[i], price[gone], 1)
            q = q[~gone]
        q = q[best[q] >= a.rung[q]]
    if sig:
        q = j[a.pos[j] == -sig]
        if len(q):
            before = a.bal[q].copy()
            _fill(a, q, np.full(len(q), b.c[i]), a.rem[q], cfg)
            if breaker is not None:
                _count(a, q, a.bal[q] < before, b.day[i], breaker)
            _close(a, q, i, b.ts[i], np.full(len(q), b.c[i]), 2)
            reversed_[q] = True
    return reversed_


def _count(a: _Book, q: np.ndarray, lost: np.ndarray, day: int, breaker: Breaker) -> None:
    a.streak[q] = np.where(lost, a.streak[q] + 1, 0)
    a.until[q] = np.where(lost & (a.streak[q] >= breaker.streak), day + breaker.cooldown, a.until[q])


def _fill(a: _Book, q: np.ndarray, price: np.ndarray, amount: np.ndarray, cfg: dict) -> None:
    a.bal[q] += (price - a.entry[q]) * a.pos[q] * amount - cfg["fee"][q] * amount * price
    a.rem[q] -= amount


def _close(a: _Book, q: np.ndarray, i: int, t: int, price: np.ndarray, reason: int) -> None:
    if a.tally is not None:
        a.tally.add(q, i, a.bal[q], reason)
    else:
        a.closed.append((q, a.opened[q], np.full(len(q), t, np.int64), a.pos[q], a.entry[q], price, a.qty[q], a.bal[q] - a.bal0[q], a.bal[q], np.full(len(q), reason), a.lev[q], a.risk[q], a.es[q]))
    a.pos[q], a.rem[q] = 0, 0.0
    a.stop[q], a.liq[q], a.rung[q], a.trail[q], a.armed[q] = -np.inf, -np.inf, np.inf, -np.inf, False
    a.peak[q] = np.maximum(a.peak[q], a.bal[q])


def _size(a: _Book, q: np.ndarray, i: int, price: float, es: np.ndarray, lev: np.ndarray, b: Bars, cfg: dict) -> np.ndarray:
    """Quantity of each entry: leverage on the balance, or a fixed share at risk, within the caps, tapered by distance."""
    of = {name: cfg[name][q] for name in ("vol_target", "vol_lo", "vol_hi", "boost", "boost_from", "boost_decay", "liq_guard", "mmr", "max_lev", "risk_frac", "taper_ref", "taper_near", "taper_far")}
    bal = a.bal[q]
    with np.errstate(invalid="ignore", divide="ignore"):
        if b.slow is not None and np.isfinite(b.slow[i]) and b.slow[i] > 0:
            lev = lev * np.where(np.isnan(of["vol_target"]), 1.0, np.clip(of["vol_target"] / b.slow[i], of["vol_lo"], of["vol_hi"]))
        down = (a.peak[q] - bal) / a.peak[q]
        grown = np.where(of["boost_decay"] > 0, np.minimum(1.0, (down - of["boost_from"]) / of["boost_decay"]), 1.0)
        lev = lev * np.where((of["boost"] > 1) & (a.peak[q] > 0) & (down >= of["boost_from"]), 1 + (of["boost"] - 1) * grown, 1.0)
        safe = np.where(of["liq_guard"] & (es > 0), (1 - of["mmr"]) / es * 0.999, np.inf)
        cap = np.minimum(of["max_lev"], safe)
        at_risk = ~np.isnan(of["risk_frac"]) & (es > 0)
        lev = np.where(at_risk, np.minimum(of["risk_frac"] / es, cap), np.minimum(lev, cap))
    if b.ma[i]:
        near = np.minimum(1.0, abs(price - b.ma[i]) / b.ma[i] / np.where(of["taper_ref"] > 0, of["taper_ref"], 1.0))
        lev = lev * np.where(of["taper_ref"] > 0, of["taper_near"] + (of["taper_far"] - of["taper_near"]) * near, 1.0)
    return bal * lev / price


def _open(a: _Book, q: np.ndarray, i: int, side: int, b: Bars, cfg: dict, schedule: dict | None, breaker: Breaker | None, throttled: np.ndarray) -> None:
    p = {name: (schedule[name][b.day[i]] if schedule is not None and name in schedule else cfg[name])[q] for name in SCHEDULED}
    price, es, lev = b.c[i], p["stop"], p["lev"]
    if b.vol is not None and np.isfinite(b.vol[i]) and b.vol[i] > 0:
        es = np.where(np.isnan(cfg["stop_k"][q]), es, cfg["stop_k"][q] * b.vol[i])
    if breaker is not None:
        slow = b.day[i] <= a.until[q]
        lev = np.where(slow, lev * breaker.mult, lev)
        if len(throttled):
            throttled[b.day[i], q[slow]] = True
    qty = _size(a, q, i, price, es, lev, b, cfg)
    a.bal0[q] = a.bal[q]
    with np.errstate(invalid="ignore", divide="ignore"):
        a.lev[q] = np.where(a.bal[q] > 0, qty * price / a.bal[q], 0.0)
        away = np.where(cfg["liq"][q] & (a.lev[q] > 0), (1 - cfg["mmr"][q]) / a.lev[q], np.inf)
    a.pos[q], a.hit[q], a.entry[q], a.qty[q], a.rem[q], a.opened[q] = side, 0, price, qty, qty, b.ts[i]
    a.stop[q], a.liq[q], a.trail[q] = side * (price * (1 - side * es)), side * price - price * away, -np.inf
    a.liq[q] = np.where(np.isfinite(away), side * (price * (1 - side * away)), -np.inf)
    a.risk[q], a.es[q] = es * qty * price, es
    a.tpd[q], a.ntp[q], a.sltp[q] = p["tpd"], p["ntp"], p["sltp"]
    a.rung[q] = np.where(a.ntp[q] > 0, side * (price * (1 + side * a.tpd[q])), np.inf)
    a.armed[q] = a.sltp[q] <= 0
    a.bal[q] -= cfg["fee"][q] * qty * price


# ---- over tables -------------------------------------------------------------------------------------------------------


def with_defaults(configs: DataFrame) -> DataFrame:
    """Adds the columns of DEFAULTS that are missing."""
    kinds = {"w": "int", "ntp": "int", "sltp": "int", "liq": "boolean", "liq_guard": "boolean"}
    have = set(configs.columns)
    return configs.select("config_id", *((F.col(k) if k in have else F.lit(v)).cast(kinds.get(k, "double")).alias(k) for k, v in DEFAULTS.items()))


def vectors(rows: pa.Table) -> dict[str, np.ndarray]:
    """Configurations as one vector per parameter; off is NaN."""
    out = {}
    for name in DEFAULTS:
        x = rows[name].to_numpy(zero_copy_only=False)
        out[name] = np.array([bool(v) for v in x]) if name in SWITCHES else np.array([np.nan if v is None else v for v in x], float) if x.dtype == object else x.astype(float)
    return out


def defaults(k: int, **given: Any) -> dict[str, np.ndarray]:
    """Vectors of k configurations, for direct use of ``replay``."""
    out = {}
    for name, v in DEFAULTS.items():
        x = np.full(k, np.nan if v is None else v, bool if name in SWITCHES else float)
        if name in given and given[name] is not None:
            x[:] = np.array([np.nan if g is None else g for g in given[name]], float) if np.iterable(given[name]) else given[name]
        out[name] = x
    return out


def _slice(cfg: dict[str, np.ndarray], part: slice) -> dict[str, np.ndarray]:
    return {k: v[part] for k, v in cfg.items()}


def series_of(left: pa.Table) -> Bars:
    """The bars of one series from a task's table."""
    left = left.sort_by("ts_ms")
    col = lambda x: left[x].to_numpy(zero_copy_only=False).astype(float) if x in left.column_names else None
    return Bars(left["ts_ms"].to_numpy().astype(np.int64), col("o"), col("h"), col("l"), col("c"), col("ma"), col("vol"), col("vol_slow"))


def cleaned(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, w, ts_ms, o, h, l, c, ma, vol, vol_slow) of the bars that have h, l and c; o falls back to c."""
    rows = bars.where("h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL AND ts_ms IS NOT NULL")
    for extra in ("vol", "vol_slow"):
        if extra not in bars.columns:
            rows = rows.withColumn(extra, F.lit(None).cast("double"))
    return rows.select(*keys, "w", "ts_ms", F.coalesce("o", "c").alias("o"), "h", "l", "c", "ma", "vol", "vol_slow")


def spread(bars: DataFrame, configs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(bars, configurations) with ``chunk``, to be cogrouped by (keys, w, chunk).

    A chunk is VECTOR configurations or more: there are at most as many chunks of a length w as keep all task slots
    busy twice over, so a series is handed out at most so many times, however large the grid.
    """
    names = list(keys)
    slots = 2 * bars.sparkSession.sparkContext.defaultParallelism
    lengths = configs.groupBy("w").agg(F.count("*").alias("_n"))
    held = bars.select(*names, "w").distinct()
    series = held.groupBy("w").agg(F.count("*").alias("_s"))
    cuts = lengths.join(series, "w").select("w", F.greatest(F.lit(1), F.least(F.ceil(F.col("_n") / VECTOR), F.ceil(F.lit(slots) / F.col("_s")))).cast("int").alias("_cuts"))
    work = configs.join(cuts, "w").withColumn("chunk", F.pmod(F.xxhash64("config_id"), F.col("_cuts")).cast("int")).drop("_cuts")
    handed = bars.join(cuts, "w").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
    work = work.join(held.select(*(F.col(c).alias(c) for c in (*names, "w"))), "w")
    return handed, work.select(*(F.col(c).alias(c) for c in work.columns))


def positions_table(key: tuple, columns: list[np.ndarray], ids: np.ndarray, schema: pa.Schema) -> pa.Table:
    """Columns of ``replay`` as rows of (key, POSITION)."""
    if not columns:
        return schema.empty_table()
    n = len(columns[0])
    out = [pa.repeat(k, n) for k in key]
    out += [pa.array(x) for x in (ids[columns[0]], columns[1], columns[2], np.where(columns[3] > 0, "LONG", "SHORT"), *columns[4:9], REASONS[columns[9]], *columns[10:])]
    return pa.table([x.cast(f.type) for x, f in zip(out, schema)], schema=schema)


def kinds_of(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for n in names for f in df.schema if f.name == n)


def arrow_schema(df: DataFrame, names: Sequence[str], more: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(", ".join(x for x in (kinds_of(df, names), more) if x)))


def replay_grid(bars: DataFrame, configs: DataFrame, keys: Sequence[str] = ("symbol",), start: float = 10_000.0, floor_per_w: int = 0, rules: Rules = Rules(), half: str | None = None) -> DataFrame:
    """(keys, POSITION) of every configuration on every series.

    ``bars`` is (keys, w, ts_ms, o, h, l, c, ma[, vol, vol_slow]): one copy of a series for each average length w that
    the configurations have. The fold is sequential by nature, so its unit of distribution is (series, w, chunk); see
    ``spread``. ``half`` runs only the first ("is") or the second ("oos") half of the bars that can trade, from a fresh
    balance. Bars without h, l or c are left out; a series without bars, or an empty configuration table, gives no
    positions.
    """
    names = list(keys)
    handed, work = spread(cleaned(bars, names), with_defaults(configs), names)
    schema = arrow_schema(bars, names, POSITION)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = tuple(k.as_py() for k in key)
        right = right.sort_by("config_id")
        b, cfg, ids = series_of(left), vectors(right), right["config_id"].to_numpy()
        floor, stop_at = floor_per_w * int(right["w"][0].as_py()), None
        if half is not None:
            valid = np.flatnonzero(~np.isnan(b.ma))
            first = max(int(valid[0]) + 1 if len(valid) else len(b.c), floor)
            middle = (first + len(b.c)) // 2
            floor, stop_at = (first, middle) if half == "is" else (middle, None)
        found = [positions_table(key[: len(names)], replay(b, _slice(cfg, part), start, floor, rules, stop_at=stop_at)[0], ids[part], schema) for part in (slice(s, s + VECTOR) for s in range(0, len(ids), VECTOR))]
        return pa.concat_tables(found)

    by = [*names, "w", "chunk"]
    return handed.groupBy(*by).cogroup(work.groupBy(*by)).applyInArrow(run, ", ".join(x for x in (kinds_of(bars, names), POSITION) if x))


METRICS = "config_id bigint, n_trades bigint, growth double, max_dd double, stop_share double, green double, liquidations bigint"


def replay_metrics(bars: DataFrame, configs: DataFrame, keys: Sequence[str] = ("symbol",), start: float = 10_000.0, floor_per_w: int = 0, rules: Rules = Rules()) -> DataFrame:
    """(keys, METRICS): one row for every configuration and series, measured while it runs, for sweeps.

    Growth and drawdown are those of the closes (the drawdown's peak begins at the first), green is the share, in
    percent, of the months with a close that end above the month with a close before. Without a close they are null.
    """
    names = list(keys)
    handed, work = spread(cleaned(bars, names), with_defaults(configs), names)
    schema = arrow_schema(bars, names, METRICS)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = tuple(k.as_py() for k in key)[: len(names)]
        right = right.sort_by("config_id")
        b, cfg, ids = series_of(left), vectors(right), right["config_id"].to_numpy()
        month = b.ts.astype("datetime64[ms]").astype("datetime64[M]").astype(np.int64)
        found = []
        for part in (slice(s, s + VECTOR) for s in range(0, len(ids), VECTOR)):
            cut = _slice(cfg, part)
            tally = Tally(len(cut["lev"]), start, month)
            replay(b, cut, start, floor_per_w * int(right["w"][0].as_py()), rules, tally=tally)
            c = tally.columns()
            out = [pa.repeat(k, len(c[0])) for k in key] + [pa.array(ids[part]), *(pa.array(x, mask=np.isnan(x) if x.dtype.kind == "f" else None) for x in c)]
            found.append(pa.table([x.cast(f.type) for x, f in zip(out, schema)], schema=schema))
        return pa.concat_tables(found)

    by = [*names, "w", "chunk"]
    return handed.groupBy(*by).cogroup(work.groupBy(*by)).applyInArrow(run, ", ".join(x for x in (kinds_of(bars, names), METRICS) if x))


EQUITY = "config_id bigint, day bigint, equity double, throttled boolean"


def replay_regime(bars: DataFrame, configs: DataFrame, schedule: DataFrame | None = None, keys: Sequence[str] = ("symbol",), start: float = 10_000.0, rules: Rules = Rules.regime(), breaker: Breaker | None = None) -> DataFrame:
    """(keys, EQUITY): equity, marked to market, at the end of every day, of the engine whose parameters change by day.

    ``schedule`` is (keys, config_id, day and any of SCHEDULED): the parameters of entries on that day; where it says
    nothing (no row, or null) the configuration's own hold. ``throttled`` tells the days on which the breaker lowered
    an entry's leverage.
    """
    names = list(keys)
    full = with_defaults(configs).withColumn("liq", F.lit(False))
    part = [] if schedule is None else [c for c in SCHEDULED if c in schedule.columns]
    if schedule is not None:
        rows = schedule.groupBy(*names, "config_id").agg(F.collect_list(F.struct("day", *(F.col(c).cast("double").alias(c) for c in part))).alias("_plan"))
    handed, work = spread(cleaned(bars, names), full, names)
    work = work.join(rows, [*names, "config_id"], "left") if schedule is not None else work
    work = work.select(*(F.col(c).alias(c) for c in work.columns))
    schema = arrow_schema(bars, names, EQUITY)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = tuple(k.as_py() for k in key)[: len(names)]
        right = right.sort_by("config_id")
        b, cfg, ids = series_of(left), vectors(right), right["config_id"].to_numpy()
        days, b.day = np.unique(b.ts // 86_400_000, return_inverse=True)
        plan = {c: np.tile(cfg[c], (len(days), 1)) for c in part}
        if part:
            for j, said in enumerate(right["_plan"].to_pylist()):
                for row in said or ():
                    at = np.searchsorted(days, row["day"])
                    if at < len(days) and days[at] == row["day"]:
                        for c in part:
                            if row[c] is not None:
                                plan[c][at, j] = row[c]
        found = []
        for s in range(0, len(ids), VECTOR):
            cut = slice(s, s + VECTOR)
            _, equity, slow = replay(b, _slice(cfg, cut), start, 0, rules, {c: v[:, cut] for c, v in plan.items()} or None, breaker, daily=len(days))
            m = equity.shape[1]
            found.append(pa.table([pa.repeat(k, m * len(days)).cast(f.type) for k, f in zip(key, schema)] + [pa.array(np.repeat(ids[cut], len(days))), pa.array(np.tile(days, m)), pa.array(equity.T.ravel()), pa.array(slow.T.ravel())], schema=schema))
        return pa.concat_tables(found)

    by = [*names, "w", "chunk"]
    return handed.groupBy(*by).cogroup(work.groupBy(*by)).applyInArrow(run, ", ".join(x for x in (kinds_of(bars, names), EQUITY) if x))

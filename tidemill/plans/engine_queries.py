"""Replays of the other engines: by day and marked to market, dip bracket, straddle, burst; summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import fold, strategies
from tidemill.operators import metrics as mt
from tidemill.operators.windows import Frames
from tidemill.plans.registry import CORE
from tidemill.plans.series import D, daily, numbered, r
from tidemill.plans.stat_queries import REPLAY, strategy_inputs

# ---- the plain engine: what becomes of its trades ------------------------------------------------------------------------

_CLOSES = f"WITH RECURSIVE {REPLAY}, t AS (SELECT st.symbol, id::BIGINT AS config_id, n.ts_ms AS exit_ts, st.rn, why, c_bal AS bal, year(make_timestamp(n.ts_ms * 1000)) * 12 + month(make_timestamp(n.ts_ms * 1000)) - 1 AS month FROM st JOIN n ON n.symbol = st.symbol AND n.rn = st.rn WHERE why IS NOT NULL)"
_BY_MONTH = "mb AS (SELECT symbol, config_id, month, arg_max(bal, rn) AS bal FROM t GROUP BY ALL), cal AS (SELECT symbol, config_id, unnest(generate_series(min(month), max(month))) AS month FROM mb GROUP BY symbol, config_id), mf AS (SELECT symbol, config_id, month, last_value(bal IGNORE NULLS) OVER w AS bal FROM cal LEFT JOIN mb USING (symbol, config_id, month) WINDOW w AS (PARTITION BY symbol, config_id ORDER BY month)), mr AS (SELECT *, bal / lag(bal) OVER (PARTITION BY symbol, config_id ORDER BY month) - 1 AS ret FROM mf)"


@CORE.query(
    "replay_summary",
    f"""{_CLOSES}, {_BY_MONTH}, fall AS (SELECT *, 1 - bal / max(bal) OVER (PARTITION BY symbol, config_id ORDER BY rn) AS dd FROM t),
    g AS (SELECT symbol, config_id, avg((ret > 0)::INT) * 100 AS green FROM mr WHERE ret IS NOT NULL GROUP BY ALL)
    SELECT fall.symbol, fall.config_id, count(*) AS n_trades, round(arg_max(bal, rn) / 10000, 8) AS growth, round(max(dd) * 100, 6) AS max_dd, round(avg((why = 'SL')::INT), 6) AS stop_share, round(any_value(green), 6) AS green, 0::BIGINT AS liquidations
    FROM fall LEFT JOIN g USING (symbol, config_id) GROUP BY ALL HAVING count(*) >= 2""",
)
def replay_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Trades, growth, drawdown, share of stops and of green months of each configuration and series."""
    bars, configs = strategy_inputs(spark, sf)
    s = strategies.summary(fold.replay_grid(bars.drop("i"), configs), ["symbol", "config_id"])
    return s.select("symbol", "config_id", "n_trades", r("growth", 8).alias("growth"), r("max_dd").alias("max_dd"), r("stop_share").alias("stop_share"), r("green").alias("green"), "liquidations")


@CORE.query("replay_months", f"{_CLOSES}, {_BY_MONTH} SELECT symbol, config_id, month, round(bal / 10000, 8) AS bal, round(ret, 6) + 0.0 AS ret FROM mr")
def replay_months(spark: SparkSession, sf: str) -> DataFrame:
    """Month-end balances of every configuration, months without a close carried on."""
    bars, configs = strategy_inputs(spark, sf)
    m = mt.monthly(fold.replay_grid(bars.drop("i"), configs), ["symbol", "config_id"], "exit_ts", "balance")
    return m.select("symbol", "config_id", "month", r(F.col("bal") / 10_000, 8).alias("bal"), (r("ret") + 0.0).alias("ret"))


@CORE.query(
    "replay_metrics",
    f"""{_CLOSES}, mb AS (SELECT symbol, config_id, month, arg_max(bal, rn) AS bal FROM t GROUP BY ALL), mr AS (SELECT *, bal > lag(bal) OVER (PARTITION BY symbol, config_id ORDER BY month) AS up FROM mb),
    g AS (SELECT symbol, config_id, avg(up::INT) * 100 AS green FROM mr GROUP BY ALL), fall AS (SELECT *, 1 - bal / max(bal) OVER (PARTITION BY symbol, config_id ORDER BY rn) AS dd FROM t)
    SELECT symbol, config_id, count(*) AS n_trades, round(arg_max(bal, rn) / 10000, 8) AS growth, round(max(dd) * 100, 6) AS max_dd, round(avg((why = 'SL')::INT), 6) AS stop_share, round(any_value(green), 6) AS green FROM fall JOIN g USING (symbol, config_id) GROUP BY ALL""",
)
def replay_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What a sweep keeps of every run: measured in the task that runs it, one row each."""
    bars, configs = strategy_inputs(spark, sf)
    m = fold.replay_metrics(bars.drop("i"), configs).where("n_trades > 0")
    return m.select("symbol", "config_id", "n_trades", r("growth", 8).alias("growth"), r("max_dd").alias("max_dd"), r("stop_share").alias("stop_share"), r("green").alias("green"))


@CORE.query("replay_halves")
def replay_halves(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the second half of the bars, each from a fresh balance: trades and growth in and out of sample."""
    bars, configs = strategy_inputs(spark, sf)
    out = None
    for part in ("is", "oos"):
        p = fold.replay_grid(bars.drop("i"), configs, half=part).groupBy("symbol", "config_id").agg(F.count("*").alias("n_trades"), (F.max_by("balance", "exit_ts") / 10_000).alias("growth")).withColumn("part", F.lit(part))
        out = p if out is None else out.unionByName(p)
    return out


#: One configuration for each way of sizing and leaving, on top of the same base.
IDEAS = {
    "base": {}, "liquidation": {"lev": 40.0, "stop": 0.5}, "vol_stop": {"stop_k": 1.5}, "risk": {"stop_k": 1.5, "risk_frac": 0.02, "max_lev": 1.0}, "taper": {"taper_ref": 0.03, "taper_near": 1.3, "taper_far": 0.2},
    "boost": {"boost": 1.8, "boost_from": 0.05, "boost_decay": 0.1, "liq_guard": True}, "trail": {"trail_mult": 1.5}, "runner": {"runner": 0.2}, "vol_target": {"vol_target": 0.03, "vol_lo": 0.5, "vol_hi": 2.0},
}


def idea_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = Frames(["symbol"])
    d = numbered(daily(spark, sf)).withColumn("ma", f.mean(F.col("c"), 10, 1)).withColumn("x", f.log_return("c"))
    bars = d.select("symbol", F.lit(10).alias("w"), "ts_ms", "o", "h", "l", "c", "ma", f.std(F.col("x"), 10, 1).alias("vol"), f.std(F.col("x"), 40, 1).alias("vol_slow"))
    base = {"w": 10, "tpd": 0.04, "ntp": 3, "lev": 1.0, "stop": 0.06, "sltp": 1, "fee": 0.0005}
    names = sorted({k for v in IDEAS.values() for k in v} | set(base))
    rows = [(n, *(float(x) if isinstance(x := (base | idea).get(k), (int, float)) and not isinstance(x, bool) else x for k in names)) for n, idea in enumerate(IDEAS.values())]
    schema = "config_id bigint, " + ", ".join(f"{k} {'boolean' if k in fold.SWITCHES else 'double'}" for k in names)
    return bars, spark.createDataFrame(rows, schema)


@CORE.query("replay_ideas")
def replay_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """Every way of sizing and leaving in one grid: trades, growth and the marks they leave on size and exit."""
    bars, configs = idea_inputs(spark, sf)
    p = fold.replay_grid(bars, configs)
    name = F.element_at(F.array(*map(F.lit, IDEAS)), (F.col("config_id") + 1).cast("int"))
    return strategies.summary(p, ["symbol", "config_id"]).withColumn("idea", name).drop("config_id")


# ---- parameters by day, equity marked to market --------------------------------------------------------------------------

#: id, rung distance and number, leverage, stop, rungs to trail, distance guard, fee.
REGIME = [(0, 0.05, 3, 1.0, 0.06, 1, None, 0.0), (1, 0.03, 2, 2.0, 0.04, 2, 0.05, 0.001)]
_REGIME_CFG = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in c) + ")" for c in REGIME)
_LEV, _STOP = "CASE day % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END", "(1 + day % 2 * 0.5)"


def regime_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, configurations, and a schedule whose leverage and stop change from day to day."""
    d = numbered(daily(spark, sf)).withColumn("ma", Frames(["symbol"]).mean(F.col("c"), 10, 1))
    configs = spark.createDataFrame(REGIME, "config_id bigint, tpd double, ntp int, lev double, stop double, sltp int, maxdist double, fee double").withColumn("w", F.lit(10))
    plan = d.select("symbol", "day").join(F.broadcast(configs.select("config_id", F.col("lev").alias("_l"), F.col("stop").alias("_s"))))
    plan = plan.select("symbol", "config_id", "day", (F.col("_l") * F.expr(_LEV)).alias("lev"), (F.col("_s") * F.expr(_STOP)).alias("stop"))
    return d.select("symbol", F.lit(10).alias("w"), "ts_ms", "o", "h", "l", "c", "ma"), configs, plan


_REGIME_SQL = f"""{D}, cfg(id, tpd, ntp, lev, stop, sltp, maxdist, fee) AS (VALUES {_REGIME_CFG}),
    x AS (SELECT *, CASE WHEN count(c) OVER w = 10 THEN avg(c) OVER w END AS ma FROM n WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k, l < ma AND ma < h AS ins FROM x WHERE ma IS NOT NULL),
    sg AS (SELECT *, CASE WHEN lag(ins) OVER p AND NOT ins THEN CASE WHEN c > ma THEN 1 ELSE -1 END ELSE 0 END AS sig FROM v WINDOW p AS (PARTITION BY symbol ORDER BY k)),
    st AS (SELECT symbol, id, 0::BIGINT AS k, 0::BIGINT AS day, 0 AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS qty, 0 AS hit, 0.0::DOUBLE AS base, 10000.0::DOUBLE AS bal, 10000.0::DOUBLE AS eq FROM (SELECT DISTINCT symbol FROM n), cfg
      UNION ALL
      SELECT symbol, id, k, day, npos, nentry, nqty, CASE WHEN opens THEN 0 ELSE m END, CASE WHEN opens THEN c * (1 - sig * stop * {_STOP}) ELSE base END, nbal, nbal + (c - nentry) * npos * nqty * CASE WHEN opens THEN 1 ELSE 1 - m / ntp END FROM (
        SELECT *, CASE WHEN opens THEN sig WHEN pos2 = 0 THEN 0 ELSE pos END AS npos, CASE WHEN opens THEN c ELSE entry END AS nentry, CASE WHEN opens THEN bal2 * lev * {_LEV} / c ELSE qty END AS nqty, CASE WHEN opens THEN bal2 - fee * bal2 * lev * {_LEV} ELSE bal2 END AS nbal FROM (
          SELECT *, sig <> 0 AND pos2 = 0 AND bal2 > 0 AND NOT coalesce(maxdist > 0 AND abs(c - ma) / ma > maxdist, false) AS opens FROM (
            SELECT *, CASE WHEN pos1 <> 0 AND sig = -pos1 THEN 0 ELSE pos1 END AS pos2, CASE WHEN pos1 <> 0 AND sig = -pos1 THEN bal1 + (c - entry) * pos1 * qty * (1 - m / ntp) - fee * qty * (1 - m / ntp) * c ELSE bal1 END AS bal2 FROM (
              SELECT *, CASE WHEN pos = 0 OR stopped OR m >= ntp THEN 0 ELSE pos END AS pos1,
                CASE WHEN pos = 0 THEN bal WHEN stopped THEN bal + (level - entry) * pos * qty * (1 - hit / ntp) - fee * qty * (1 - hit / ntp) * level
                     ELSE bal + coalesce(qty / ntp * list_sum(list_transform(generate_series(hit + 1, m), lambda z: entry * tpd * z - fee * entry * (1 + pos * tpd * z))), 0) END AS bal1 FROM (
                SELECT *, CASE WHEN pos = 0 OR stopped THEN hit ELSE hit + len(list_filter(generate_series(hit + 1, ntp), lambda z: (CASE WHEN pos > 0 THEN h ELSE l END - entry * (1 + pos * tpd * z)) * pos >= 0))::INT END AS m FROM (
                  SELECT *, pos <> 0 AND (CASE WHEN pos > 0 THEN l ELSE h END - level) * pos <= 0 AS stopped FROM (
                    SELECT st.symbol, st.id, sg.k, sg.day, st.pos, st.entry, st.qty, st.hit, st.base, st.bal, sg.h, sg.l, sg.c, sg.ma, sg.sig, cfg.tpd, cfg.ntp, cfg.lev, cfg.stop, cfg.maxdist, cfg.fee,
                      CASE WHEN st.hit >= cfg.sltp THEN CASE WHEN st.pos > 0 THEN greatest(st.base, sg.ma) ELSE least(st.base, sg.ma) END ELSE st.base END AS level
                    FROM st JOIN cfg ON cfg.id = st.id JOIN sg ON sg.symbol = st.symbol AND sg.k = st.k + 1))))))))"""


@CORE.query("replay_regime", f"WITH RECURSIVE {_REGIME_SQL} SELECT symbol, id::BIGINT AS config_id, day, round(eq / 10000, 8) AS equity FROM st WHERE k > 0 UNION ALL SELECT symbol, id::BIGINT, day, 1.0::DOUBLE FROM x, cfg WHERE ma IS NULL")
def replay_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Equity at the end of every day of the engine whose leverage and stop are those of the entry's day."""
    bars, configs, plan = regime_inputs(spark, sf)
    return fold.replay_regime(bars, configs, plan).select("symbol", "config_id", "day", r(F.col("equity") / 10_000, 8).alias("equity"))


@CORE.query("replay_breaker")
def replay_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """The same with half the leverage for five days after three losing exits in a row; its throttled days."""
    bars, configs, plan = regime_inputs(spark, sf)
    e = fold.replay_regime(bars, configs, plan, breaker=fold.Breaker(3, 5, 0.5))
    return e.groupBy("symbol", "config_id").agg(F.count("*").alias("days"), F.count_if("throttled").alias("slow_days"), (F.max_by("equity", "day") / F.min_by("equity", "day")).alias("growth"))


# ---- dip bracket, straddle, burst ----------------------------------------------------------------------------------------

_END = "st.symbol, st.id, b.rn, b.ts_ms, st.pos, st.entry, st.qty, st.bal, st.bal0, st.opened, b.o, b.h, b.l, b.c, b.pc"


def _machine(cfg: str, extra: str, cols: str, manage: str, enter: str, best: str = "0.0") -> str:
    """A recursion over bars for one position at a time.

    ``manage`` gives why, px of the exit (null: none); ``enter`` gives side (0: none) and fill of an entry while flat.
    """
    return f"""{D}, cfg AS (SELECT * FROM (VALUES {cfg})), b AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY rn) AS pc{extra} FROM n),
    st AS (SELECT symbol, id, 0::BIGINT AS rn, 0 AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS qty, 10000.0::DOUBLE AS bal, 0.0::DOUBLE AS bal0, 0::BIGINT AS opened, 0.0::DOUBLE AS best, NULL::VARCHAR AS why, 0.0::DOUBLE AS c_bal, 0::BIGINT AS c_open, 0::BIGINT AS ts_ms FROM (SELECT DISTINCT symbol FROM n), cfg
      UNION ALL
      SELECT symbol, id, rn, CASE WHEN opens THEN side WHEN why IS NOT NULL THEN 0 ELSE pos END, CASE WHEN opens THEN fill ELSE entry END, CASE WHEN opens THEN bal1 * lev / fill ELSE qty END, CASE WHEN opens THEN bal1 - fee * bal1 * lev ELSE bal1 END, CASE WHEN opens THEN bal1 ELSE bal0 END, CASE WHEN opens THEN ts_ms ELSE opened END, CASE WHEN opens THEN fill ELSE best1 END, why, bal1, opened, ts_ms FROM (
        SELECT *, bal1 > 1e-9 AND coalesce(side, 0) <> 0 AS opens FROM (
          SELECT *, {enter} FROM (
            SELECT *, CASE why WHEN 'LIQ' THEN greatest(bal - bal0, 0) ELSE bal + coalesce((px - entry) * pos * qty - fee * qty * px, 0) END AS bal1 FROM (
              SELECT *, {manage} FROM (SELECT {_END}, {cols}, CASE WHEN st.pos > 0 THEN b.l ELSE b.h END AS worst, CASE WHEN st.pos > 0 THEN b.h ELSE b.l END AS top, {best} AS best1 FROM st JOIN cfg ON cfg.id = st.id JOIN b ON b.symbol = st.symbol AND b.rn = st.rn + 1))))))"""


_TRADES = "SELECT symbol, id::BIGINT AS config_id, c_open AS open_ts, ts_ms AS exit_ts, why AS reason, round(c_bal / 10000, 8) AS growth FROM st WHERE why IS NOT NULL"


def _trades(p: DataFrame) -> DataFrame:
    return p.select("symbol", "config_id", "open_ts", "exit_ts", "reason", r(F.col("balance") / 10_000, 8).alias("growth"))


def _plain(spark: SparkSession, sf: str, ma: int | None) -> DataFrame:
    d = numbered(daily(spark, sf))
    x = F.lit(None).cast("double") if ma is None else Frames(["symbol"]).mean(F.col("c"), ma, 1)
    return d.select("symbol", F.lit(ma or 0).alias("w"), "ts_ms", "o", "h", "l", "c", x.alias("ma"))


#: id, mode, dip, target, stop, leverage, fee.
DIPS = [(0, "long", 0.01, 0.04, 0.03, 1.0, 0.0005), (1, "trend", 0.005, 0.06, 0.5, 15.0, 0.0), (2, "revert", 0.02, 0.03, 0.05, 2.0, 0.001)]
_DIP_SQL = _machine(
    ", ".join(f"({i}, '{m}', {d}, {t}, {s}, {v}, {f})" for i, m, d, t, s, v, f in DIPS) + ") t(id, mode, dip, take, stop, lev, fee",
    ", CASE WHEN count(c) OVER w = 10 THEN avg(c) OVER w END AS ma",
    "b.ma, cfg.*, st.entry * (1 - st.pos * cfg.stop) AS sl, st.entry * (1 + st.pos * cfg.take) AS tp, st.entry * (1 - st.pos * 0.995 / cfg.lev) AS lq",
    "CASE WHEN pos = 0 THEN NULL WHEN (worst - lq) * pos <= 0 AND ((sl - lq) * pos <= 0 OR (o - lq) * pos <= 0) THEN 'LIQ' WHEN (worst - sl) * pos <= 0 THEN 'SL' WHEN (top - tp) * pos >= 0 THEN 'TP' END AS why, CASE why WHEN 'SL' THEN sl WHEN 'TP' THEN tp END AS px",
    "CASE WHEN pos <> 0 THEN 0 ELSE CASE mode WHEN 'long' THEN 1 WHEN 'trend' THEN CASE WHEN pc > ma THEN 1 WHEN ma IS NOT NULL THEN -1 END ELSE CASE WHEN pc > ma THEN -1 WHEN ma IS NOT NULL THEN 1 END END END AS want, CASE WHEN want > 0 AND l <= pc * (1 - dip) THEN 1 WHEN want < 0 AND h >= pc * (1 + dip) THEN -1 ELSE 0 END AS side, CASE WHEN side > 0 THEN least(pc * (1 - dip), o) ELSE greatest(pc * (1 + dip), o) END AS fill",
).replace("FROM n),\n    st AS", "FROM n WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),\n    st AS")


@CORE.query("dip_bracket", f"WITH RECURSIVE {_DIP_SQL} {_TRADES}")
def dip_bracket(spark: SparkSession, sf: str) -> DataFrame:
    configs = spark.createDataFrame(DIPS, "config_id bigint, mode string, dip double, take double, stop double, lev double, fee double").withColumn("w", F.lit(10))
    return _trades(strategies.replay_strategy(_plain(spark, sf, 10), configs, "dip"))


#: id, gap, callback in percent, target, stop, leverage, fee.
STRADDLES = [(0, 0.01, 3.0, 0.2, 0.05, 1.0, 0.0005), (1, 0.02, 8.0, 0.05, 0.1, 2.0, 0.001), (2, 0.005, 0.0, 0.03, 0.6, 12.0, 0.0)]
_STRADDLE_SQL = _machine(
    ", ".join(str(c) for c in STRADDLES) + ") t(id, gap, cb, take, stop, lev, fee",
    "",
    "cfg.*, st.entry * (1 - st.pos * cfg.stop) AS sl, st.entry * (1 + st.pos * cfg.take) AS tp, st.entry * (1 - st.pos * 0.995 / cfg.lev) AS lq, CASE WHEN st.pos > 0 THEN greatest(st.best, b.h) WHEN st.pos < 0 THEN least(st.best, b.l) ELSE 0 END * (1 - st.pos * cfg.cb / 100) AS trail",
    "CASE WHEN pos = 0 THEN NULL WHEN (worst - lq) * pos <= 0 AND ((sl - lq) * pos <= 0 OR (o - lq) * pos <= 0) THEN 'LIQ' WHEN (worst - sl) * pos <= 0 THEN 'SL' WHEN (cb > 0 AND (worst - trail) * pos <= 0) OR (top - tp) * pos >= 0 THEN 'REVERSE' END AS why, CASE why WHEN 'SL' THEN sl WHEN 'REVERSE' THEN CASE WHEN cb > 0 AND (worst - trail) * pos <= 0 THEN trail ELSE tp END END AS px",
    "CASE WHEN why = 'REVERSE' THEN -pos WHEN pos <> 0 THEN 0 WHEN h >= pc * (1 + gap) AND (l > pc * (1 - gap) OR abs(o - pc * (1 + gap)) <= abs(o - pc * (1 - gap))) THEN 1 WHEN l <= pc * (1 - gap) THEN -1 ELSE 0 END AS side, CASE WHEN why = 'REVERSE' THEN px WHEN side > 0 THEN pc * (1 + gap) ELSE pc * (1 - gap) END AS fill",
    "CASE WHEN st.pos > 0 THEN greatest(st.best, b.h) WHEN st.pos < 0 THEN least(st.best, b.l) ELSE 0 END",
)


@CORE.query("breakout_straddle", f"WITH RECURSIVE {_STRADDLE_SQL} {_TRADES}")
def breakout_straddle(spark: SparkSession, sf: str) -> DataFrame:
    configs = spark.createDataFrame(STRADDLES, "config_id bigint, gap double, callback double, take double, stop double, lev double, fee double").withColumn("w", F.lit(0))
    return _trades(strategies.replay_strategy(_plain(spark, sf, None), configs, "straddle"))


#: id, windows, rise, callback in percent, leverage, fee.
BURSTS = [(0, [2, 3], 0.005, 4.0, 1.0, 0.0005), (1, [1, 1, 1], 0.002, 8.0, 3.0, 0.001), (2, [5], 0.02, 60.0, 20.0, 0.0)]


def _burst_change(windows: list[int], agg: str) -> str:
    off, parts = 0, []
    for w in windows:
        parts.append(f"lag(c, {off}) OVER p / lag(c, {off + w}) OVER p - 1")
        off += w
    body = f"{agg}({', '.join(parts)})" if len(parts) > 1 else parts[0]
    return f"CASE WHEN rn > {sum(windows)} THEN {body} END"


_BURST_SQL = _machine(
    ", ".join(f"({c[0]}, {', '.join(str(x) for x in c[2:])})" for c in BURSTS) + ") t(id, rise, cb, lev, fee",
    "".join(f", {_burst_change(c[1], a)} AS {a[0]}{c[0]}" for c in BURSTS for a in ("least", "greatest")),
    "b.l0, b.l1, b.l2, b.g0, b.g1, b.g2, cfg.*, st.entry * (1 - st.pos * 0.995 / cfg.lev) AS lq, CASE WHEN st.pos > 0 THEN greatest(st.best, b.h) WHEN st.pos < 0 THEN least(st.best, b.l) ELSE 0 END * (1 - st.pos * cfg.cb / 100) AS trail",
    "CASE WHEN pos = 0 THEN NULL WHEN (worst - lq) * pos <= 0 AND (o - lq) * pos <= 0 THEN 'LIQ' WHEN (worst - trail) * pos <= 0 THEN 'TRAIL' END AS why, CASE why WHEN 'TRAIL' THEN trail END AS px",
    "CASE id WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END AS least_change, CASE id WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS most_change, CASE WHEN pos <> 0 THEN 0 WHEN least_change >= rise THEN 1 WHEN most_change <= -rise THEN -1 ELSE 0 END AS side, c AS fill",
    "CASE WHEN st.pos > 0 THEN greatest(st.best, b.h) WHEN st.pos < 0 THEN least(st.best, b.l) ELSE 0 END",
).replace("FROM n),\n    st AS", "FROM n WINDOW p AS (PARTITION BY symbol ORDER BY rn)),\n    st AS")


@CORE.query("momentum_burst", f"WITH RECURSIVE {_BURST_SQL} {_TRADES}")
def momentum_burst(spark: SparkSession, sf: str) -> DataFrame:
    configs = spark.createDataFrame(BURSTS, "config_id bigint, windows array<int>, rise double, callback double, lev double, fee double").withColumn("w", F.lit(0))
    return _trades(strategies.replay_strategy(_plain(spark, sf, None), configs, "burst"))


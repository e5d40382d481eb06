"""Flags of days, feature panels of hours and minutes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import blocks, flags, learn, panels
from tidemill.operators.regular_grid import epoch_ms
from tidemill.operators.windows import Frames, ohlcv
from tidemill.plans.registry import CORE
from tidemill.plans.relational_queries import SIDE, direction
from tidemill.plans.series import D, E, daily, events, numbered, r
from tidemill.plans.stat_queries import features
from tidemill.plans.window_queries import ewm_sql, wilder_sql
from tidemill.session import table

# ---- flags ---------------------------------------------------------------------------------------------------------------


def _adjusted(name: str, src: str, x: str, span: int) -> str:
    q = 1 - 2 / (span + 1)
    return f"{ewm_sql(f'{name}_n', f'n.{x}', 1 - q, x, src)}, {ewm_sql(f'{name}_d', '1', 1 - q, '1', src)}"


def _mean(x: str, n: int, w: str, agg: str = "avg") -> str:
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


_MEANS = (20, 50, 111, 200, 350, 1400)
_FRAMES = ", ".join([f"w{n} AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _MEANS] + [f"b{n} AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (20, 50)] + ["p AS (PARTITION BY symbol ORDER BY rn)"])
_AFTER = lambda x, lo, hi: f"coalesce(bool_or({x}) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN {lo} PRECEDING AND {'CURRENT ROW' if not hi else f'{hi} PRECEDING'}), false)"
_DAY = "DATE '1970-01-01' + day::INT"
_NEXT = "DATE '1970-01-01' + (day + 1)::INT"
_SINCE = "date_diff('day', CASE " + " ".join(f"WHEN dd >= DATE '{h}' THEN DATE '{h}'" for h in reversed(flags.HALVINGS)) + " END, dd)"
_PHASE = f"(day + 0.5 - {flags.NEW_MOON}::DOUBLE - floor((day + 0.5 - {flags.NEW_MOON}::DOUBLE) / {flags.SYNODIC}) * {flags.SYNODIC})"
FLAG_SQL = f"""{D}, gl AS (SELECT symbol, day, rn, c, greatest(c - lag(c) OVER p, 0) AS gain, greatest(lag(c) OVER p - c, 0) AS loss FROM n WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    {wilder_sql('wg', 'gain', 'gl')}, {wilder_sql('wl', 'loss', 'gl')}, {_adjusted('e12', 'n', 'c', 12)}, {_adjusted('e26', 'n', 'c', 26)},
    md AS (SELECT n.symbol, n.rn, e12_n.e / e12_d.e - e26_n.e / e26_d.e AS macd FROM n JOIN e12_n USING (symbol, rn) JOIN e12_d USING (symbol, rn) JOIN e26_n USING (symbol, rn) JOIN e26_d USING (symbol, rn)),
    {_adjusted('e9', 'md', 'macd', 9)},
    lv AS (SELECT symbol, power(10, floor(log10(median(c) FILTER (WHERE c > 0)))) AS s FROM n GROUP BY symbol),
    fa AS (SELECT *, {', '.join(f"{_mean('c', k, f'w{k}')} AS m{k}" for k in _MEANS)}, {_mean('c', 20, 'w20', 'stddev_samp')} AS s20, c / lag(c) OVER p - 1 AS chg, c / lag(c, 10) OVER p - 1 AS c10, c / lag(c, 90) OVER p - 1 AS c90, c / lag(c, 365) OVER p - 1 AS c365,
      {_mean('h', 20, 'b20', 'max')} AS hi20, {_mean('h', 50, 'b50', 'max')} AS hi50, {_mean('v', 20, 'b20')} AS v20, lag(o) OVER p AS o1, lag(c) OVER p AS c1 FROM n WINDOW {_FRAMES}),
    fw AS (SELECT a.symbol, a.rn, CASE WHEN count(b.s20) = 250 THEN (count_if(4 * b.s20 / b.m20 < 4 * a.s20 / a.m20) + (count_if(4 * b.s20 / b.m20 = 4 * a.s20 / a.m20) + 1) / 2) / 250 END AS narrow FROM fa a JOIN fa b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 249 AND a.rn GROUP BY ALL),
    fb AS (SELECT fa.*, coalesce(narrow < 0.10, false) AS squeeze, coalesce(md.macd > e9_n.e / e9_d.e, false) AS bull, coalesce(m111 > 2 * m350, false) AS pi, 100 - 100 / (1 + wg.e / nullif(wl.e, 0)) AS rsi, lv.s,
      coalesce(c10 <= -0.20 AND chg >= 0.05, false) AS cat, coalesce(c > o AND o1 > c1 AND c > o1 AND o < c1, false) AS eng
      FROM fa JOIN fw USING (symbol, rn) JOIN md USING (symbol, rn) JOIN e9_n USING (symbol, rn) JOIN e9_d USING (symbol, rn) JOIN lv USING (symbol) LEFT JOIN wg USING (symbol, rn) LEFT JOIN wl USING (symbol, rn)),
    fo AS (SELECT *, bull AND NOT coalesce(lag(bull) OVER p, false) AS bull_on, pi AND NOT coalesce(lag(pi) OVER p, false) AS pi_on FROM fb WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    fd AS (SELECT symbol, day, rn, m50 > m200 AS golden_state, c365 > 0 AS momentum12m, c90 > 0 AS momentum90d, chg <= -0.05 AS dip5, chg <= -0.10 AS dip10, rsi < 30 AS rsi_oversold, rsi > 70 AS rsi_overbought, c > m200 AS above_ma200, bull AS macd_bull, {_AFTER('bull_on', 5, 0)} AS macd_bullcross_w5,
      c < m20 - 2 * s20 AS bb_lower, c > m20 + 2 * s20 AS bb_upper, {_AFTER('squeeze', 10, 0)} AS squeeze_w10, c > hi20 AND v > 1.5 * v20 AS breakout_highvol, c > hi20 AND v <= 1.5 * v20 AS breakout_lowvol, c > hi50 AS breakout50,
      len(list_filter(generate_series(2, 19), lambda k: abs(c / (k / 2 * s) - 1) < {flags.NEAR})) > 0 AS round_number, c < m200 AS mayer_low, c > 2.4 * m200 AS mayer_high, {_AFTER('pi_on', 90, 0)} AS picycle_w90, c <= 1.05 * m1400 AS near_200wma,
      {_AFTER('cat', 20, 1)} AS deadcat_w20, {_AFTER('eng', 5, 1)} AS engulf_w5 FROM fo),
    fc AS (SELECT symbol, day, {', '.join(f'coalesce(lag({k}) OVER p, false) AS {k}' for k in flags.TECHNICAL)}, deadcat_w20, engulf_w5, {_DAY} AS dd, {_NEXT} AS dn FROM fd WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    fe AS (SELECT * EXCLUDE (dd, dn), month(dd) >= 11 OR month(dd) <= 4 AS nov_apr, month(dd) = 1 AS january, month(dd) = 10 AS october, month(dd) = 9 AS september, isodow(dd) = 1 AS monday, isodow(dd) >= 6 AS weekend, day(dd) >= 28 OR day(dd) <= 2 AS turn_of_month,
      (month(dd) = 12 AND day(dd) >= 27) OR (month(dd) = 1 AND day(dd) <= 2) AS santa, isodow(dd) = 5 AND month(dd + 7) <> month(dd) AS opex_friday,
      ((month(dn) = 7 AND day(dn) = 4) OR (month(dn) = 12 AND day(dn) = 25) OR (month(dn) = 1 AND day(dn) = 1) OR (month(dn) = 11 AND isodow(dn) = 4 AND day(dn) BETWEEN 22 AND 28) OR (month(dn) = 5 AND isodow(dn) = 1 AND day(dn) >= 25) OR (month(dn) = 9 AND isodow(dn) = 1 AND day(dn) <= 7)) AND year(dn) BETWEEN {flags.HOLIDAY_YEARS[0]} AND {flags.HOLIDAY_YEARS[1]} AS pre_holiday,
      {_PHASE} <= 3 OR {_PHASE} >= {flags.LATE} AS new_moon_pm3, abs({_PHASE} - {flags.FULL}) <= 3 AS full_moon_pm3, {', '.join(f'coalesce({_SINCE} >= {365 * k} AND {_SINCE} < {365 * (k + 1)}, false) AS halving_yr{k + 1}' for k in range(4))} FROM fc),
    t AS (SELECT symbol, day, flag, is_on FROM (UNPIVOT fe ON {', '.join([*flags.TECHNICAL, *flags.AFTER, *flags.CALENDAR])} INTO NAME flag VALUE is_on))"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    d = numbered(daily(spark, sf))
    return flags.unpivoted(flags.daily_flags(d, flags.round_levels(d, "symbol")))


@CORE.query("flag_matrix", f"WITH RECURSIVE {FLAG_SQL} SELECT flag, count(*) AS days, coalesce(count_if(is_on), 0)::BIGINT AS days_on FROM t GROUP BY flag")
def flag_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).groupBy("flag").agg(F.count("*").alias("days"), F.count_if("is_on").alias("days_on"))


@CORE.query(
    "flag_battery",
    f"WITH RECURSIVE {FLAG_SQL}, fy AS (SELECT symbol, day, lead(c) OVER (PARTITION BY symbol ORDER BY day) / c - 1 AS y FROM n), o AS (SELECT t.flag, t.is_on, fy.y FROM t JOIN fy USING (symbol, day) WHERE fy.y IS NOT NULL) SELECT flag, coalesce(count_if(is_on), 0)::BIGINT AS n_on, coalesce(count_if(NOT is_on), 0)::BIGINT AS n_off, round(avg(CASE WHEN is_on THEN y END) - avg(CASE WHEN NOT is_on THEN y END), 8) + 0.0 AS diff FROM o GROUP BY flag",
)
def flag_battery(spark: SparkSession, sf: str) -> DataFrame:
    """Next-day return with each flag less without it, all flags in one pass over the unpivoted matrix."""
    o = _flags(spark, sf).join(features(spark, sf).select("symbol", "day", "y"), ["symbol", "day"]).where("y IS NOT NULL")
    on = F.col("is_on")
    return o.groupBy("flag").agg(F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"), (r(F.avg(F.when(on, F.col("y"))) - F.avg(F.when(~on, F.col("y"))), 8) + 0.0).alias("diff"))


@CORE.query(
    "session_returns",
    f"WITH p AS (SELECT DISTINCT pos_id, open_ts, pnl / nullif(balance - pnl, 0) AS ret, {SIDE} AS s FROM positions WHERE exit_ts IS NOT NULL) SELECT CASE WHEN open_ts // 3600000 % 24 BETWEEN 13 AND 20 THEN 'us' WHEN open_ts // 3600000 % 24 < 8 THEN 'asia' ELSE 'other' END AS session, s, count(*) AS n, round(avg(ret), 8) + 0.0 AS mean FROM p GROUP BY ALL",
)
def session_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Mean return of the positions by the session they were opened in, and by side."""
    p = table(spark, sf, "positions").where("exit_ts IS NOT NULL").select("pos_id", "open_ts", F.try_divide("pnl", F.nullif(F.col("balance") - F.col("pnl"), F.lit(0.0))).alias("ret"), direction().alias("s")).distinct()
    return p.groupBy(flags.session_of_day(F.col("open_ts")).alias("session"), "s").agg(F.count("*").alias("n"), (r(F.avg("ret"), 8) + 0.0).alias("mean"))


# ---- hourly panel --------------------------------------------------------------------------------------------------------

_RUN = "sim_id, v"
_MS = "CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 WHEN timestamp < 100000000000000 THEN timestamp ELSE timestamp // 1000 END"
_HOURS = f"""m0 AS (SELECT sim_id, v, {_MS} AS ms, market_price AS price, ma FROM ma_hourly),
    hh AS (SELECT sim_id, v, ms // 3600000 AS hour, arg_max(price, (ms, price)) FILTER (WHERE price IS NOT NULL) AS c, arg_max(ma, (ms, ma)) FILTER (WHERE ma IS NOT NULL) AS ma FROM m0 GROUP BY ALL),
    lo AS (SELECT sim_id, v, min(hour) FILTER (WHERE c IS NOT NULL) AS lo, max(hour) AS hi FROM hh GROUP BY ALL),
    cal AS (SELECT sim_id, v, lo, unnest(generate_series(lo, hi)) AS hour FROM lo WHERE lo IS NOT NULL),
    n AS (SELECT cal.sim_id, cal.v, cal.hour, cal.hour - cal.lo AS rn, last_value(hh.c IGNORE NULLS) OVER w AS c, last_value(hh.ma IGNORE NULLS) OVER w AS ma FROM cal LEFT JOIN hh USING (sim_id, v, hour) WINDOW w AS (PARTITION BY cal.sim_id, cal.v ORDER BY cal.hour))"""


def _ew(name: str, src: str, x: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"{name} AS (SELECT sim_id, v, rn, {x}::DOUBLE AS e FROM {src} WHERE rn = 0 UNION ALL SELECT s.sim_id, s.v, s.rn, p.e * {1 - a} + {a} * s.{x} FROM {name} p JOIN {src} s ON s.sim_id = p.sim_id AND s.v = p.v AND s.rn = p.rn + 1)"


_HW = lambda n, name: f"{name} AS (PARTITION BY sim_id, v ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
HOURLY_SQL = f"""{_HOURS}, {_ew('e12', 'n', 'c', 12)}, {_ew('e26', 'n', 'c', 26)}, mc AS (SELECT sim_id, v, rn, e12.e - e26.e AS macd FROM e12 JOIN e26 USING (sim_id, v, rn)), {_ew('e9', 'mc', 'macd', 9)},
    a AS (SELECT n.*, mc.macd - e9.e AS hist, ln(c / lag(c) OVER p) AS lr, c - lag(c) OVER p AS d FROM n JOIN mc USING (sim_id, v, rn) JOIN e9 USING (sim_id, v, rn) WINDOW p AS (PARTITION BY sim_id, v ORDER BY rn)),
    b AS (SELECT *, c / lag(c) OVER p - 1 AS ret_1h, {_mean('lr', 24, 'w24', 'stddev_samp')} AS vol_24h, (c - ma) / ma AS dist_ma, ma / lag(ma, 24) OVER p - 1 AS ma_slope_24, CASE WHEN count(c) OVER w24 = 24 THEN regr_slope(c, rn) OVER w24 / first_value(c) OVER w24 END AS price_slope_24,
      {', '.join(f'c / lag(c, {k}) OVER p - 1 AS mom_{k}' for k in (5, 10, 20))}, {', '.join(f"(c - {_mean('c', k, f'w{k}')}) / {_mean('c', k, f'w{k}')} AS dist_sma_{k}" for k in (20, 50, 200))},
      100 - 100 / (1 + {_mean('greatest(d, 0)', 14, 'w14').replace('count(greatest(d, 0))', 'count(d)')} / nullif({_mean('greatest(-d, 0)', 14, 'w14').replace('count(greatest(-d, 0))', 'count(d)')}, 0)) AS rsi_14, hist / c AS macd_hist,
      4 * {_mean('c', 20, 'w20', 'stddev_samp')} / {_mean('c', 20, 'w20')} AS bb_width, (c - ({_mean('c', 20, 'w20')} - 2 * {_mean('c', 20, 'w20', 'stddev_samp')})) / nullif(4 * {_mean('c', 20, 'w20', 'stddev_samp')}, 0) AS bb_pos
      FROM a WINDOW p AS (PARTITION BY sim_id, v ORDER BY rn), {', '.join(_HW(k, f'w{k}') for k in (14, 20, 24, 50, 200))}),
    q AS (SELECT *, abs(price_slope_24) / (vol_24h + 1e-9) AS adxproxy, array_agg(vol_24h) OVER w720 AS seen FROM b WINDOW {_HW(720, 'w720')}),
    k AS (SELECT *, CASE WHEN len(list_filter(seen, lambda z: z IS NOT NULL)) = 720 THEN (len(list_filter(seen, lambda z: z < vol_24h)) + (len(list_filter(seen, lambda z: z = vol_24h)) + 1) / 2) / 720 END AS vol_rank, quantile_cont(adxproxy, 0.5) OVER (PARTITION BY sim_id, v ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS typical FROM q),
    panel AS (SELECT sim_id, v, hour AS slot, c, ret_1h, vol_24h, vol_rank, dist_ma, ma_slope_24, price_slope_24, mom_5, mom_10, mom_20, mom_5 AS roc_5, mom_10 AS roc_10, mom_20 AS roc_20, dist_sma_20, dist_sma_50, dist_sma_200, rsi_14, macd_hist, bb_width, bb_pos, adxproxy,
      coalesce(vol_rank < 0.4 AND adxproxy < typical, false)::INT::DOUBLE AS chop, vol_rank * abs(dist_ma) AS x_volrank_distma, bb_width * adxproxy AS x_bbw_adx, (hour % 24)::INT AS hour, ((hour // 24 + 3) % 7)::INT AS dow FROM k)"""
_WHOLE = ("hour", "dow")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly panel of every run of ma_hourly."""
    raw = table(spark, sf, "ma_hourly").select("sim_id", "v", epoch_ms(F.col("timestamp")).alias("ms"), "market_price", "ma")
    return learn.hourly_features(learn.hourly_grid(raw, ["sim_id", "v"], "ms", "market_price", "ma"), ["sim_id", "v"])


def _rounded_sql(names, digits: int = 6) -> str:
    return ", ".join(n if n in _WHOLE else f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _rounded(names, digits: int = 6):
    return [F.col(n) if n in _WHOLE else (r(n, digits) + 0.0).alias(n) for n in names]


@CORE.query("hourly_feature_panel", f"WITH RECURSIVE {HOURLY_SQL} SELECT sim_id, v, slot, {_rounded_sql([x for x in learn.HOURLY if x != 'chop'], 5)}, chop FROM panel")
def hourly_feature_panel(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("sim_id", "v", "slot", *_rounded([x for x in learn.HOURLY if x != "chop"], 5), "chop")


# ---- minute panel --------------------------------------------------------------------------------------------------------

_TICKS = f"{E}, n0 AS (SELECT symbol, ts_ms // 60000 AS minute, max(price) AS h, min(price) AS l, arg_max(price, (ts_ms, event_id)) AS c, count(*)::DOUBLE AS v FROM e GROUP BY ALL), n1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY minute) - 1 AS rn FROM n0), n AS (SELECT *, CASE WHEN count(c) OVER w = 60 THEN avg(c) OVER w END AS ma FROM n1 WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"
_MW = lambda n, name, back=0: f"{name} AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1 + back} PRECEDING AND {'CURRENT ROW' if not back else f'{back} PRECEDING'})"
_AGO = lambda k: f"last_value(c) OVER (PARTITION BY symbol ORDER BY minute RANGE BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING)"
_SLOPE = lambda n: f"CASE WHEN count(c) OVER w{n} = {n} THEN regr_slope(c, rn) OVER w{n} / first_value(c) OVER w{n} END"
MICRO_SQL = f"""{_TICKS}, a AS (SELECT *, ln(c / lag(c) OVER p) AS lr, coalesce(c > ma, false) AS ab FROM n WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    b AS (SELECT *, coalesce(ab <> lag(ab) OVER (PARTITION BY symbol ORDER BY rn), false)::INT AS flip FROM a),
    m AS (SELECT symbol, minute, rn, {', '.join(f'c / {_AGO(k)} - 1 AS m_ret_{k}' for k in (1, 3, 5, 15, 30, 60))}, {_SLOPE(16)} AS m_slope_15, {_SLOPE(61)} AS m_slope_60, m_slope_15 - m_slope_60 AS m_accel, {', '.join(f"{_mean('lr', k, f'w{k}', 'stddev_pop')} AS m_rvol_{k}" for k in (15, 30, 60))},
      {', '.join(f'(sum(v) OVER v{k} / {k}) / (sum(v) OVER v1440 / 1440 + 1e-9) AS m_vspike_{k}' for k in (15, 60))}, (h - l) / c AS m_entrybar_range, {', '.join(f'(sum(flip) OVER w{k})::BIGINT AS m_whip_{k}' for k in (60, 240))}, c / ma - 1 AS m_dist_ma,
      lead(minute) OVER (PARTITION BY symbol ORDER BY rn) AS nxt FROM b WINDOW {', '.join(_MW(k, f'w{k}') for k in (15, 16, 30, 60, 61, 240))}, {', '.join(_MW(k, f'v{k}', 1) for k in (15, 60, 1440))}),
    k AS (SELECT minute, rn, {', '.join(f'c / {_AGO(k)} - 1 AS btc_ret_{k}' for k in (60, 240, 1440))}, c / CASE WHEN count(c) OVER w1441 = 1441 THEN avg(c) OVER w1441 END - 1 AS btc_vs_sma1d, {_SLOPE(241)} AS btc_slope_240 FROM n WHERE symbol = (SELECT min(symbol) FROM n) WINDOW {_MW(241, 'w241')}, {_MW(1441, 'w1441')}),
    kk AS (SELECT * FROM k WHERE rn >= {learn.HISTORY})
    SELECT m.symbol, m.nxt AS minute, {_rounded_sql([x for x in learn.MINUTE if 'whip' not in x])}, m_whip_60, m_whip_240, {', '.join(f'round(CASE WHEN m.minute - kk.minute <= 1440 THEN {x} END, 6) + 0.0 AS {x}' for x in learn.MARKET)}
    FROM m ASOF LEFT JOIN kk ON m.minute >= kk.minute WHERE m.rn >= {learn.HISTORY} AND nxt IS NOT NULL"""


@CORE.query("micro_feature_panel", f"WITH {MICRO_SQL}")
def micro_feature_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars of the ticks, seen against the first symbol as the market."""
    m = ohlcv(events(spark, sf), ["symbol"], F.floor(F.col("ts_ms") / 60_000), F.struct("ts_ms", "event_id"), "price", F.lit(1), "minute")
    n = blocks.numbered(m, ["symbol"], F.col("minute"), 65_536)
    n = blocks.windowed(n, ["symbol"], 61, lambda df, by: df.withColumn("ma", Frames(by).mean(F.col("c"), 60, 1)))
    first = n.agg(F.min("symbol").alias("symbol"))  # one row
    x = learn.micro_features(n, ["symbol"], n.join(F.broadcast(first), "symbol", "left_semi"))
    return x.select("symbol", "minute", *_rounded([k for k in learn.MINUTE if "whip" not in k]), "m_whip_60", "m_whip_240", *_rounded(learn.MARKET))


# ---- daily panel of intraday structure -----------------------------------------------------------------------------------

_INTRA = f"""{E}, q0 AS (SELECT symbol, ts_ms // 900000 AS slot, arg_min(price, (ts_ms, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts_ms, event_id)) AS c FROM e GROUP BY ALL), n AS (SELECT *, slot // 96 AS day, row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS rn FROM q0),
    a AS (SELECT *, CASE WHEN count(c) OVER w = 40 THEN avg(c) OVER w END AS ma, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY rn)) AS lr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, c / ma - 1 AS dev, coalesce(sign(c / ma - 1) <> lag(sign(c / ma - 1)) OVER p AND sign(c / ma - 1) <> 0, false) AS crossed, CASE WHEN h > l THEN 1 - abs(c - o) / (h - l) END AS wick FROM a WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    s AS (SELECT *, coalesce(rn - max(CASE WHEN crossed THEN rn END) OVER (PARTITION BY symbol ORDER BY rn), rn + 1) AS since, CASE WHEN count(lr) OVER z = 8 THEN sum(lr) OVER z END AS lr8 FROM b WINDOW z AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, CASE WHEN count(lr) OVER x = 480 AND count(lr8) OVER y = 473 THEN var_pop(lr8) OVER y / nullif(8 * var_pop(lr) OVER x, 0) END AS vr FROM s WINDOW x AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 479 PRECEDING AND CURRENT ROW), y AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 472 PRECEDING AND CURRENT ROW))"""


@CORE.query(
    "intraday_panel",
    f"""WITH {_INTRA} SELECT symbol, day, coalesce(count_if(crossed), 0)::BIGINT AS ncross, round(sqrt(sum(lr * lr)), 6) AS rv, round(max(abs(dev)), 6) AS max_absdev, round(avg(abs(dev)), 6) AS mean_absdev, round(arg_max(dev, CASE WHEN dev IS NOT NULL THEN rn END), 6) + 0.0 AS end_dev, max(since) AS max_since, arg_max(since, rn) AS end_since,
      round(max(abs(lr)), 6) AS max_jump, round(quantile_cont(abs(lr), 0.99), 6) AS p99_jump, round(avg(wick), 6) AS wick_mean, round(arg_max(c, rn) / arg_min(c, rn) - 1, 6) + 0.0 AS ret_d, sign(arg_max(dev, CASE WHEN dev IS NOT NULL THEN rn END))::DOUBLE AS sign_trend, round(arg_max(vr, rn), 5) AS vr8 FROM g GROUP BY ALL""",
)
def intraday_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Days by what their quarter-hours did: crossings, excursions from the average, jumps, candles, variance ratio."""
    q = ohlcv(events(spark, sf), ["symbol"], F.floor(F.col("ts_ms") / 900_000), F.struct("ts_ms", "event_id"), "price", F.lit(1), "slot")
    n = blocks.numbered(q, ["symbol"], F.col("slot"), 8192)
    p = panels.intraday(n, ["symbol"], F.floor(F.col("slot") / 96), 40)
    digits = {"vr8": 5}
    return p.select("symbol", "day", "ncross", "max_since", "end_since", *((r(x, digits.get(x, 6)) + 0.0).alias(x) for x in ("rv", "max_absdev", "mean_absdev", "end_dev", "max_jump", "p99_jump", "wick_mean", "ret_d", "sign_trend", "vr8")))


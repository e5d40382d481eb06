"""Resampling, fills, rolling and expanding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import blocks, smoothing, windows
from tidemill.operators.aggregates import correlation
from tidemill.operators.regular_grid import epoch_ms
from tidemill.operators.windows import Frames
from tidemill.plans.registry import CORE
from tidemill.plans.series import DAY_MS, HOUR_MS, D, E, bars, bars_cte, daily, events, numbered, r, rolled
from tidemill.session import table

H = f"{E}, hb AS (SELECT symbol, ts_ms // {HOUR_MS} AS hour, arg_min(price, (ts_ms, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts_ms, event_id)) AS c, count(*)::DOUBLE AS v, count(*) AS n FROM e GROUP BY ALL)"


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return windows.ohlcv(events(spark, sf), ["symbol"], F.floor(F.col("ts_ms") / HOUR_MS), F.struct("ts_ms", "event_id"), "price", F.lit(1), "hour")


@CORE.query("ohlcv_rollup", f"WITH {H} SELECT * FROM hb")
def ohlcv_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf)


@CORE.query(
    "bars_coarser",
    f"""WITH {bars_cte('m', '1m')} SELECT symbol, ts_ms // 1800000 AS half, arg_min(o, ts_ms) AS o, max(h) AS h, min(l) AS l, arg_max(c, ts_ms) AS c, round(sum(v), 4) AS v, count(*) AS n FROM m GROUP BY ALL""",
)
def bars_coarser(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.coarser(bars(spark, sf, "1m"), ["symbol"], F.floor(F.col("ts_ms") / 1_800_000), "ts_ms", "half")
    return out.withColumn("v", F.round("v", 4))


@CORE.query("dedupe_first", "SELECT symbol, tf, ts_ms, c, epoch_ms(recv_ts) AS recv_ms FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, tf, ts_ms ORDER BY recv_ts, c, v NULLS LAST) = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "bars")
    return windows.latest_version(b, ["symbol", "tf", "ts_ms"], F.col("recv_ts"), F.col("c").asc_nulls_last(), F.col("v").asc_nulls_last()).select("symbol", "tf", "ts_ms", "c", F.unix_millis("recv_ts").alias("recv_ms"))


@CORE.query(
    "thin_hourly",
    f"SELECT sim_id, v, timestamp // {HOUR_MS} AS hour, timestamp, market_price FROM (SELECT * REPLACE (CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 WHEN timestamp < 100000000000000 THEN timestamp ELSE timestamp // 1000 END AS timestamp) FROM ma_hourly) QUALIFY row_number() OVER (PARTITION BY sim_id, v, timestamp // {HOUR_MS} ORDER BY timestamp, market_price NULLS LAST) = 1",
)
def thin_hourly(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "ma_hourly").withColumn("timestamp", epoch_ms(F.col("timestamp"))).withColumn("hour", F.floor(F.col("timestamp") / HOUR_MS))
    return windows.latest_version(m, ["sim_id", "v", "hour"], F.col("timestamp"), F.col("market_price").asc_nulls_last()).select("sim_id", "v", "hour", "timestamp", "market_price")


FULL = f"""{H}, cal AS (SELECT symbol, unnest(generate_series(min(hour), max(hour))) AS hour FROM hb GROUP BY symbol),
    f AS (SELECT cal.symbol, cal.hour, last_value(hb.c IGNORE NULLS) OVER (PARTITION BY cal.symbol ORDER BY cal.hour) AS c, hb.c IS NULL AS filled FROM cal LEFT JOIN hb ON cal.symbol = hb.symbol AND cal.hour = hb.hour)"""


@CORE.query("calendar_ffill", f"WITH {FULL} SELECT * FROM f")
def calendar_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return windows.resample_last(hourly(spark, sf), ["symbol"], "hour", "c")


@CORE.query(
    "fill_both_ways",
    f"""WITH {H}, cal AS (SELECT symbol, unnest(generate_series(min(hour) - 3, max(hour))) AS hour FROM hb GROUP BY symbol), j AS (SELECT cal.symbol, cal.hour, hb.c FROM cal LEFT JOIN hb USING (symbol, hour))
    SELECT symbol, hour, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY hour), first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM j""",
)
def fill_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf)
    bounds = h.groupBy("symbol").agg((F.min("hour") - 3).alias("lo"), F.max("hour").alias("hi"))
    j = bounds.select("symbol", F.explode(F.sequence("lo", "hi")).alias("hour")).join(h.select("symbol", "hour", "c"), ["symbol", "hour"], "left")
    f = Frames(["symbol"], "hour")
    return j.select("symbol", "hour", F.coalesce(f.ffill("c"), f.bfill("c")).alias("c"))


@CORE.query(
    "sma_calendar",
    f"""WITH {FULL}, s AS (SELECT symbol, hour, CASE WHEN count(c) OVER w = 8 THEN avg(c) OVER w END AS sma FROM f WINDOW w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    s1 AS (SELECT symbol, hour, lag(sma) OVER (PARTITION BY symbol ORDER BY hour) AS ma FROM s)
    SELECT e.event_id, round(s1.ma, 6) AS ma FROM e JOIN s1 ON e.symbol = s1.symbol AND e.ts_ms // {HOUR_MS} = s1.hour""",
)
def sma_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the last eight calendar hours before the tick's hour, empty hours filled."""
    f = Frames(["symbol"], "hour")
    full = windows.resample_last(hourly(spark, sf), ["symbol"], "hour", "c")
    ma = full.withColumn("sma", f.mean(F.col("c"), 8)).withColumn("ma", f.lag("sma")).select("symbol", "hour", "ma")
    ticks = events(spark, sf).withColumn("hour", F.floor(F.col("ts_ms") / HOUR_MS))
    return ticks.join(ma, ["symbol", "hour"]).select("event_id", r("ma").alias("ma"))


@CORE.query(
    "sma_blocks",
    f"""WITH {H}, s AS (SELECT symbol, hour, CASE WHEN count(c) OVER w = 8 THEN avg(c) OVER w END AS sma FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
    s1 AS (SELECT symbol, hour, lag(sma) OVER (PARTITION BY symbol ORDER BY hour) AS ma FROM s)
    SELECT e.event_id, round(s1.ma, 6) AS ma FROM e JOIN s1 ON e.symbol = s1.symbol AND e.ts_ms // {HOUR_MS} = s1.hour""",
)
def sma_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the last eight existing hours strictly before the tick's hour."""
    f = Frames(["symbol"], "hour")
    ma = hourly(spark, sf).withColumn("sma", f.mean(F.col("c"), 8)).withColumn("ma", f.lag("sma")).select("symbol", "hour", "ma")
    ticks = events(spark, sf).withColumn("hour", F.floor(F.col("ts_ms") / HOUR_MS))
    return ticks.join(ma, ["symbol", "hour"]).select("event_id", r("ma").alias("ma"))


def w(n: int, shift: int = 0, name: str = "w") -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


@CORE.query(
    "sma_native",
    f"""WITH {D}, s AS (SELECT symbol, day, CASE WHEN count(c) OVER w = 10 THEN avg(c) OVER w END AS sma, CASE WHEN count(c) OVER x = 10 THEN avg(c) OVER x END AS sma_lagged FROM n WINDOW {w(10)}, {w(10, 1, 'x')})
    SELECT symbol, day, round(sma, 6) AS sma, round(sma_lagged, 6) AS sma_lagged FROM s""",
)
def sma_native(spark: SparkSession, sf: str) -> DataFrame:
    """Moving average of the series' own bars, with and without the current one."""

    def fn(df, keys):
        f = Frames(keys)
        return df.select("symbol", "day", "_rn", "_block", r(f.mean(F.col("c"), 10)).alias("sma"), r(f.mean(F.col("c"), 10, 1)).alias("sma_lagged"))

    return rolled(daily(spark, sf), fn, 10).drop("_rn")


@CORE.query(
    "realized_vol",
    f"""WITH {D}, q AS (SELECT symbol, day, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY day)) AS x FROM n), s AS (SELECT symbol, day, CASE WHEN count(x) OVER w = 20 THEN stddev_samp(x) OVER w END AS vol FROM q WINDOW {w(20, 1)})
    SELECT symbol, day, round(vol, 6) AS vol, round(vol * sqrt(365), 6) AS vol_year FROM s""",
)
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        vol = f.std(F.col("x"), 20, 1)
        return df.withColumn("x", f.log_return("c")).select("symbol", "day", "_rn", "_block", r(vol).alias("vol"), r(vol * 365**0.5).alias("vol_year"))

    return rolled(daily(spark, sf), fn, 22).drop("_rn")


@CORE.query(
    "rolling_stats",
    f"""WITH {D} SELECT symbol, day, round(CASE WHEN count(c) OVER w = 15 THEN avg(c) OVER w END, 6) AS mean, round(CASE WHEN count(c) OVER w = 15 THEN stddev_samp(c) OVER w END, 6) AS std, round(CASE WHEN count(c) OVER w = 15 THEN sum(c) OVER w END, 6) AS total,
      CASE WHEN count(c) OVER w = 15 THEN max(h) OVER w END AS highest, CASE WHEN count(c) OVER w = 15 THEN min(l) OVER w END AS lowest FROM n WINDOW {w(15)}""",
)
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f, c = Frames(keys), F.col("c")
        return df.select("symbol", "day", "_rn", "_block", r(f.mean(c, 15)).alias("mean"), r(f.std(c, 15)).alias("std"), r(f.total(c, 15)).alias("total"), f.highest(F.col("h"), 15).alias("highest"), f.lowest(F.col("l"), 15).alias("lowest"))

    return rolled(daily(spark, sf), fn, 15).drop("_rn")


@CORE.query(
    "roll_rank_pct",
    f"""WITH {D}, p AS (SELECT a.symbol, a.day, count(*) AS k, sum((b.c < a.c)::INT) AS lo, sum((b.c = a.c)::INT) AS eq FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL)
    SELECT symbol, day, round(CASE WHEN k = 20 THEN (lo + (eq + 1) / 2) / 20 END, 6) AS pct FROM p""",
)
def roll_rank_pct(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.rank_pct(numbered(daily(spark, sf)), ["symbol"], "c", 20, "pct").select("symbol", "day", r("pct").alias("pct"))


@CORE.query(
    "roll_slope",
    f"""WITH {D} SELECT symbol, day, round(CASE WHEN count(c) OVER w = 12 THEN regr_slope(c, rn) OVER w / first_value(c) OVER w END, 6) AS slope FROM n WINDOW {w(12)}""",
)
def roll_slope(spark: SparkSession, sf: str) -> DataFrame:
    return rolled(daily(spark, sf), lambda df, keys: df.select("symbol", "day", "_rn", "_block", r(Frames(keys).slope(F.col("c"), 12)).alias("slope")), 12).drop("_rn")


@CORE.query(
    "roll_corr_beta",
    f"""WITH {D}, q AS (SELECT symbol, day, c / lag(c) OVER p - 1 AS x, v / nullif(lag(v) OVER p, 0) - 1 AS y FROM n WINDOW p AS (PARTITION BY symbol ORDER BY day))
    SELECT symbol, day, round(CASE WHEN count(x + y) OVER w = 30 THEN corr(x, y) OVER w END, 5) + 0.0 AS corr, round(CASE WHEN count(x + y) OVER w = 30 THEN covar_samp(x, y) OVER w / var_samp(y) OVER w END, 5) + 0.0 AS beta FROM q WINDOW {w(30)}""",
)
def roll_corr_beta(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        df = df.withColumn("x", f.change("c")).withColumn("y", F.try_divide("v", F.nullif(f.lag("v"), F.lit(0.0))) - 1)
        return df.select("symbol", "day", "_rn", "_block", (r(f.corr(F.col("x"), F.col("y"), 30), 5) + 0.0).alias("corr"), (r(f.beta(F.col("x"), F.col("y"), 30), 5) + 0.0).alias("beta"))

    return rolled(daily(spark, sf), fn, 31).drop("_rn")


def ewm_sql(cte: str, x: str, alpha: float, start: str, src: str = "n") -> str:
    """Recursion e = (1 - alpha) e + x along rn; ``x`` may name the row as n."""
    return f"{cte} AS (SELECT symbol, rn, {start}::DOUBLE AS e FROM {src} WHERE rn = 0 UNION ALL SELECT n.symbol, n.rn, p.e * {1 - alpha} + {x} FROM {cte} p JOIN {src} n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"


@CORE.query(
    "ewm_macd",
    f"""WITH RECURSIVE {D}, {ewm_sql('fast', f'{2 / 13} * n.c', 2 / 13, 'c')}, {ewm_sql('slow', f'{2 / 27} * n.c', 2 / 27, 'c')}, {ewm_sql('num', 'n.c', 2 / 13, 'c')}, {ewm_sql('den', '1', 2 / 13, '1')}
    SELECT n.symbol, n.day, round(fast.e - slow.e, 8) AS macd, round(num.e / den.e, 8) AS ewm_adjusted FROM n JOIN fast USING (symbol, rn) JOIN slow USING (symbol, rn) JOIN num USING (symbol, rn) JOIN den USING (symbol, rn)""",
)
def ewm_macd(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential means of span 12 and 26 from the first value on, and the one of span 12 with adjusted weights."""
    df = numbered(daily(spark, sf))
    for fn, span, name in ((smoothing.ewm, 12, "fast"), (smoothing.ewm, 26, "slow"), (smoothing.ewm_adjusted, 12, "adjusted")):
        df = fn(df, ["symbol"], "c", span, name)
    return df.select("symbol", "day", r(F.col("fast") - F.col("slow"), 8).alias("macd"), r("adjusted", 8).alias("ewm_adjusted"))


def wilder_sql(name: str, x: str, src: str = "m", n: int = 14) -> str:
    """Seeded in row n with the mean of the differences of rows 1 to n."""
    return f"{name} AS (SELECT symbol, {n}::BIGINT AS rn, sum(coalesce({x}, 0)) / {n} AS e FROM {src} WHERE rn BETWEEN 1 AND {n} GROUP BY symbol HAVING count(*) = {n} UNION ALL SELECT s.symbol, s.rn, p.e * {1 - 1 / n} + coalesce(s.{x}, 0) / {n} FROM {name} p JOIN {src} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"


@CORE.query(
    "wilder_atr_rsi_adx",
    f"""WITH RECURSIVE {D}, m AS (SELECT symbol, day, rn, c, greatest(h, lag(c) OVER p) - least(l, lag(c) OVER p) AS tr, h - lag(h) OVER p AS up, lag(l) OVER p - l AS dn, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm, greatest(c - lag(c) OVER p, 0) AS gain, greatest(lag(c) OVER p - c, 0) AS loss FROM n WINDOW p AS (PARTITION BY symbol ORDER BY rn)),
    {wilder_sql('atr', 'tr')}, {wilder_sql('wp', 'pdm')}, {wilder_sql('wm', 'mdm')}, {wilder_sql('wg', 'gain')}, {wilder_sql('wl', 'loss')},
    dx AS (SELECT m.symbol, m.rn, CASE WHEN atr.e > 0 THEN 100 * abs(wp.e - wm.e) / nullif(wp.e + wm.e, 0) END AS dx FROM m LEFT JOIN atr USING (symbol, rn) LEFT JOIN wp USING (symbol, rn) LEFT JOIN wm USING (symbol, rn)), {wilder_sql('adx', 'dx', 'dx')}
    SELECT m.symbol, m.day, round(atr.e / m.c, 7) AS atrp, round(100 - 100 / (1 + wg.e / nullif(wl.e, 0)), 5) AS rsi, round(adx.e, 5) AS adx
    FROM m LEFT JOIN atr USING (symbol, rn) LEFT JOIN adx USING (symbol, rn) LEFT JOIN wg USING (symbol, rn) LEFT JOIN wl USING (symbol, rn)""",
)
def wilder_atr_rsi_adx(spark: SparkSession, sf: str) -> DataFrame:
    df = smoothing.rsi_wilder(smoothing.adx(numbered(daily(spark, sf)), ["symbol"]), ["symbol"])
    return df.select("symbol", "day", r(F.col("atr") / F.col("c"), 7).alias("atrp"), r("rsi", 5).alias("rsi"), r("adx", 5).alias("adx"))


@CORE.query(
    "rsi_simple",
    f"""WITH {D}, q AS (SELECT symbol, day, c - lag(c) OVER (PARTITION BY symbol ORDER BY day) AS x FROM n), a AS (SELECT symbol, day, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER w END AS up, CASE WHEN count(x) OVER w = 14 THEN avg(CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END) OVER w END AS dn FROM q WINDOW {w(14)})
    SELECT symbol, day, round(100 - 100 / (1 + up / nullif(dn, 0)), 5) AS rsi FROM a""",
)
def rsi_simple(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        return df.withColumn("x", F.col("c") - f.lag("c")).select("symbol", "day", "_rn", "_block", r(f.rsi_simple("x", 14), 5).alias("rsi"))

    return rolled(daily(spark, sf), fn, 15).drop("_rn")


@CORE.query(
    "efficiency_ratio",
    f"""WITH {D}, q AS (SELECT symbol, day, c, abs(c - lag(c) OVER p) AS s, abs(c - lag(c, 10) OVER p) AS m FROM n WINDOW p AS (PARTITION BY symbol ORDER BY day))
    SELECT symbol, day, round(m / nullif(CASE WHEN count(s) OVER w = 10 THEN sum(s) OVER w END, 0), 6) AS er FROM q WINDOW {w(10)}""",
)
def efficiency_ratio(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        return df.withColumn("s", F.col("c") - f.lag("c")).select("symbol", "day", "_rn", "_block", r(f.efficiency("c", "s", 10)).alias("er"))

    return rolled(daily(spark, sf), fn, 12).drop("_rn")


@CORE.query(
    "bollinger",
    f"""WITH {D}, q AS (SELECT symbol, day, c, CASE WHEN v > 0 THEN ln(v) END AS lv, CASE WHEN count(c) OVER w = 20 THEN avg(c) OVER w END AS m, CASE WHEN count(c) OVER w = 20 THEN stddev_samp(c) OVER w END AS s,
      CASE WHEN count(CASE WHEN v > 0 THEN 1 END) OVER x = 30 THEN avg(CASE WHEN v > 0 THEN ln(v) END) OVER x END AS vm, CASE WHEN count(CASE WHEN v > 0 THEN 1 END) OVER x = 30 THEN stddev_samp(CASE WHEN v > 0 THEN ln(v) END) OVER x END AS vs FROM n WINDOW {w(20)}, {w(30, 0, 'x')})
    SELECT symbol, day, round(4 * s / m, 5) AS bb_width, round((c - (m - 2 * s)) / nullif(4 * s, 0), 5) AS bb_pos, round((lv - vm) / nullif(vs, 0), 5) AS vol_z FROM q""",
)
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        width, pos = f.bollinger(F.col("c"), 20)
        return df.select("symbol", "day", "_rn", "_block", r(width, 5).alias("bb_width"), r(pos, 5).alias("bb_pos"), r(f.zscore(F.log(F.when(F.col("v") > 0, F.col("v"))), 30), 5).alias("vol_z"))

    return rolled(daily(spark, sf), fn, 30).drop("_rn")


@CORE.query(
    "variance_ratio",
    f"""WITH {D}, q AS (SELECT symbol, day, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY day)) AS x FROM n), z AS (SELECT symbol, day, x, CASE WHEN count(x) OVER w = 8 THEN sum(x) OVER w END AS x8 FROM q WINDOW {w(8)})
    SELECT symbol, day, round(CASE WHEN count(x) OVER a = 60 AND count(x8) OVER b = 53 THEN var_pop(x8) OVER b / nullif(8 * var_pop(x) OVER a, 0) END, 5) AS vr8 FROM z WINDOW {w(60, 0, 'a')}, {w(53, 0, 'b')}""",
)
def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of eight-step returns over eight times that of single steps, on the last 60 returns."""

    def fn(df, keys):
        f = Frames(keys)
        df = df.withColumn("x", f.log_return("c")).withColumn("x8", f.total(F.col("x"), 8))
        vr = F.try_divide(f.gated(F.var_pop, F.col("x8"), 53), F.nullif(8 * f.gated(F.var_pop, F.col("x"), 60), F.lit(0.0)))
        return df.select("symbol", "day", "_rn", "_block", r(vr, 5).alias("vr8"))

    return rolled(daily(spark, sf), fn, 61).drop("_rn")


CROSS = f"{D}, q AS (SELECT *, sign(c - CASE WHEN count(c) OVER w = 10 THEN avg(c) OVER w END) AS s FROM n WINDOW {w(10)}), k AS (SELECT *, (coalesce(s * lag(s) OVER (PARTITION BY symbol ORDER BY day), 0) < 0) AS x FROM q)"


def _crosses(spark: SparkSession, sf: str) -> DataFrame:
    def fn(df, keys):
        f = Frames(keys)
        return df.withColumn("s", F.signum(F.col("c") - f.mean(F.col("c"), 10))).withColumn("x", f.crossed("s") == 1)

    return rolled(daily(spark, sf), fn, 12)


@CORE.query("cross_count", f"WITH {CROSS} SELECT symbol, day // 30 AS month, count_if(x)::BIGINT AS crosses, round(sqrt(sum(power((h - l) / c, 2))), 6) AS rv FROM k GROUP BY ALL")
def cross_count(spark: SparkSession, sf: str) -> DataFrame:
    return _crosses(spark, sf).groupBy("symbol", F.floor(F.col("day") / 30).alias("month")).agg(F.count_if("x").alias("crosses"), r(F.sqrt(F.sum(F.pow((F.col("h") - F.col("l")) / F.col("c"), 2)))).alias("rv"))


@CORE.query(
    "bars_since_cross",
    f"WITH {CROSS} SELECT symbol, day, coalesce(rn - max(CASE WHEN x THEN rn END) OVER (PARTITION BY symbol ORDER BY rn), rn + 1) AS since FROM k",
)
def bars_since_cross(spark: SparkSession, sf: str) -> DataFrame:
    return _crosses(spark, sf).select("symbol", "day", Frames(["symbol"]).since(F.col("x")).alias("since"))


@CORE.query(
    "post_event_window",
    f"WITH {CROSS} SELECT a.symbol, a.day, EXISTS (SELECT 1 FROM k b WHERE b.symbol = a.symbol AND b.x AND b.day BETWEEN a.day - 5 AND a.day) AS w05, EXISTS (SELECT 1 FROM k b WHERE b.symbol = a.symbol AND b.x AND b.day BETWEEN a.day - 5 AND a.day - 1) AS w15 FROM k a",
)
def post_event_window(spark: SparkSession, sf: str) -> DataFrame:
    f = Frames(["symbol"], "day")
    return _crosses(spark, sf).select("symbol", "day", f.after_event(F.col("x"), 5).alias("w05"), f.after_event(F.col("x"), 5, False).alias("w15"))


@CORE.query(
    "expanding_tercile",
    f"""WITH {D}, x AS (SELECT symbol, day, c, count(c) OVER p AS k, quantile_cont(c, 1/3) OVER p AS lo, quantile_cont(c, 2/3) OVER p AS hi, quantile_cont(c, 0.5) OVER p AS med, quantile_cont(c, 0.8) OVER p AS q80 FROM n WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT symbol, day, CASE WHEN k < 30 THEN NULL WHEN c <= lo THEN 0 WHEN c <= hi THEN 1 ELSE 2 END AS tercile, round(CASE WHEN k >= 30 THEN med END, 6) AS median, coalesce(k >= 30 AND c > q80, false) AS above_q80 FROM x""",
)
def expanding_tercile(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c")
    q = blocks.expanding_quantiles(daily(spark, sf), ["symbol"], "day", "c", {"lo": 1 / 3, "hi": 2 / 3, "med": 0.5, "q80": 0.8}, 30)
    return q.select("symbol", "day", windows.tercile(c, F.col("lo"), F.col("hi")).alias("tercile"), r("med").alias("median"), F.coalesce(c > F.col("q80"), F.lit(False)).alias("above_q80"))


@CORE.query(
    "equity_curve",
    f"""WITH {D}, q AS (SELECT symbol, day, coalesce(c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1, 0) AS x FROM n), e AS (SELECT symbol, day, product(1 + x) OVER (PARTITION BY symbol ORDER BY day) AS eq FROM q)
    SELECT symbol, day, round(eq, 6) AS equity, round(max(eq) OVER (PARTITION BY symbol ORDER BY day), 6) AS peak FROM e""",
)
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    f = Frames(["symbol"], "day")
    eq = daily(spark, sf).withColumn("x", F.coalesce(f.change("c"), F.lit(0.0))).withColumn("eq", F.product(1 + F.col("x")).over(f.so_far))
    return eq.select("symbol", "day", r("eq").alias("equity"), r(F.max("eq").over(f.so_far)).alias("peak"))


@CORE.query(
    "range_totals",
    f"WITH {D} SELECT symbol, day, round(sum(v) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 4) AS v15 FROM n",
)
def range_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Volume of the fifteen bars before the current one, fewer at the start."""
    return rolled(daily(spark, sf), lambda df, keys: df.select("symbol", "day", "_rn", "_block", r(F.sum("v").over(Frames(keys).rows(-15, -1)), 4).alias("v15")), 15).drop("_rn")


@CORE.query(
    "streaks",
    f"""WITH {D}, q AS (SELECT symbol, day, coalesce(c > lag(c) OVER (PARTITION BY symbol ORDER BY day), false) AS up FROM n), g AS (SELECT *, sum((NOT up)::INT) OVER (PARTITION BY symbol ORDER BY day) AS run FROM q),
    s AS (SELECT symbol, day, up, sum(up::INT) OVER (PARTITION BY symbol, run ORDER BY day) AS streak, lag(up) OVER (PARTITION BY symbol ORDER BY day) AS before FROM g)
    SELECT symbol, day // 7 AS week, max(streak)::BIGINT AS longest, count_if(up AND NOT coalesce(before, false))::BIGINT AS starts FROM s GROUP BY ALL""",
)
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Longest run of rising days that is under way in each week, and the runs that begin in it."""
    f = Frames(["symbol"], "day")
    up = daily(spark, sf).withColumn("up", F.coalesce(F.col("c") > f.lag("c"), F.lit(False)))
    s = windows.streaks(up, ["symbol"], "day", "up").withColumn("begins", F.col("up") & ~F.coalesce(f.lag("up"), F.lit(False)))
    return s.groupBy("symbol", F.floor(F.col("day") / 7).alias("week")).agg(F.max("streak").alias("longest"), F.count_if("begins").alias("starts"))


@CORE.query(
    "yearly_features",
    f"""WITH {D}, q AS (SELECT symbol, year(make_timestamp(ts_ms * 1000)) AS year, day, ln(c / lag(c) OVER (PARTITION BY symbol, year(make_timestamp(ts_ms * 1000)) ORDER BY day)) AS x FROM n), l AS (SELECT *, lag(x) OVER (PARTITION BY symbol, year ORDER BY day) AS x1 FROM q)
    SELECT symbol, year, round(stddev_samp(x) * sqrt(365), 6) AS vol, round(sum(x), 6) AS drift, round(CASE WHEN count(x + x1) > 2 THEN corr(x, x1) END, 5) AS ac1 FROM l GROUP BY ALL""",
)
def yearly_features(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("year", F.year(F.timestamp_millis("ts_ms")).cast("bigint"))
    f = Frames(["symbol", "year"], "day")
    x = d.withColumn("x", f.log_return("c")).withColumn("x1", f.lag("x"))
    return x.groupBy("symbol", "year").agg(r(F.stddev_samp("x") * 365**0.5).alias("vol"), r(F.sum("x")).alias("drift"), r(F.when(F.count(F.col("x") + F.col("x1")) > 2, correlation(F.col("x"), F.col("x1"))), 5).alias("ac1"))


@CORE.query(
    "cross_signals",
    f"""WITH {H}, m AS (SELECT *, CASE WHEN count(c) OVER w = 24 THEN avg(c) OVER w END AS ma FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, CASE WHEN lag(l) OVER p <= lag(ma) OVER p AND lag(h) OVER p >= lag(ma) OVER p AND NOT (l <= ma AND h >= ma) THEN CASE WHEN c > ma THEN 1 ELSE -1 END ELSE 0 END AS signal, lead(c) OVER p / nullif(c, 0) - 1 AS nxt FROM m WINDOW p AS (PARTITION BY symbol ORDER BY hour))
    SELECT symbol, signal, count(*) AS n, round(avg(nxt * signal), 6) AS mean_next FROM s WHERE signal <> 0 GROUP BY ALL""",
)
def cross_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Crossings of the lagged 24-hour mean: the bar before holds it, the bar does not; and the return that follows."""
    f = Frames(["symbol"], "hour")
    m = hourly(spark, sf).withColumn("ma", f.mean(F.col("c"), 24, 1))
    held = (f.lag("l") <= f.lag("ma")) & (f.lag("h") >= f.lag("ma"))
    now = (F.col("l") <= F.col("ma")) & (F.col("h") >= F.col("ma"))
    s = m.withColumn("signal", F.when(held & ~now, F.when(F.col("c") > F.col("ma"), 1).otherwise(-1)).otherwise(0)).withColumn("nxt", F.try_divide(f.lead("c"), F.nullif("c", F.lit(0.0))) - 1)
    return s.where("signal <> 0").groupBy("symbol", "signal").agg(F.count("*").alias("n"), r(F.avg(F.col("nxt") * F.col("signal"))).alias("mean_next"))

"""Queries of the general training-data operators (problems 1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import regular_grid as rg
from tidemill.operators import spikes, trailing, windows
from tidemill.plans.registry import CORE
from tidemill.session import table

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def _bar_ms():
    return F.when(F.col("tf") == "1m", MINUTE).when(F.col("tf") == "60m", HOUR)


def _bad_bars(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible_bars(table(spark, sf, "bars").where("tf IN ('1m', '60m')"), _bar_ms())


@CORE.query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _bad_bars(spark, sf).select("symbol", "tf", "ts_ms")


@CORE.query("p1_reasons")
def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _bad_bars(spark, sf)


@CORE.query(
    "p1_rules",
    f"""
    WITH k AS (SELECT symbol, tf, ts_ms, h, l, c FROM bars WHERE tf IN ('1m', '60m') AND symbol IS NOT NULL AND ts_ms IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY symbol, tf, ts_ms ORDER BY recv_ts DESC, h DESC, l DESC, c DESC) = 1),
    s AS (SELECT *, c IS DISTINCT FROM lag(c) OVER (PARTITION BY symbol, tf ORDER BY ts_ms) AS fresh FROM k),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY symbol, tf ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS stretch FROM s),
    f AS (SELECT symbol, tf, ts_ms, NOT (l > 0 AND l <= c AND c <= h AND h < {spikes.FILLER}) AS impossible, count(*) OVER (PARTITION BY symbol, tf, stretch) >= 10 AS stuck FROM g)
    SELECT * FROM f WHERE impossible OR stuck
    """,
)
def p1_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The bad bars of the two rules that need no fit: impossible and stuck readings."""
    bars = table(spark, sf, "bars").where("tf IN ('1m', '60m')")
    return spikes.bar_residuals(bars, _bar_ms()).where("impossible OR stuck").select("symbol", "tf", "ts_ms", "impossible", "stuck")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    bars = table(spark, sf, "bars").where("tf IN ('1m', '60m')")
    hourly = table(spark, sf, "ma_hourly")
    a = rg.readings(bars, F.concat_ws("/", "symbol", "tf"), F.col("ts_ms"), F.col("c"), _bar_ms(), F.unix_micros("recv_ts"))
    b = rg.readings(hourly, F.concat("sim_id", F.lit("_v"), F.col("v").cast("string")), rg.epoch_ms(F.col("timestamp")), F.col("market_price"), F.lit(HOUR))
    return a.unionByName(b)


@CORE.query(
    "p3_found",
    f"""
    WITH r AS (
      SELECT symbol || '/' || tf AS source, CASE tf WHEN '1m' THEN {MINUTE} ELSE {HOUR} END AS w, ts_ms AS t, c AS x FROM bars WHERE tf IN ('1m', '60m')
      UNION ALL
      SELECT sim_id || '_v' || v, {HOUR}, CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 WHEN timestamp < 100000000000000 THEN timestamp ELSE timestamp // 1000 END, market_price FROM ma_hourly
    ), cells AS (SELECT source, w, t // w AS k, count(x) AS n FROM r GROUP BY ALL),
    every AS (SELECT source, w, unnest(generate_series(min(k), max(k))) AS k FROM cells GROUP BY source, w)
    SELECT e.source, e.k * e.w AS slot_ms FROM every e LEFT JOIN cells c ON e.source = c.source AND e.k = c.k WHERE coalesce(c.n, 0) = 0
    """,
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return rg.regular_grid(_series(spark, sf)).where("missing").select("source", "slot_ms")


#: Increments of pairs of neighbours, spread over the cells between them; ``one`` has the readings (source, w, t, x).
_SPREAD = """pr AS (SELECT source, w, t, x, lag(t) OVER o AS t0, lag(x) OVER o AS v0 FROM one WINDOW o AS (PARTITION BY source ORDER BY t)),
    sp AS (SELECT source, w, t, t0, {step} AS step, unnest(generate_series(t0 // w, t // w)) AS k FROM pr WHERE t0 IS NOT NULL),
    inc AS (SELECT source, k, sum(step * (least((k + 1) * w, t) - greatest(k * w, t0)) / (t - t0)) AS increment FROM sp WHERE least((k + 1) * w, t) > greatest(k * w, t0) GROUP BY ALL)"""


@CORE.query(
    "p3_grid",
    f"""
    WITH r AS (
      SELECT symbol || '/' || tf AS source, CASE tf WHEN '1m' THEN {MINUTE} ELSE {HOUR} END AS w, ts_ms AS t, c AS x, epoch_us(recv_ts) AS ver FROM bars WHERE tf IN ('1m', '60m')
      UNION ALL
      SELECT sim_id || '_v' || v, {HOUR}, CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 WHEN timestamp < 100000000000000 THEN timestamp ELSE timestamp // 1000 END, market_price, 0 FROM ma_hourly
    ), one AS (SELECT source, w, t, x FROM r WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, t ORDER BY ver DESC, x DESC) = 1),
    cells AS (SELECT source, w, t // w AS k, count(DISTINCT CASE WHEN x IS NOT NULL THEN t END) AS n FROM r GROUP BY ALL),
    every AS (SELECT source, w, unnest(generate_series(min(k), max(k))) AS k FROM cells GROUP BY source, w),
    {_SPREAD.format(step="x - v0")}
    SELECT e.source, e.k * e.w AS slot_ms, coalesce(c.n, 0) AS n_readings, coalesce(c.n, 0) = 0 AS missing, round(i.increment, 5) + 0.0 AS increment,
           round(CASE WHEN b.t IS NULL THEN NULL WHEN d.t IS NULL THEN CASE WHEN b.t >= e.k * e.w THEN b.x END ELSE b.x + (d.x - b.x) * ((e.k + 1) * e.w - b.t)::DOUBLE / (d.t - b.t) END, 6) AS level
    FROM every e LEFT JOIN cells c ON e.source = c.source AND e.k = c.k LEFT JOIN inc i ON e.source = i.source AND e.k = i.k
    ASOF LEFT JOIN one b ON e.source = b.source AND b.t < (e.k + 1) * e.w
    ASOF LEFT JOIN one d ON e.source = d.source AND d.t >= (e.k + 1) * e.w
    """,
)
def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The readings are gauges: ``increment`` is their change within the cell, ``level`` the value at its end."""
    return rg.regular_grid(_series(spark, sf)).select("source", "slot_ms", "n_readings", "missing", (F.round("increment", 5) + 0.0).alias("increment"), F.round("level", 6).alias("level"))


@CORE.query(
    "p3_counter",
    f"""
    WITH r AS (SELECT symbol || '/' || tf AS source, CASE tf WHEN '1m' THEN {MINUTE} ELSE {HOUR} END AS w, ts_ms AS t, v FROM bars WHERE tf IN ('1m', '60m') AND symbol IS NOT NULL AND ts_ms IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY symbol, tf, ts_ms ORDER BY recv_ts DESC, v DESC NULLS LAST) = 1),
    m AS (SELECT source, w, t, CASE WHEN v IS NOT NULL THEN (sum(round(v * 1000)::BIGINT) OVER (PARTITION BY source, t // {DAY} ORDER BY t))::DOUBLE END AS x FROM r),
    one AS (SELECT * FROM m WHERE x IS NOT NULL),
    cells AS (SELECT source, w, t // w AS k, count(x) AS n FROM m GROUP BY ALL),
    every AS (SELECT source, w, unnest(generate_series(min(k), max(k))) AS k FROM cells GROUP BY source, w),
    {_SPREAD.format(step="CASE WHEN x < v0 THEN x ELSE x - v0 END")}
    SELECT e.source, e.k * e.w AS slot_ms, coalesce(c.n, 0) AS n_readings, coalesce(c.n, 0) = 0 AS missing, round(i.increment, 3) + 0.0 AS increment
    FROM every e LEFT JOIN cells c ON e.source = c.source AND e.k = c.k LEFT JOIN inc i ON e.source = i.source AND e.k = i.k
    """,
)
def p3_counter(spark: SparkSession, sf: str) -> DataFrame:
    """The day's traded volume in thousandths as a cumulative counter, which starts anew every day: increments per period, resets told by the fall."""
    bars = table(spark, sf, "bars").where("tf IN ('1m', '60m') AND symbol IS NOT NULL AND ts_ms IS NOT NULL")
    one = windows.latest_version(bars, ["symbol", "tf", "ts_ms"], F.col("recv_ts").desc(), F.col("v").desc_nulls_last())
    day = Window.partitionBy("symbol", "tf", F.floor(F.col("ts_ms") / DAY)).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    meter = one.withColumn("meter", F.when(F.col("v").isNotNull(), F.sum(F.round(F.col("v") * 1000).cast("bigint")).over(day)))
    rows = rg.readings(meter, F.concat_ws("/", "symbol", "tf"), F.col("ts_ms"), F.col("meter"), _bar_ms())
    return rg.regular_grid(rows, "counter").select("source", "slot_ms", "n_readings", "missing", (F.round("increment", 3) + 0.0).alias("increment"))


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    bars = table(spark, sf, "bars").where("tf = '1d'")
    return trailing.trailing_windows(trailing.daily_values(bars, "symbol", F.floor(F.col("ts_ms") / DAY), "c", "recv_ts"), (7, 30))


_TRAILING = f"""
    WITH d AS (SELECT symbol, ts_ms // {DAY} AS day, max_by(c, (recv_ts, c)) AS c FROM (SELECT symbol, ts_ms, recv_ts, struct_pack(x := c) AS c FROM bars WHERE tf = '1d') GROUP BY ALL),
    cal AS (SELECT symbol, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY symbol),
    v AS (SELECT cal.symbol, cal.day, d.c.x AS c FROM cal LEFT JOIN d ON cal.symbol = d.symbol AND cal.day = d.day),
    w AS (SELECT symbol, day, count(c) OVER s AS n7, sum(c) OVER s AS total7, avg(c) OVER s AS avg7, count(c) OVER m AS n30, sum(c) OVER m AS total30, avg(c) OVER m AS avg30 FROM v
          WINDOW s AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), m AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


@CORE.query("p5_found", _TRAILING + "SELECT symbol, day, CASE WHEN n7 = 0 THEN 'silent' ELSE 'shift' END AS kind FROM w WHERE (n7 = 0 AND n30 > 0) OR (n7 > 0 AND abs(avg7 / avg30 - 1) > 0.15)")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when((F.col("n7") == 0) & (F.col("n30") > 0), "silent").when(F.abs(F.try_divide("avg7", "avg30") - 1) > 0.15, "shift")
    return _closes(spark, sf).select(F.col("entity").alias("symbol"), "day", kind.alias("kind")).where("kind IS NOT NULL")


@CORE.query("p5_rolling", _TRAILING + "SELECT symbol, day, n7, n30, round(total7, 9) AS total7, round(avg7, 9) AS avg7, round(total30, 9) AS total30, round(avg30, 9) AS avg30 FROM w")
def p5_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _closes(spark, sf).select(F.col("entity").alias("symbol"), "day", "n7", "n30", *(F.round(x, 9).alias(x) for x in ("total7", "avg7", "total30", "avg30")))

"""The test series that the queries read, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import blocks, windows
from tidemill.session import table

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def bars(spark: SparkSession, sf: str, tf: str) -> DataFrame:
    """(symbol, ts_ms, o, h, l, c, v): the latest version of each bar that has h, l and c; o falls back to c, v to 0."""
    raw = table(spark, sf, "bars").where((F.col("tf") == tf) & F.col("h").isNotNull() & F.col("l").isNotNull() & F.col("c").isNotNull())
    best = windows.latest_version(raw, ["symbol", "ts_ms"], F.col("recv_ts").desc(), F.col("c").desc(), F.col("v").desc_nulls_last())
    return best.select("symbol", "ts_ms", F.coalesce("o", "c").alias("o"), "h", "l", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def bars_cte(name: str, tf: str) -> str:
    return f"""{name} AS (SELECT symbol, ts_ms, coalesce(o, c) AS o, h, l, c, coalesce(v, 0) AS v FROM bars WHERE tf = '{tf}' AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY recv_ts DESC, c DESC, v DESC NULLS LAST) = 1)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with their day number; one per symbol and day, the later stamp where a day has two."""
    d = bars(spark, sf, "1d").withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    return windows.latest_version(d, ["symbol", "day"], F.col("ts_ms").desc())


D = bars_cte("d0", "1d") + f""",
    d AS (SELECT *, ts_ms // {DAY_MS} AS day FROM d0 QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms // {DAY_MS} ORDER BY ts_ms DESC) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS rn FROM d)"""


def rolled(df: DataFrame, fn, behind: int, ahead: int = 0) -> DataFrame:
    """Windows over the daily series, in blocks."""
    return blocks.rolling(df, ["symbol"], F.col("day"), 4096, behind, fn, ahead)


def numbered(df: DataFrame) -> DataFrame:
    return blocks.numbered(df, ["symbol"], F.col("day"), 4096)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts_ms, event_id, price)."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", F.col("value").alias("price"))


E = "e AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id, value AS price FROM events)"


def r(x, n: int = 6):
    return F.round(x, n)

"""Feature panels, models on expanding windows, and what the models rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import blocks, joins, windows
from tidemill.operators.smoothing import ewm
from tidemill.operators.windows import Frames

#: The hourly features, in the order in which models take them.
HOURLY = [
    "ret_1h", "vol_24h", "vol_rank", "dist_ma", "ma_slope_24", "price_slope_24", "mom_5", "mom_10", "mom_20", "roc_5", "roc_10", "roc_20", "dist_sma_20", "dist_sma_50", "dist_sma_200",
    "rsi_14", "macd_hist", "bb_width", "bb_pos", "adxproxy", "chop", "x_volrank_distma", "x_bbw_adx", "hour", "dow",
]
#: The minute features of a series itself, and those of the market it is seen against.
MINUTE = [*(f"m_ret_{n}" for n in (1, 3, 5, 15, 30, 60)), "m_slope_15", "m_slope_60", "m_accel", *(f"m_rvol_{n}" for n in (15, 30, 60)), "m_vspike_15", "m_vspike_60", "m_entrybar_range", "m_whip_60", "m_whip_240", "m_dist_ma"]
MARKET = ["btc_ret_60", "btc_ret_240", "btc_ret_1440", "btc_vs_sma1d", "btc_slope_240"]
#: Bars that a series must have before a row for its minute features to count.
HISTORY = 1500


def hourly_grid(readings: DataFrame, keys: Sequence[str], ms: str, price: str, ma: str) -> DataFrame:
    """(keys, hour, _rn, c, ma): the last price and average of each hour, carried over hours without one.

    The grid of a series begins with its first hour that has a price. Of readings at one instant the larger counts.
    """
    keys = list(keys)
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(ms, x)))
    by = readings.withColumn("hour", F.floor(F.col(ms) / 3_600_000)).groupBy(*keys, "hour").agg(last(price).alias("c"), last(ma).alias("ma"))
    first = by.groupBy(*keys).agg(F.min(F.when(F.col("c").isNotNull(), F.col("hour"))).alias("_first"))
    full = windows.calendar(by, keys, "hour").join(by, [*keys, "hour"], "left").join(first, keys)
    return blocks.filled(full.where("hour >= _first"), keys, "hour", ["c", "ma"]).withColumn("_rn", F.col("hour") - F.col("_first")).drop("_first")


def hourly_features(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hour, c, HOURLY) of ``hourly_grid``, from the row and earlier ones; null while a window fills.

    An hour is choppy if its volatility is low and its trend weaker than the median of the hours before it, so that no
    row rests on later ones.
    """
    keys = list(keys)
    rows = ewm(ewm(grid, keys, "c", 12, "_e12"), keys, "c", 26, "_e26").withColumn("_macd", F.col("_e12") - F.col("_e26"))
    rows = ewm(rows, keys, "_macd", 9, "_sig")

    def fn(df: DataFrame, by: list[str]) -> DataFrame:
        f, c = Frames(by), F.col("c")
        df = df.withColumns({"ret_1h": f.change("c"), "_lr": f.log_return("c"), "_d": c - f.lag("c")})
        width, pos = f.bollinger(c, 20)
        out = {"vol_24h": f.std(F.col("_lr"), 24), "dist_ma": F.try_divide(c - F.col("ma"), F.col("ma")), "ma_slope_24": f.change("ma", 24), "price_slope_24": f.slope(c, 24), "rsi_14": f.rsi_simple("_d", 14), "bb_width": width, "bb_pos": pos, "macd_hist": F.try_divide(F.col("_macd") - F.col("_sig"), c)}
        out |= {f"mom_{n}": f.change("c", n) for n in (5, 10, 20)} | {f"roc_{n}": f.change("c", n) for n in (5, 10, 20)}
        out |= {f"dist_sma_{n}": F.try_divide(c - f.mean(c, n), f.mean(c, n)) for n in (20, 50, 200)}
        return df.withColumns(out)

    x = blocks.windowed(rows, keys, 200, fn)
    x = blocks.rank_pct(x, keys, "vol_24h", 720, "vol_rank").withColumn("adxproxy", F.abs("price_slope_24") / (F.col("vol_24h") + 1e-9))
    x = blocks.expanding_quantiles(x, keys, "_rn", "adxproxy", {"_typical": 0.5}, 1)
    t = F.timestamp_seconds(F.col("hour") * 3600)
    chop = F.coalesce((F.col("vol_rank") < 0.4) & (F.col("adxproxy") < F.col("_typical")), F.lit(False)).cast("double")
    x = x.withColumns({"chop": chop, "x_volrank_distma": F.col("vol_rank") * F.abs("dist_ma"), "x_bbw_adx": F.col("bb_width") * F.col("adxproxy"), "dow": F.weekday(t.cast("date"))})
    return x.select(*keys, F.col("hour").alias("slot"), "c", *(F.hour(t).alias("hour") if n == "hour" else F.col(n) for n in HOURLY))


def _back(by: list[str], minutes: int) -> Column:
    """The close of the last bar that is at least so many minutes old."""
    return F.last("c", ignorenulls=True).over(Window.partitionBy(*by).orderBy("minute").rangeBetween(Window.unboundedPreceding, -minutes))


def minute_features(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, minute, _next, _rn, MINUTE) of bars (keys, _rn, minute, h, l, c, v, ma) as of each bar's close.

    Look-backs go by the clock, all other windows by bars. The volume of the last 15 or 60 bars, this one left out, is
    set against that of the 1,440 before this one. Rows with fewer than HISTORY earlier bars are left out.
    """

    def fn(df: DataFrame, by: list[str]) -> DataFrame:
        f, c = Frames(by), F.col("c")
        df = df.withColumns({"_lr": f.log_return("c"), "_above": F.coalesce(c > F.col("ma"), F.lit(False))})
        df = df.withColumn("_flip", F.coalesce(F.col("_above") != f.lag("_above"), F.lit(False)).cast("int"))
        day = F.sum("v").over(f.rows(-1440, -1)) / 1440.0 + 1e-9
        out = {f"m_ret_{n}": F.try_divide(c, _back(by, n)) - 1 for n in (1, 3, 5, 15, 30, 60)}
        out |= {"m_slope_15": f.slope(c, 16), "m_slope_60": f.slope(c, 61)} | {f"m_rvol_{n}": f.gated(F.stddev_pop, F.col("_lr"), n) for n in (15, 30, 60)}
        out |= {f"m_vspike_{n}": F.sum("v").over(f.rows(-n, -1)) / float(n) / day for n in (15, 60)}
        out |= {"m_entrybar_range": F.try_divide(F.col("h") - F.col("l"), c), "m_dist_ma": F.try_divide(c, F.col("ma")) - 1} | {f"m_whip_{n}": F.sum("_flip").over(f.rows(-(n - 1))).cast("bigint") for n in (60, 240)}
        return df.withColumns(out).withColumn("m_accel", F.col("m_slope_15") - F.col("m_slope_60")).select(*by, "minute", f.lead("minute").alias("_next"), "_rn", *MINUTE)

    return blocks.windowed(bars, list(keys), 1441, fn, 1).where(F.col("_rn") >= HISTORY)


def market_features(market: DataFrame) -> DataFrame:
    """(minute, MARKET) of the bars (_rn, minute, c) of the series that stands for the market."""

    def fn(df: DataFrame, by: list[str]) -> DataFrame:
        f, c = Frames(by), F.col("c")
        mean = f.mean(c, 1441)
        out = {f"btc_ret_{n}": F.try_divide(c, _back(by, n)) - 1 for n in (60, 240, 1440)} | {"btc_vs_sma1d": F.try_divide(c, mean) - 1, "btc_slope_240": f.slope(c, 241)}
        return df.withColumns(out).select(*by, "minute", "_rn", *MARKET)

    return blocks.windowed(market.withColumn("_m", F.lit(0)), ["_m"], 1441, fn).where(F.col("_rn") >= HISTORY).select("minute", *MARKET)


def micro_features(bars: DataFrame, keys: Sequence[str], market: DataFrame) -> DataFrame:
    """(keys, minute, MINUTE, MARKET): what is known before each bar: the features as of the bar before it, and those of
    the market as of then, at most a day old."""
    own = minute_features(bars, keys)
    seen = joins.asof_backward(own, market_features(market), [], "minute", MARKET, lookback=1440).drop("asof_minute")
    return seen.where("_next IS NOT NULL").select(*keys, F.col("_next").alias("minute"), *MINUTE, *MARKET)


def next_period_target(df: DataFrame, keys: Sequence[str], order: str, x: str, name: str = "target") -> DataFrame:
    """Whether x of the next row is positive; null in the last row of a series."""
    return df.withColumn(name, (F.lead(x).over(Window.partitionBy(*keys).orderBy(order)) > 0).cast("double"))


def _fit(kind: str, train: DataFrame, features: Sequence[str], label: str, seed: int):
    share = train.agg(F.avg(label)).first()[0]
    if share is None or share in (0.0, 1.0):
        return None
    weighted = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train.withColumn("_w", F.when(F.col(label) > 0, 0.5 / share).otherwise(0.5 / (1 - share))))
    common = {"featuresCol": "_x", "labelCol": label, "weightCol": "_w"}
    est = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common) if kind == "gbt" else LogisticRegression(regParam=0.01, **common)
    return est.fit(weighted)


def predict(model, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="_x").transform(df))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def walk_forward(df: DataFrame, features: Sequence[str], label: str, fold: str, k: int, kind: str = "gbt", seed: int = 0) -> DataFrame:
    """Rows of folds 1..k with ``p`` from a model that was fitted on the folds before theirs; rows with nulls are left out.

    Classes are weighted alike. A fold whose training rows are of one class gets no prediction.
    """
    rows = df.na.drop(subset=[*features, label])
    rows = rows.withColumns({f: F.col(f).cast("double") for f in features})
    out = None
    for f in range(1, k + 1):
        model = _fit(kind, rows.where(F.col(fold) < f), features, label, seed)
        if model is not None:
            scored = predict(model, rows.where(F.col(fold) == f), features)
            out = scored if out is None else out.unionByName(scored)
    return rows.where(F.lit(False)).withColumn("p", F.lit(None).cast("double")) if out is None else out


def permuted(df: DataFrame, column: str, by: Sequence[str], seed: int = 0) -> DataFrame:
    """``df`` with the values of one column dealt anew among its rows, in an order that a hash of (by, seed) gives.

    Rows are numbered per hash bucket, so no task sorts them all.
    """
    key = F.xxhash64(*by, F.lit(seed))
    w = Window.partitionBy("_b").orderBy("_k", *by)
    rows = df.withColumns({"_b": F.pmod(F.xxhash64(*by), F.lit(64)), "_k": key}).withColumn("_i", F.row_number().over(w))
    n = rows.groupBy("_b").agg(F.max("_i").alias("_n"))
    rows = rows.join(n, "_b")
    values = rows.select("_b", F.pmod(F.col("_i") + F.greatest(F.lit(1), F.floor(F.col("_n") / 3)), F.col("_n")).alias("_at"), F.col(column).alias("_new"))
    return rows.withColumn("_at", F.pmod("_i", "_n")).join(values, ["_b", "_at"]).withColumn(column, F.col("_new")).drop("_b", "_k", "_i", "_n", "_at", "_new")

"""Daily panels of what happened within the day, and of one series against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import blocks
from tidemill.operators.windows import Frames


def intraday(bars: DataFrame, keys: Sequence[str], day: Column, w: int) -> DataFrame:
    """(keys, day, ...) of bars (keys, _rn, o, h, l, c) against the mean of the w closes before each bar.

    ncross: crossings of the mean; rv: root of the summed squared log returns; max_absdev, mean_absdev, end_dev: distance
    from the mean; max_since, end_since: bars since the last crossing; max_jump, p99_jump: absolute log returns;
    wick_mean: share of a bar's range outside its body; ret_d: last close over the first; sign_trend: side at the end;
    vr8: variance of 8-bar returns over eight times that of single ones, over the last 480 bars at the day's end.
    """
    keys = list(keys)

    def fn(df: DataFrame, by: list[str]) -> DataFrame:
        f, c = Frames(by), F.col("c")
        df = df.withColumns({"ma": f.mean(c, w, 1), "lr": f.log_return("c")})
        df = df.withColumns({"dev": F.try_divide(c, F.col("ma")) - 1, "lr8": f.total(F.col("lr"), 8)})
        side = F.signum("dev")
        vr = F.try_divide(f.gated(F.var_pop, F.col("lr8"), 473), F.nullif(8 * f.gated(F.var_pop, F.col("lr"), 480), F.lit(0.0)))
        spread = F.col("h") - F.col("l")
        wick = F.when(spread > 0, 1 - F.abs(c - F.col("o")) / spread)
        return df.withColumn("side", side).withColumns({"crossed": F.coalesce((side != f.lag("side")) & (side != 0), F.lit(False)), "wick": wick, "vr": vr})

    rows = blocks.windowed(bars, keys, 489, fn).withColumns({"day": day, "_at": F.col("_rn").cast("double")})
    last = blocks.filled(rows.withColumn("_cross", F.when(F.col("crossed"), F.col("_rn"))), keys, "_rn", ["_cross"])
    rows = last.withColumn("since", F.coalesce(F.col("_rn") - F.col("_cross"), F.col("_rn") + 1))
    end_dev = F.max_by("dev", F.when(F.col("dev").isNotNull(), F.col("_rn")))
    return rows.groupBy(*keys, "day").agg(
        F.count_if("crossed").alias("ncross"), F.sqrt(F.sum(F.col("lr") * F.col("lr"))).alias("rv"), F.max(F.abs("dev")).alias("max_absdev"), F.avg(F.abs("dev")).alias("mean_absdev"), end_dev.alias("end_dev"),
        F.max("since").alias("max_since"), F.max_by("since", "_rn").alias("end_since"), F.max(F.abs("lr")).alias("max_jump"), F.percentile(F.abs("lr"), F.lit(0.99)).alias("p99_jump"), F.avg("wick").alias("wick_mean"),
        (F.max_by("c", "_rn") / F.min_by("c", "_rn") - 1).alias("ret_d"), F.signum(end_dev).alias("sign_trend"), F.max_by("vr", "_rn").alias("vr8"),
    )

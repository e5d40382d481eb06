"""Window expressions over series of bars.

Each takes the window keys and the ordering column and gives a Column. A rolling value is null until its frame holds n
non-null values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators import blocks
from tidemill.operators.aggregates import correlation


class Frames:
    """Windows over one series: ``keys`` partition it, ``order`` sorts it."""

    def __init__(self, keys: Sequence[str], order: str = "_rn") -> None:
        self.by = Window.partitionBy(*keys).orderBy(order)

    def rows(self, lo: int, hi: int = 0) -> WindowSpec:
        return self.by.rowsBetween(lo, hi)

    @property
    def past(self) -> WindowSpec:
        """All rows before the current one."""
        return self.by.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def so_far(self) -> WindowSpec:
        return self.by.rowsBetween(Window.unboundedPreceding, 0)

    def gated(self, agg: Callable[[Column], Column], x: Column, n: int, shift: int = 0) -> Column:
        """``agg(x)`` over the n rows that end ``shift`` rows back, null unless all n have a value."""
        f = self.rows(-(n - 1) - shift, -shift)
        return F.when(F.count(x).over(f) == n, agg(x).over(f))

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(x, n).over(self.by)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(x, n).over(self.by)

    # ---- rolling ------------------------------------------------------------------------------------------------

    def mean(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.gated(F.avg, x, n, shift)

    def std(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.gated(F.stddev_samp, x, n, shift)

    def total(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.gated(F.sum, x, n, shift)

    def highest(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.gated(F.max, x, n, shift)

    def lowest(self, x: Column, n: int, shift: int = 0) -> Column:
        return self.gated(F.min, x, n, shift)

    def slope(self, x: Column, n: int, at: str = "_rn") -> Column:
        """Least-squares slope of (x - x0) / x0 on 0..n-1, x0 the first value of the frame."""
        f = self.rows(-(n - 1))
        return F.when(F.count(x).over(f) == n, F.try_divide(F.regr_slope(x, F.col(at).cast("double")).over(f), F.first(x).over(f)))

    def corr(self, x: Column, y: Column, n: int) -> Column:
        f = self.rows(-(n - 1))
        return F.when(F.count(x + y).over(f) == n, correlation(x, y, f))

    def beta(self, x: Column, y: Column, n: int) -> Column:
        """Covariance of x and y over the variance of y; NaN, as in the SQL, where y does not vary."""
        f = self.rows(-(n - 1))
        of_y = F.var_samp(y).over(f)
        return F.when(F.count(x + y).over(f) == n, F.when(of_y == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_samp(x, y).over(f), of_y)))

    # ---- indicators ---------------------------------------------------------------------------------------------

    def log_return(self, c: str, n: int = 1) -> Column:
        return F.log(F.try_divide(F.col(c), self.lag(c, n)))

    def change(self, c: str, n: int = 1) -> Column:
        return F.try_divide(F.col(c), self.lag(c, n)) - 1

    def rsi_simple(self, diff: str, n: int = 14) -> Column:
        d = F.col(diff)
        up, down = (self.mean(F.when(d.isNotNull(), F.greatest(x, F.lit(0.0))), n) for x in (d, -d))
        return 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(up, F.nullif(down, F.lit(0.0))))

    def efficiency(self, c: str, step: str, n: int) -> Column:
        """|c - c[n back]| over the sum of the absolute steps between."""
        return F.try_divide(F.abs(F.col(c) - self.lag(c, n)), self.total(F.abs(step), n))

    def bollinger(self, c: Column, n: int = 20) -> tuple[Column, Column]:
        """(width, position): 4 std / mean, and where c lies between mean - 2 std (0) and mean + 2 std (1)."""
        m, s = self.mean(c, n), self.std(c, n)
        return F.try_divide(4 * s, m), F.try_divide(c - (m - 2 * s), 4 * s)

    def zscore(self, x: Column, n: int) -> Column:
        return F.try_divide(x - self.mean(x, n), self.std(x, n))

    def crossed(self, sign: str) -> Column:
        """1 where the sign differs from that of the row before, both being non-zero."""
        before = self.lag(sign)
        return F.coalesce((F.col(sign) * before < 0).cast("int"), F.lit(0))

    def since(self, event: Column, at: str = "_rn") -> Column:
        """Rows since the last event, 0 on it; before the first event, the row's number from 1."""
        last = F.last(F.when(event, F.col(at)), ignorenulls=True).over(self.so_far)
        return F.coalesce(F.col(at) - last, F.col(at) + 1)

    def after_event(self, event: Column, days: int, inclusive: bool = True) -> Column:
        """Whether an event lies within the last ``days`` of the numeric ordering column; 0 days back only if inclusive."""
        frame = self.by.rangeBetween(-days, 0 if inclusive else -1)
        return F.coalesce(F.max(event.cast("int")).over(frame) == 1, F.lit(False))

    # ---- fills --------------------------------------------------------------------------------------------------

    def ffill(self, x: Column | str) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far)

    def bfill(self, x: Column | str) -> Column:
        return F.first(x, ignorenulls=True).over(self.by.rowsBetween(0, Window.unboundedFollowing))


def tercile(x: Column, lo: Column, hi: Column) -> Column:
    """0, 1, 2 by two bounds; null without a value or a bound."""
    return F.when(lo.isNull() | x.isNull(), None).when(x <= lo, 0).when(x <= hi, 1).otherwise(2)


def ohlcv(df: DataFrame, keys: Sequence[str], bucket: Column, order: Column, price: str, volume: Column, name: str = "bucket") -> DataFrame:
    """Ticks to bars: open and close by ``order``, which must break all ties."""
    rows = df.withColumn(name, bucket).withColumn("_ord", order)
    return rows.groupBy(*keys, name).agg(
        F.min_by(price, "_ord").alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, "_ord").alias("c"), F.sum(volume).cast("double").alias("v"), F.count("*").alias("n")
    )


def coarser(bars: DataFrame, keys: Sequence[str], bucket: Column, order: str, name: str = "bucket") -> DataFrame:
    """Bars to longer bars; empty buckets give none."""
    return bars.withColumn(name, bucket).groupBy(*keys, name).agg(
        F.min_by("o", order).alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", order).alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )


def calendar(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Every bucket number between the first and the last of each series."""
    bounds = df.groupBy(*keys).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(bucket))


def resample_last(df: DataFrame, keys: Sequence[str], bucket: str, value: str) -> DataFrame:
    """``df`` has one row per bucket; adds the empty buckets, with the last value before them and ``filled`` true."""
    full = calendar(df, keys, bucket).join(df.select(*keys, bucket, value), [*keys, bucket], "left").withColumn("filled", F.col(value).isNull())
    return blocks.filled(full, keys, bucket, [value])


def latest_version(df: DataFrame, keys: Sequence[str], *best: Column) -> DataFrame:
    """The best row of each key: ``best`` orders the versions and must break ties that matter."""
    return df.withColumn("_v", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("_v = 1").drop("_v")


def true_range(f: Frames) -> Column:
    """max(h, previous close) - min(l, previous close)."""
    before = f.lag("c")
    return F.greatest("h", before) - F.least("l", before)


def directional_moves(f: Frames) -> tuple[Column, Column]:
    up, down = F.col("h") - f.lag("h"), f.lag("l") - F.col("l")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


def streaks(df: DataFrame, keys: Sequence[str], order: str, flag: str, name: str = "streak") -> DataFrame:
    """Length so far of the run of true flags that the row is in, 0 where the flag is false (or null)."""
    w = Window.partitionBy(*keys).orderBy(order)
    breaks = F.sum(F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1)).over(w)
    run = Window.partitionBy(*keys, "_run").orderBy(order)
    out = df.withColumn("_run", breaks).withColumn(name, F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).over(run))
    return out.drop("_run")

"""Performance and portfolio measures over equity, return and position tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import blocks
from tidemill.operators.aggregates import correlation


def _past(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def drawdown(eq: DataFrame, keys: Sequence[str], order: str, value: str, base: float | None = None, chunk: int | None = None) -> DataFrame:
    """Largest fall from a running peak, in percent; with ``base`` the peak starts there, else at the first value.

    With ``chunk`` (units of a numeric ``order``) a long series is cut into chunks, whose peaks are carried on.
    """
    if chunk is None:
        with_peak = eq.withColumn("_peak", F.max(value).over(_past(keys, order)))
    else:
        with_peak = blocks.running_max(eq, keys, order, value, "_peak", chunk)
    peak = F.col("_peak") if base is None else F.greatest("_peak", F.lit(float(base)))
    return with_peak.withColumn("_dd", 1 - F.try_divide(F.col(value), F.nullif(peak, F.lit(0.0)))).groupBy(*keys).agg((F.max("_dd") * 100).alias("max_dd"))


def compounded(returns: DataFrame, keys: Sequence[str], order: str, r: str, name: str = "eq") -> DataFrame:
    """Running product of 1 + r; nulls count as 0."""
    return returns.withColumn(name, F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(_past(keys, order)))


def month_number(ms: Column) -> Column:
    t = F.timestamp_millis(ms)
    return (F.year(t) * 12 + F.month(t) - 1).cast("bigint")


def monthly(eq: DataFrame, keys: Sequence[str], ts: str, value: str, first: str = "none", base: float = 10_000.0, span: tuple[int, int] | None = None) -> DataFrame:
    """(keys, month, bal, ret) on the calendar of months; a month without a value keeps the last balance.

    ``first`` says what the first month's return is measured from: "none" (it has no return), "base" (from ``base``).
    With ``span`` the calendar is those months for every key; months before the first value then have no balance, or
    with first="flat" the first one, so they return 0.
    """
    by = eq.withColumn("month", month_number(F.col(ts))).groupBy(*keys, "month").agg(F.max_by(value, ts).alias("bal"))
    bounds = by.groupBy(*keys).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    if span:
        bounds = bounds.withColumns({"lo": F.lit(span[0]).cast("bigint"), "hi": F.lit(span[1]).cast("bigint")})
    cal = bounds.select(*keys, F.explode(F.sequence("lo", "hi")).alias("month"))
    w = Window.partitionBy(*keys).orderBy("month")
    bal = F.last("bal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if first == "flat":
        bal = F.coalesce(bal, F.first("bal", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    full = cal.join(by, [*keys, "month"], "left").withColumn("bal", bal)
    before = F.lag("bal").over(w)
    if first == "base":
        before = F.coalesce(before, F.when(F.col("bal").isNotNull(), F.lit(float(base))))
    return full.withColumn("ret", F.try_divide(F.col("bal"), F.nullif(before, F.lit(0.0))) - 1)


def months_with_close(eq: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """(keys, month, bal, ret) of those months only that have a value."""
    by = eq.withColumn("month", month_number(F.col(ts))).groupBy(*keys, "month").agg(F.max_by(value, ts).alias("bal"))
    return by.withColumn("ret", F.try_divide(F.col("bal"), F.nullif(F.lag("bal").over(Window.partitionBy(*keys).orderBy("month")), F.lit(0.0))) - 1)


def green_share(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    return months.where("ret IS NOT NULL").groupBy(*keys).agg((F.avg((F.col("ret") > 0).cast("double")) * 100).alias("green"), F.count("*").alias("months"))


def yearly(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compounded return of each calendar year."""
    return months.where("ret IS NOT NULL").groupBy(*keys, F.floor(F.col("month") / 12).alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def equal_weight(months: DataFrame, member: str, mode: str = "all", least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, month, ret, n): mean return of the members in each month.

    "all": only months that all members have, and none if there are fewer than ``least`` of them; "any": every month,
    over the members that have a return; "live": months after the one in which the last member has its first return.
    """
    by = list(by)
    rows = months.where("ret IS NOT NULL")
    members = rows.groupBy(*by, member).agg(F.min("month").alias("_first")).groupBy(*by).agg(F.count("*").alias("_m"), F.max("_first").alias("_live"))
    out = rows.groupBy(*by, "month").agg(F.avg("ret").alias("ret"), F.count("*").alias("n"))
    out = out.join(members, by) if by else out.crossJoin(F.broadcast(members))
    if mode == "all":
        out = out.where("n = _m").withColumn("_k", F.count("*").over(Window.partitionBy(*(by or [F.lit(1)])))).where(F.col("_k") >= least).drop("_k")
    elif mode == "live":
        out = out.where("month > _live")
    return out.drop("_m", "_live")


def inverse_volatility(returns: DataFrame, member: str, r: str) -> DataFrame:
    """(member, weight): weights in proportion to 1 / std, which sum to 1."""
    s = returns.groupBy(member).agg(F.stddev_samp(r).alias("_s")).withColumn("_w", F.try_divide(F.lit(1.0), F.nullif("_s", F.lit(0.0))))
    total = s.agg(F.sum("_w").alias("_t"))
    return s.crossJoin(F.broadcast(total)).select(member, (F.col("_w") / F.col("_t")).alias("weight"))


def leverage_budget(returns: DataFrame, keys: Sequence[str], order: str, r: str, budget: float, levels: Sequence[float]) -> DataFrame:
    """(keys, leverage, max_dd): the largest of ``levels`` whose drawdown stays within ``budget`` percent."""
    lv = returns.withColumn("leverage", F.explode(F.array(*map(F.lit, map(float, levels)))))
    eq = compounded(lv.withColumn("_r", F.greatest(F.col("leverage") * F.col(r), F.lit(-0.999))), [*keys, "leverage"], order, "_r", "_eq")
    dd = drawdown(eq, [*keys, "leverage"], order, "_eq", 1.0).where(F.col("max_dd") <= budget)
    return dd.groupBy(*keys).agg(F.max_by("max_dd", "leverage").alias("max_dd"), F.max("leverage").alias("leverage"))


def return_over_drawdown(growth: Column, dd: Column) -> Column:
    """(growth - 1) in percent over drawdown; null without a drawdown."""
    return F.when(dd > 1e-9, (growth - 1) * 100 / dd)


def train_objective(growth: Column, dd: Column, green: Column) -> Column:
    return return_over_drawdown(growth, dd) * (0.5 + 0.5 * green / 100)


def cagr(growth: Column, months: Column) -> Column:
    return F.when((growth > 0) & (months > 0), F.pow(growth, 12 / months) - 1)


def cagr_score(growth: Column, months: Column, dd: Column) -> Column:
    return cagr(growth, months) * F.exp(-0.02 * dd)


def log_growth_score(growth: Column, dd: Column, green: Column, months: Column, least: int = 6) -> Column:
    return F.when((growth > 0) & (months >= least), F.log(growth) / F.greatest(dd, F.lit(5.0)) * 100 + green)


def ensemble_score(growth: Column, dd: Column, green: Column) -> Column:
    return green - 1.4 * dd + 6 * F.log1p(F.greatest(growth - 1, F.lit(-0.999999)))


def concentration(years: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest positive yearly log return over the sum of all positive ones."""
    x = F.log(F.when(F.col("ret") > -1, 1 + F.col("ret")))
    pos = F.when(x > 0, x)
    return years.groupBy(*keys).agg(F.try_divide(F.max(pos), F.sum(pos)).alias("concentration"))


#: Members whose pairs are formed.
MAX_MEMBERS = 5000


def pairwise_corr(wide_rows: DataFrame, member: str, time: str, x: str, least: int = 3) -> DataFrame:
    """(a, b, n, corr) of each pair of members over the times that both have; NaN where one of them does not vary.

    The pairs are the result; they grow with the square of the members, of which there may be at most MAX_MEMBERS.
    """
    if wide_rows.select(member).distinct().limit(MAX_MEMBERS + 1).count() > MAX_MEMBERS:
        raise ValueError(f"more than {MAX_MEMBERS} members")
    a = wide_rows.select(F.col(time).alias("_t"), F.col(member).alias("a"), F.col(x).alias("_x"))
    b = wide_rows.select(F.col(time).alias("_s"), F.col(member).alias("b"), F.col(x).alias("_y"))
    return a.join(b, (F.col("_t") == F.col("_s")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count(F.col("_x") + F.col("_y")).alias("n"), correlation(F.col("_x"), F.col("_y")).alias("corr")).where(F.col("n") >= least)


def extreme_pairs(pairs: DataFrame) -> DataFrame:
    """(which, a, b, n, corr) of ``pairwise_corr``: the lowest pair, the highest, and the mean of all with their number."""
    x = F.round("corr", 9)
    ends = [pairs.orderBy(order, "a", "b").limit(1).select(F.lit(name).alias("which"), "a", "b", "n", "corr") for name, order in (("lowest", x.asc()), ("highest", x.desc()))]
    kind = dict(pairs.dtypes)["a"]
    mean = pairs.agg(F.count("*").alias("n"), F.avg("corr").alias("corr")).select(F.lit("mean").alias("which"), F.lit(None).cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"), "n", "corr")
    return ends[0].unionByName(ends[1]).unionByName(mean)


def rebased(closes: DataFrame, keys: Sequence[str], day: str, c: str, base: float = 10_000.0) -> DataFrame:
    """Buy-and-hold benchmark on the calendar of days, filled both ways, beginning at ``base``."""
    bounds = closes.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    cal = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day)).join(closes.select(*keys, day, c), [*keys, day], "left")
    w = Window.partitionBy(*keys).orderBy(day)
    filled = cal.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("value", base * F.col(c) / F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def trade_factors(positions: DataFrame) -> DataFrame:
    """Adds the balance before and the factor of each position; a dead account's factor is 0 (a return of -1)."""
    before = F.col("balance") - F.col("pnl")
    return positions.withColumn("bal_before", before).withColumn("factor", F.when(before <= 1e-9, F.lit(0.0)).otherwise(F.col("balance") / before))


def skip_above(p: Column, threshold: Column, r: Column) -> Column:
    """The return, or 0 where the predicted chance of loss is above the threshold."""
    return F.when(p > threshold, F.lit(0.0)).otherwise(r)


def vol_target_leverage(daily: DataFrame, keys: Sequence[str], day: str, r: str, window: int = 60, lo: float = 0.5, hi: float = 2.0, least: int = 120, static: float | None = None) -> DataFrame:
    """Leverage of the next day: target over the realised volatility of the last ``window`` days, clipped.

    The target is the median of the volatilities so far, not of the whole sample, so no future enters. With ``static``
    the leverage is scaled so that its mean so far is that, and clipped again.
    """
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-window, -1)
    vol = daily.withColumn("_vol", F.when(F.count(r).over(w) == window, F.stddev_samp(r).over(w) * 365**0.5))
    aimed = blocks.expanding_quantiles(vol, keys, day, "_vol", {"_target": 0.5}, least, inclusive=True)
    raw = F.try_divide("_target", F.nullif("_vol", F.lit(0.0)))
    clip = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    out = aimed.withColumn("leverage", clip(raw)).drop("_vol", "_target")
    if static is None:
        return out
    mean = F.avg("leverage").over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("leverage", clip(F.col("leverage") * static / mean))

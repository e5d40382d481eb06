"""Aggregates, orderings and set operations beyond a plain group-by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.session import cut


def compound(r: Column) -> Column:
    """Product of 1 + r less 1, nulls left out."""
    return F.product(1 + r) - 1


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(F.when(x > 0, x))))


def weighted_mean(x: Column, w: Column) -> Column:
    both = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * w)), F.nullif(F.sum(F.when(both, w)), F.lit(0.0)))


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation over the rows that have both values; NaN where one of the two does not vary, as in the SQL.

    F.corr divides by zero there, which is an error under ANSI rules even in groups and frames that are left out later.
    """
    at = (lambda agg: agg) if over is None else (lambda agg: agg.over(over))
    spread = at(F.stddev_pop(F.when(y.isNotNull(), x))) * at(F.stddev_pop(F.when(x.isNotNull(), y)))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(at(F.covar_pop(x, y)), spread))


def share(pred: Column) -> Column:
    return F.avg(pred.cast("double"))


def quantile_bins(df: DataFrame, by: Sequence[str], x: str, n: int = 5, name: str = "bin") -> DataFrame:
    """Bins by exact quantiles of x within ``by``; equal bounds merge, so ties stay together."""
    steps = [k / n for k in range(1, n)]
    bounds = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, steps))).alias("_q"), F.min(x).alias("_min"))
    return df.join(bounds, list(by)).withColumn(name, F.when(F.col(x).isNotNull(), F.size(F.filter(F.array_distinct(F.col("_q")), lambda q: (F.col(x) > q) & (q > F.col("_min")))))).drop("_q", "_min")


def pivot(df: DataFrame, by: Sequence[str], column: str, values: Sequence, agg: Column) -> DataFrame:
    """Pivot over stated values, so no pass is spent on finding them."""
    return df.groupBy(*by).pivot(column, list(values)).agg(agg)


def distributed_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "_rank", count: str = "_n") -> DataFrame:
    """Adds the row's number within ``by`` (from 1) along ``order``, which must break ties, and the group's size.

    Rows are cut into ranges of (by, order); a rank is the number within the range plus the group's counts in the ranges
    before, so a group of any size is spread over tasks. The ranges are written once, as they must not be drawn twice.
    """
    by = list(by)
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by)  # one row per range of a group
    offsets = counts.select(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(by)), F.col("_part").alias("_p"), F.coalesce(F.sum("_k").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_k").over(w).alias(count))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return ranged.withColumn(rank, within).join(offsets, same).withColumn(rank, F.col(rank) + F.col("_off")).drop("_part", "_p", "_off", *(f"_g{k}" for k in range(len(by))))


def top_fraction(df: DataFrame, by: Sequence[str], order: Sequence[Column], fraction: float = 0.01, least: int = 20) -> DataFrame:
    """The best max(least, fraction of the group) rows of each group; ``order`` must break ties."""
    ranked = distributed_rank(df, by, order)
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(least), F.floor(F.lit(fraction) * F.col("_n")))).drop("_rank", "_n")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def average_rank(df: DataFrame, by: Sequence[str], x: str, name: str = "rank") -> DataFrame:
    """Rank of x within ``by``, equal values sharing the mean of their ranks.

    Ranks come from counts of distinct values, so a value that fills a third of the group is one row in the window.
    """
    by = list(by)
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(name, F.sum("_k").over(w) - (F.col("_k") - 1) / 2).drop("_k")
    return df.join(ranks, [*by, x], "left")

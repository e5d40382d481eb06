"""Joins and alignments of time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], strict: bool = False, lookback: int | None = None, part: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the last right row of the same keys at or before (``strict``: before) its ``ts``.

    Both sides go through one shuffle and one sort: right rows carry their values as a struct, left rows take the last
    one. With ``lookback`` (and only then) a right row serves for so long and the series is cut into parts of ``part``
    time units (default 16 lookbacks), right rows near a part's end being given to the next as well, so that a hot key
    is spread. Without it ``part`` alone cuts the series, and the last right row of each part is carried to the parts
    after it. Right rows with equal keys and ts: the largest values win. Nothing before: nulls.
    """
    payload = F.struct(F.col(ts).alias("_at"), *values)
    tag = 1 if strict else -1  # at equal times left rows come before right ones if strict
    lf = left.withColumns({"_v": F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType), "_side": F.lit(0)})
    rt = right.select(*keys, ts, payload.alias("_v")).withColumn("_side", F.lit(tag))
    by = list(keys)
    if lookback is not None:
        part = part or 16 * lookback
        lf = lf.withColumn("_part", F.floor(F.col(ts) / part))
        rt = rt.withColumn("_part", F.explode(F.array_distinct(F.array(F.floor(F.col(ts) / part), F.floor((F.col(ts) + lookback) / part)))))
        by.append("_part")
    elif part is not None:
        return _asof_carried(left, lf, rt, by, ts, values, part)
    w = Window.partitionBy(*by).orderBy(F.col(ts), F.col("_side"), F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    both = lf.unionByName(rt, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 0")
    fresh = F.col("_last") if lookback is None else F.when(F.col(ts) - F.col("_last._at") <= lookback, F.col("_last"))
    return both.withColumn("_last", fresh).select(*left.columns, F.col("_last._at").alias("asof_" + ts), *(F.col("_last")[v].alias(v) for v in values))


def _asof_carried(left: DataFrame, lf: DataFrame, rt: DataFrame, by: list[str], ts: str, values: Sequence[str], part: int) -> DataFrame:
    cut = F.floor(F.col(ts) / part)
    lf, rt = lf.withColumn("_part", cut), rt.withColumn("_part", cut)
    ends = rt.groupBy(*by, "_part").agg(F.max(F.struct(F.col(ts).alias("_t"), F.col("_v"))).alias("_end"), F.lit(1).alias("_r")).drop("_r")
    seen = lf.select(*by, "_part").distinct().join(ends, [*by, "_part"], "full")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.select(*by, "_part", F.last("_end._v", ignorenulls=True).over(before).alias("_carry"))
    w = Window.partitionBy(*by, "_part").orderBy(F.col(ts), F.col("_side"), F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    both = lf.unionByName(rt, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 0")
    both = both.join(carried, [*by, "_part"], "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return both.select(*left.columns, F.col("_last._at").alias("asof_" + ts), *(F.col("_last")[v].alias(v) for v in values))


def asof_clipped(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], part: int | None = None) -> DataFrame:
    """``asof_backward`` whose left rows before all right rows of their keys get the first of these: a value from their
    future, which only suits what isn't used for prediction."""
    found = asof_backward(left, right, keys, ts, values, part=part)
    first = right.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("_t"), *values)).alias("_first"))
    out = found.join(first, list(keys), "left")
    none = F.col("asof_" + ts).isNull()
    return out.select(*left.columns, F.when(none, F.col("_first._t")).otherwise(F.col("asof_" + ts)).alias("asof_" + ts), *(F.when(none, F.col("_first")[v]).otherwise(F.col(v)).alias(v) for v in values))


def zero_fill(panel: DataFrame, outcomes: DataFrame, keys: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Left join of outcomes; inside the span of a series' outcomes a missing value is 0, outside it is null."""
    span = outcomes.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    joined = panel.join(outcomes.select(*keys, day, *values), [*keys, day], "left").join(span, list(keys), "left")
    inside = F.col(day).between(F.col("_lo"), F.col("_hi"))
    return joined.withColumns({v: F.when(inside, F.coalesce(F.col(v), F.lit(0.0))).otherwise(F.col(v)) for v in values}).drop("_lo", "_hi")


def with_suffix(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_x") -> DataFrame:
    """Left join; right columns whose names the left side has get a suffix."""
    taken = set(left.columns) - set(keys)
    renamed = right.select(*keys, *(F.col(c).alias(c + suffix if c in taken else c) for c in right.columns if c not in keys))
    return left.join(renamed, list(keys), "left")


def complete_only(df: DataFrame, by: Sequence[str], member: str, n: int) -> DataFrame:
    """Rows of those ``by`` groups that all ``n`` members have."""
    full = df.groupBy(*by).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == n).drop("_n")
    return df.join(full, list(by), "left_semi")


def lookup(df: DataFrame, flags: DataFrame, keys: Sequence[str], flag: str, default: bool | None = False) -> DataFrame:
    """Adds ``flag``; rows without one get ``default``, or are dropped if that is None."""
    if default is None:
        return df.join(flags.select(*keys, flag), list(keys))
    return df.join(flags.select(*keys, flag), list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(default)))


def around_events(rows: DataFrame, events: DataFrame, keys: Sequence[str], day: str, lo: int, hi: int) -> DataFrame:
    """(event_day, offset, row columns): rows lo..hi days around each event, by an equi-join on the unfolded day."""
    unfolded = events.select(*keys, F.col(day).alias("event_day"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset"))
    return unfolded.withColumn(day, F.col("event_day") + F.col("offset")).join(rows, [*keys, day])


def within_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of an interval and the points in [start, end] of the same keys, by an equi-join on time buckets.

    Intervals are unfolded over the buckets they touch; a long one costs one row per bucket.
    """
    i = intervals.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    p = points.withColumn("_b", F.floor(F.col(ts) / bucket))
    return i.join(p, [*keys, "_b"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("_b")


def unfinished(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def overlap(series: DataFrame, member: str, ts: str) -> DataFrame:
    """Rows within the time that all members cover: the latest begin to the earliest end."""
    each = series.groupBy(member).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    common = each.agg(F.max("_a").alias("_lo"), F.min("_b").alias("_hi"))  # one row
    return series.crossJoin(F.broadcast(common)).where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


#: Rows of a frame that is broadcast as an axis of a parameter grid, and members of a pool whose subsets are made.
MAX_AXIS, MAX_POOL = 10_000, 256


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` for broadcasting, refused if it has more than ``most`` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return F.broadcast(df)


def grid(*axes: DataFrame) -> DataFrame:
    """Cartesian product of axis frames (a parameter grid, not data), all but the first of at most MAX_AXIS rows."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(small(a, MAX_AXIS))
    return out


def subsets(pool: DataFrame, item: str, sizes: Sequence[int]) -> DataFrame:
    """(members ARRAY): all subsets of the given sizes of a pool of at most MAX_POOL candidates, in ascending order."""
    base = pool.select(F.col(item)).distinct()
    held = small(base, MAX_POOL)
    level, out = base.select(F.array(item).alias("members")), None
    for k in range(1, max(sizes) + 1):
        if k > 1:
            level = level.join(held, F.col(item) > F.element_at("members", -1)).select(F.concat("members", F.array(item)).alias("members"))
        if k in sizes:
            out = level if out is None else out.unionByName(level)
    return out

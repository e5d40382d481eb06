"""Totals and averages over trailing calendar windows, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_values(df: DataFrame, entity: str, day: Column, value: str, version: str) -> DataFrame:
    """One row (entity, day, value) per entity and day: the value of the latest version, null if that is null or NaN.

    Rows with a null entity or day belong to no day and are left out. Of versions that tie, the larger value counts.
    """
    order = F.struct(F.col(version), F.col(value))
    return (
        df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))
        .select(F.col(entity).alias("entity"), day.cast("bigint").alias("day"), F.struct(F.col(value).alias("x")).alias("box"), order.alias("ord"))
        .where("entity IS NOT NULL AND day IS NOT NULL")
        .groupBy("entity", "day")
        .agg(F.max_by("box", "ord")["x"].alias("value"))
    )


def trailing_windows(daily: DataFrame, spans: Sequence[int] = (7, 30)) -> DataFrame:
    """(entity, day, value) -> one row per entity and calendar day with ``n``, ``total`` and ``avg`` for each span.

    The calendar of an entity runs from its first to its last day. It is made bucket by bucket, so the dates of one
    entity are made in many tasks. Each daily value is offered only to the coarse date buckets that its longest window
    can reach (at most two) and joined there to the dates whose trailing bounds hold it, entity and bucket being the
    equal keys and the bounds part of the condition: what leaves the join is at most max(spans) pairs a date. The pairs
    are summed under the same partitioning.

    A window without a value has n = 0 and null total and average; an average divides by the days that have a value.
    An empty input gives an empty result.
    """
    longest = max(spans)
    width = 64 if longest <= 64 else longest
    bounds = daily.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    buckets = bounds.select("entity", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("bucket")).repartition("entity", "bucket")
    within = F.sequence(F.greatest(F.col("lo"), F.col("bucket") * width), F.least(F.col("hi"), F.col("bucket") * width + (width - 1)))
    dates = buckets.select("entity", "bucket", F.explode(within).alias("day"))
    reach = F.array_distinct(F.array(F.floor(F.col("day") / width), F.floor((F.col("day") + (longest - 1)) / width)))
    offers = daily.where("value IS NOT NULL").select(F.col("entity").alias("_e"), F.col("day").alias("at"), "value", F.explode(reach).alias("_b"))
    held = (F.col("entity") == F.col("_e")) & (F.col("bucket") == F.col("_b")) & F.col("at").between(F.col("day") - (longest - 1), F.col("day"))
    pairs = dates.join(offers, held, "left")
    aggs = []
    for n in spans:
        x = F.when(F.col("at") > F.col("day") - n, F.col("value"))
        aggs += [F.count(x).alias(f"n{n}"), F.sum(x).alias(f"total{n}"), F.avg(x).alias(f"avg{n}")]
    return pairs.groupBy("entity", "bucket", "day").agg(*aggs).drop("bucket")

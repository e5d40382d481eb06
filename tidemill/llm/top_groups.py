"""The N best items of every group, whatever the groups' sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_score(df: DataFrame, groups: Sequence[str], item: str, score: str, version: str) -> DataFrame:
    """One row (groups, item, score) per item: the score of its latest version; null, NaN and infinite are no score.

    Of equally late versions the largest finite score counts. Items or groups that are null form their own item or
    group; rows with a null version come before all others. Repeated rows count once.
    """
    value = F.col(score).cast("double")
    usable = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return (
        df.select(*groups, item, F.struct(F.col(version).alias("at"), usable.alias("score")).alias("_s"))
        .groupBy(*groups, item)
        .agg(F.max("_s").alias("_s"))
        .select(*groups, item, F.col("_s.score").alias("score"))
        .where("score IS NOT NULL")
    )


#: At most so many groups are heavy; any other group then has at most one row in so many of all.
MAX_HEAVY = 10_000


def heavy_groups(scored: DataFrame, groups: Sequence[str], heavy_rows: int) -> list:
    """Keys of the groups of more than ``heavy_rows`` rows, the MAX_HEAVY largest of them if they are more."""
    sizes = scored.groupBy(*groups).agg(F.count("*").alias("_size")).where(F.col("_size") > heavy_rows)
    return sizes.orderBy(F.col("_size").desc(), *groups).limit(MAX_HEAVY).select(*groups).collect()


def top_per_group(scored: DataFrame, groups: Sequence[str], item: str, n: int, heavy_rows: int = 10_000) -> DataFrame:
    """(groups, item, score, rank) of the ``n`` best of each group; equal scores: smaller item first.

    Groups are counted exactly. The keys of the heavy ones (more than ``heavy_rows`` rows, at most MAX_HEAVY keys) are
    broadcast and tell heavy rows from light ones where they are, so no group is brought together to be sized. Heavy
    rows are sorted by range: they are spread by group and score over partitions, each partition of a group keeps its
    own ``n`` best (the partition is the salt), and what remains is ranked once more. All other rows go through one
    ordinary window. Both give the same ranks; the bound only decides where the work is done. Null groups form their
    own group. An empty input gives an empty result.
    """
    groups = list(groups)
    best = [F.col("score").desc(), F.col(item).asc()]
    rows = scored.select(*groups, item, "score")

    def ranked(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= n)

    keys = heavy_groups(rows, groups, heavy_rows)
    if not keys:
        return ranked(rows, groups)
    named = rows.select(*(F.col(g).alias(f"_h{k}") for k, g in enumerate(groups))).schema
    hot = F.broadcast(scored.sparkSession.createDataFrame(keys, named))
    same = F.lit(True)
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_h{k}"))
    light = ranked(rows.join(hot, same, "left_anti"), groups)
    ranges = rows.join(hot, same, "left_semi").repartitionByRange(*groups, *best).withColumn("_salt", F.spark_partition_id())
    heavy = ranked(ranked(ranges, [*groups, "_salt"]).drop("rank"), groups)
    cols = [*groups, item, "score", "rank"]
    return light.select(*cols).unionByName(heavy.select(*cols))

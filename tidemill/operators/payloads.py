"""What goes in and out of a job service: campaigns of configurations, and the results of runs as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRADES = "array<struct<k:bigint,exit_ts:bigint,pnl:double,reason:string>>"
RESULT = f"summary struct<trades:bigint,growth:double,last:double>, curve array<struct<day:bigint,balance:double>>, trades {TRADES}"


def results(closes: DataFrame, keys: Sequence[str], start: float) -> DataFrame:
    """(keys, payload): summary, balance at the end of each day with a close, and the closes, as one JSON text a run.

    ``closes`` has k (their order), exit_ts, pnl, reason and balance.
    """
    keys = list(keys)
    days = closes.groupBy(*keys, F.floor(F.col("exit_ts") / 86_400_000).alias("day")).agg(F.max_by("balance", "k").alias("balance"))
    curve = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "balance"))).alias("curve"))
    each = closes.groupBy(*keys).agg(F.struct(F.count("*").alias("trades"), (F.max_by("balance", "k") / start).alias("growth"), F.max_by("balance", "k").alias("last")).alias("summary"), F.array_sort(F.collect_list(F.struct("k", "exit_ts", "pnl", "reason"))).alias("trades"))
    return each.join(curve, keys).select(*keys, F.to_json(F.struct("summary", "curve", "trades")).alias("payload"))


def read(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    return documents.select(*keys, F.from_json("payload", RESULT).alias("_p")).select(*keys, "_p.*")


def campaign(configs: DataFrame, sim_id: str, order: Sequence[Column], n: int) -> DataFrame:
    """(sim_id, idx, cfg STRUCT, med, config_id): the ``n`` best configurations as jobs, numbered from 0 in their order.

    A distance guard that isn't positive is off (null).
    """
    from pyspark.sql import Window

    best = configs.orderBy(*order).limit(n)
    idx = F.row_number().over(Window.orderBy(*order)) - 1  # over the n rows of a campaign
    cfg = F.struct(F.col("W").cast("int").alias("longSMA"), F.col("tpd").alias("tp_difference"), F.col("ntp").alias("tp_count"), F.col("lev").alias("leverage"), F.col("stop").alias("stop_loose"), F.col("sltp").alias("stopLooseTP"))
    return best.select(F.lit(sim_id).alias("sim_id"), idx.alias("idx"), cfg.alias("cfg_"), F.when(F.col("maxdist") > 0, F.col("maxdist")).alias("med"), F.col("cfg").alias("config_id")).withColumnRenamed("cfg_", "cfg")

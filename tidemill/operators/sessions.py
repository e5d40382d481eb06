"""Order log to positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, by ``order``; ``chunk`` is non-decreasing along it and bounds what one task sorts."""
    keys = list(keys)
    rows = df.withColumns({"_x": value, "_chunk": chunk}).repartition(*keys, "_chunk")
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum("_x").over(within), F.lit(0))).join(offsets, [*keys, "_chunk"])
    return out.withColumn(name, F.col(name) + F.col("_off")).drop("_x", "_off", "_chunk")


def reconstruct_positions(log: DataFrame, keys: Sequence[str], direction: Column, ts: str = "timestamp", row: str = "row_no", chunk_ms: int = 7 * 86_400_000) -> DataFrame:
    """Positions from the rows (ts, row, event_type, price, amount, balance) of each series, in the order of ts and row.

    A position begins with the first Execute or StopLoose after the last Close Position (a StopLoose stands for an
    opening that was missed: its side is turned) and is over with the next Close Position; its exit is the last row
    before that. Closes without a beginning, and what is still open at the end, give none. The exit balance is the last
    one said within the position; the entry balance is that of the first row, blank if it was blank; a blank price or
    amount is 0. The return is null without both balances, and then the position is no loss.
    """
    keys = list(keys)
    held = log.where(F.col("event_type").isin("Execute", "StopLoose", "Close Position")).select(*keys, F.col(ts).alias("_ts"), F.col(row).alias("_row"), "event_type", "price", "amount", "balance", direction.alias("_dir"))
    close = F.col("event_type") == "Close Position"
    rows = running_total(held, keys, ["_ts", "_row"], F.floor(F.col("_ts") / chunk_ms), close.cast("int"), "_s").withColumn("_at", F.struct("_ts", "_row"))
    acts = ~close
    side = F.when(F.col("event_type") == "StopLoose", -F.col("_dir")).otherwise(F.col("_dir"))
    what = F.struct("_at", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("amount", F.lit(0.0)).alias("amount"), F.col("balance").alias("balance"), side.alias("side"))
    s = rows.groupBy(*keys, "_s").agg(
        F.min(F.when(acts, what)).alias("a"),
        F.max(F.when(acts, what)).alias("z"),
        F.max(F.when(acts & F.col("balance").isNotNull(), F.struct("_at", "balance"))).alias("b"),
        F.bool_or(close).alias("closed"),
        F.coalesce(F.bool_or(F.col("event_type") == "StopLoose"), F.lit(False)).alias("stopped"),
        F.count(F.when(F.col("event_type") == "Execute", 1)).alias("n_fills"),
    )
    out = s.where("closed AND a IS NOT NULL").select(
        *keys,
        F.col("a._at._ts").alias("open_ts"),
        F.col("z._at._ts").alias("exit_ts"),
        F.col("a.side").cast("int").alias("direction"),
        F.col("a.price").alias("entry_price"),
        F.col("z.price").alias("exit_price"),
        F.col("a.amount").alias("qty"),
        F.col("a.balance").alias("entry_balance"),
        F.col("b.balance").alias("exit_balance"),
        F.col("stopped").cast("int").alias("stop_hit"),
        F.when(F.col("stopped"), "stop").otherwise("reverse_or_tp").alias("exit_type"),
        "n_fills",
    )
    pnl = F.col("exit_balance") - F.col("entry_balance")
    out = out.withColumns({"pnl": pnl, "ret": F.try_divide(pnl, F.nullif("entry_balance", F.lit(0.0))), "duration_s": (F.col("exit_ts") - F.col("open_ts")) / 1000.0})
    return out.withColumns({"loss": F.coalesce(F.col("ret") < 0, F.lit(False)).cast("int"), "month": F.date_format(F.timestamp_millis("open_ts"), "yyyy-MM")})

"""Recursive averages over numbered series: exponential means of both kinds, Wilder's smoothing and what rests on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import blocks, windows
from tidemill.operators.windows import Frames


def ewm(df: DataFrame, keys: Sequence[str], x: str, span: int, name: str) -> DataFrame:
    """Exponential mean that starts at the first value (a null counts as 0); rows are numbered by ``_rn``."""
    a = 2 / (span + 1)
    y = F.when(F.col("_rn") == 0, F.col(x)).otherwise(a * F.col(x))
    return blocks.recurrences(df.withColumn("_y", y), keys, {name: ("_y", 1 - a)}).drop("_y")


def ewm_adjusted(df: DataFrame, keys: Sequence[str], x: str, span: int, name: str) -> DataFrame:
    """Exponential mean with the weights of the rows so far brought to 1."""
    q = 1 - 2 / (span + 1)
    out = blocks.recurrences(df.withColumn("_one", F.lit(1.0)), keys, {"_num": (x, q), "_den": ("_one", q)})
    return out.withColumn(name, F.col("_num") / F.col("_den")).drop("_num", "_den", "_one")


def wilder(df: DataFrame, keys: Sequence[str], of: dict[str, str], n: int = 14) -> DataFrame:
    """For each ``name: x``, x being a difference and so absent in row 0: the mean of the first n differences in row n,
    then s + (x - s) / n; null before row n, a null x counts as 0."""
    seed = Frames(keys).rows(-(n - 1))
    x = {k: F.coalesce(F.col(v), F.lit(0.0)) for k, v in of.items()}
    y = {f"_y_{k}": F.when(F.col("_rn") == n, F.sum(v).over(seed) / n).when(F.col("_rn") > n, v / n).otherwise(0.0) for k, v in x.items()}
    out = blocks.recurrences(df.withColumns(y), keys, {k: (f"_y_{k}", 1 - 1 / n) for k in of})
    return out.withColumns({k: F.when(F.col("_rn") >= n, F.col(k)) for k in of}).drop(*y)


def rsi_wilder(df: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    """Adds ``rsi``; null without a fall in the smoothing's reach."""
    dc = F.coalesce(F.col("c") - Frames(keys).lag("c"), F.lit(0.0))
    out = wilder(df.withColumns({"_gain": F.greatest(dc, F.lit(0.0)), "_loss": F.greatest(-dc, F.lit(0.0))}), keys, {"_g": "_gain", "_l": "_loss"}, n)
    return out.withColumn("rsi", 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_g", F.nullif("_l", F.lit(0.0))))).drop("_g", "_l", "_gain", "_loss")


def adx(df: DataFrame, keys: Sequence[str], n: int = 14) -> DataFrame:
    """Adds ``atr`` and ``adx``: the average true range, and the smoothed directional index (0 where it is undefined)."""
    f = Frames(keys)
    up, down = windows.directional_moves(f)
    raw = df.withColumns({"_tr": F.when(F.col("_rn") > 0, windows.true_range(f)), "_up": up, "_down": down})
    s = wilder(raw, keys, {"atr": "_tr", "_p": "_up", "_m": "_down"}, n)
    dx = F.try_divide(100 * F.abs(F.col("_p") - F.col("_m")), F.nullif(F.col("_p") + F.col("_m"), F.lit(0.0)))
    return wilder(s.withColumn("_dx", F.when(F.col("atr") > 0, dx)), keys, {"adx": "_dx"}, n).drop("_tr", "_up", "_down", "_p", "_m", "_dx")

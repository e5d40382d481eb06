"""Series cut into blocks, so that windows over one long series run in many tasks.

A window partitioned by a series key alone sends a whole series to one task. Here the rows of a series get their exact
number (counts of order-value chunks, summed, plus the number within the chunk), are cut into blocks of rows, and each
block also receives the ``halo`` rows before it (and after it). A frame that reaches at most ``halo`` rows then gives
the same result within the block as over the series.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def numbered(df: DataFrame, keys: Sequence[str], order: Column, chunk_width: float, ties: Sequence[str] = (), name: str = "_rn") -> DataFrame:
    """``df`` with the row's number in its series (from 0) by ``order``, a number; ``chunk_width`` order units are one chunk."""
    keys = list(keys)
    rows = df.withColumn("_o", order).withColumn("_chunk", F.floor(F.col("_o") / chunk_width)).repartition(*keys, "_chunk")
    counts = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_chunk").orderBy("_o", *ties)
    return rows.withColumn(name, F.row_number().over(within) - 1).join(offsets, [*keys, "_chunk"]).withColumn(name, (F.col(name) + F.col("_off")).cast("bigint")).drop("_off", "_chunk", "_o")


def rolling(df: DataFrame, keys: Sequence[str], order: Column, chunk_width: float, behind: int, fn: Callable[[DataFrame, list[str]], DataFrame], ahead: int = 0, ties: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``fn(rows, window_keys)`` on each block of each series, with its halo, whose rows are dropped afterwards.

    ``fn`` adds columns from windows partitioned by ``window_keys`` and ordered by ``_rn``; frames reach at most
    ``behind`` rows back and ``ahead`` rows on.
    """
    return windowed(numbered(df, keys, order, chunk_width, ties), keys, behind, fn, ahead, block)


def windowed(df: DataFrame, keys: Sequence[str], behind: int, fn: Callable[[DataFrame, list[str]], DataFrame], ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """``rolling`` for rows that have their number ``_rn`` already."""
    if max(behind, ahead) > block:
        raise ValueError("a halo is at most one block")
    at, own = F.col("_rn") % block, F.floor(F.col("_rn") / block)
    places = [own]
    if behind:
        places.append(F.when(at >= block - behind, own + 1))
    if ahead:
        places.append(F.when((at < ahead) & (own > 0), own - 1))
    spread = df.withColumn("_block", F.explode(F.array_compact(F.array(*places))))
    return fn(spread, [*keys, "_block"]).where(F.floor(F.col("_rn") / block) == F.col("_block")).drop("_block")


def recurrences(df: DataFrame, keys: Sequence[str], of: dict[str, tuple[str, float]], block: int = 256, rn: str = "_rn") -> DataFrame:
    """For each ``name: (y, q)``, the column name[t] = q name[t-1] + y[t] along ``rn``, 0 < q < 1; a null y counts as 0.

    Within a block the weighted sum is a running window; what earlier blocks contribute decays by q ** block each, so
    the sums of as many blocks as matter in double precision are carried over, and no pass over the series is needed.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_b": F.floor(F.col(rn) / block), "_i": F.col(rn) % block})
    power = lambda x, e: F.pow(F.lit(float(x)), e)
    rows = rows.withColumns({f"_s_{k}": power(q, F.col("_i")) * F.sum(F.coalesce(F.col(y), F.lit(0.0)) * power(1 / q, F.col("_i"))).over(inside) for k, (y, q) in of.items()})
    ends = rows.groupBy(*keys, "_b").agg(*(F.max_by(f"_s_{k}", "_i").alias(f"_c_{k}") for k in of))
    order = Window.partitionBy(*keys).orderBy("_b")

    def carry(k: str, q: float) -> Column:
        total, j = F.lit(0.0), 0
        while j == 0 or q ** (block * j) > 1e-18:
            j += 1
            total = total + F.coalesce(F.lag(f"_c_{k}", j).over(order), F.lit(0.0)) * F.lit(q ** (block * (j - 1)))
        return total

    carried = ends.select(*keys, "_b", *(carry(k, q).alias(f"_c_{k}") for k, (_, q) in of.items()))
    out = rows.join(carried, [*keys, "_b"]).withColumns({k: F.col(f"_s_{k}") + power(q, F.col("_i") + 1) * F.col(f"_c_{k}") for k, (_, q) in of.items()})
    return out.drop("_b", "_i", *(f"_s_{k}" for k in of), *(f"_c_{k}" for k in of))


def filled(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], chunk: int = 4096) -> DataFrame:
    """``values`` carried forward along the numeric column ``order``, chunk by chunk; each chunk's last value goes on to the next."""
    keys = list(keys)
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).repartition(*keys, "_chunk")
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_chunk").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_e_{v}") for v in values))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", *(F.last(f"_e_{v}", ignorenulls=True).over(before).alias(f"_c_{v}") for v in values))
    out = rows.join(carried, [*keys, "_chunk"]).withColumns({v: F.coalesce(F.last(v, ignorenulls=True).over(within), F.col(f"_c_{v}")) for v in values})
    return out.drop("_chunk", *(f"_c_{v}" for v in values))


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, chunk: int) -> DataFrame:
    """Largest value so far along the numeric column ``order``, chunk by chunk of ``chunk`` order units."""
    keys = list(keys)
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).repartition(*keys, "_chunk")
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_chunk", F.max("_top").over(before).alias("_top"))
    return rows.join(carried, [*keys, "_chunk"]).withColumn(name, F.greatest(F.max(value).over(within), F.col("_top"))).drop("_chunk", "_top")


def _with_column(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} double" for n in names])


def rank_pct(df: DataFrame, keys: Sequence[str], x: str, n: int, name: str, rn: str = "_rn", block: int = 16384) -> DataFrame:
    """Rank of x among the last n rows as a share, ties sharing their average rank; null unless all n have a value.

    ``rn`` numbers the rows of a series. Blocks with the n - 1 rows before them are ranked window by window in vectors.
    """
    keys = list(keys)
    own = F.floor(F.col(rn) / block)
    spread = df.withColumn("_block", F.explode(F.array_compact(F.array(own, F.when(F.col(rn) % block >= block - (n - 1), own + 1)))))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(rn)
        v = np.array([np.nan if y is None else y for y in rows[x].to_pylist()], float)
        out = np.full(len(v), np.nan)
        if len(v) >= n:
            windows = np.lib.stride_tricks.sliding_window_view(v, n)
            for a in range(0, len(windows), 1024):
                w = windows[a : a + 1024]
                last = w[:, -1:]
                share = ((w < last).sum(1) + ((w == last).sum(1) + 1) / 2) / n
                out[n - 1 + a : n - 1 + a + len(w)] = np.where(np.isnan(w).any(1), np.nan, share)
        mine = np.asarray(rows[rn].to_numpy()) // block == key[-1].as_py()
        return rows.drop_columns(["_block"]).append_column(name, pa.array(out, mask=np.isnan(out))).filter(pa.array(mine))

    return spread.groupBy(*keys, "_block").applyInArrow(run, _with_column(df, [name]))


class Quantile:
    """Exact quantile (linear between neighbours) of a growing set of numbers, by two heaps."""

    def __init__(self, p: float) -> None:
        self.p, self.low, self.high = p, [], []  # low: negated, the smaller part

    def add(self, x: float) -> None:
        if self.low and x <= -self.low[0]:
            heapq.heappush(self.low, -x)
        else:
            heapq.heappush(self.high, x)
        want = int((len(self.low) + len(self.high) - 1) * self.p) + 1
        while len(self.low) < want:
            heapq.heappush(self.low, -heapq.heappop(self.high))
        while len(self.low) > want:
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def value(self) -> float:
        n = len(self.low) + len(self.high)
        if not n:
            return float("nan")
        part = (n - 1) * self.p % 1
        a = -self.low[0]
        return a if not part or not self.high else a + (self.high[0] - a) * part


def expanding_quantiles(df: DataFrame, keys: Sequence[str], order: str, x: str, of: dict[str, float], least: int, inclusive: bool = False) -> DataFrame:
    """For each ``name: p``, the exact p-quantile of x over all earlier rows (with ``inclusive`` the current one as well).

    Null until there are ``least`` values; nulls and NaN are no values. One pass over a series, a logarithmic step a row:
    what a row needs is the whole past, so the series is the unit of work.
    """
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        heaps = {name: Quantile(p) for name, p in of.items()}
        out = {name: np.full(rows.num_rows, np.nan) for name in of}
        count = 0
        for i, v in enumerate(rows[x].to_pylist()):
            held = v is not None and v == v
            if inclusive and held:
                count += 1
                for h in heaps.values():
                    h.add(v)
            if count >= least:
                for name, h in heaps.items():
                    out[name][i] = h.value()
            if held and not inclusive:
                count += 1
                for h in heaps.values():
                    h.add(v)
        for name, v in out.items():
            rows = rows.append_column(name, pa.array(v, mask=np.isnan(v)))
        return rows

    return df.groupBy(*keys).applyInArrow(run, _with_column(df, list(of)))

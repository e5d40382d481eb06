"""Pairs of records of two tables that are nearest in time within one entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).min
FAR = np.iinfo(np.int64).max


class _Merge:
    """Streaming merge over batches sorted by entity part, time, right before left, id.

    Of the right side only the neighbours are held: the last record seen, and, for the left records that wait for one,
    the next. A left record waits no longer than ``tolerance`` behind the merge's position.
    """

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance
        self.group = 0
        self.right = (NONE, NONE)  # time and id of the last right record of the current group
        self.left = (NONE, NONE)  # time and id of the last left record of the current group
        self.waiting = tuple(np.empty(0, np.int64) for _ in range(5))  # group, time, id, previous right time and id

    def push(self, first: np.ndarray, is_left: np.ndarray, ts: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(ts)
        group = self.group + np.cumsum(first)
        # The rows of this batch, behind the left rows that still wait.
        wg, wt, wi, wpt, wpi = self.waiting
        index = np.arange(n)
        fresh = index == 0
        fresh[1:] = (group[1:] != group[:-1]) | (ts[1:] != ts[:-1]) | (is_left[1:] != is_left[:-1])
        same_left = np.zeros(n, bool)
        same_left[1:] = ~first[1:] & is_left[1:] & is_left[:-1] & (ts[1:] == ts[:-1]) & (ident[1:] == ident[:-1])
        if n and not first[0]:
            if not is_left[0]:
                fresh[0] = ts[0] != self.right[0]
            else:
                same_left[0] = (ts[0], ident[0]) == self.left
        lead = ~is_left & fresh  # the first right record of each instant has the smallest id
        # previous right record
        last = np.maximum.accumulate(np.where(lead, index, -1)) if n else index
        begin = np.maximum.accumulate(np.where(first, index, -1)) if n else index
        own = last >= np.maximum(begin, 0)
        carried = (begin < 0) & (last < 0)
        pt = np.where(own & (last >= 0), ts[np.maximum(last, 0)], np.where(carried, self.right[0], NONE)) if n else ts
        pi = np.where(own & (last >= 0), ident[np.maximum(last, 0)], np.where(carried, self.right[1], NONE)) if n else ts
        take = is_left & ~same_left
        g, t, i = np.concatenate([wg, group[take]]), np.concatenate([wt, ts[take]]), np.concatenate([wi, ident[take]])
        pt, pi = np.concatenate([wpt, pt[take]]), np.concatenate([wpi, pi[take]])
        place = np.concatenate([np.full(len(wg), -1), index[take]])
        # next right record at or after: the leading ones follow in order, same-instant ones come before a left record
        leads = index[lead]
        k = np.searchsorted(leads, place, side="right")
        has = k < len(leads)
        at = leads[np.minimum(k, max(len(leads) - 1, 0))] if len(leads) else np.zeros(len(k), int)
        has = has & (group[at] == g) if n else has
        nt = np.where(has, ts[at], FAR) if n else np.full(len(g), FAR)
        ni = np.where(has, ident[at], NONE) if n else np.full(len(g), NONE)
        done = np.ones(len(g), bool)
        if n:
            done = has | (g != group[-1]) | (ts[-1] - t > self.tolerance)
            self._remember(group, is_left, ts, ident, lead, first)
        result = self._choose(t[done], i[done], pt[done], pi[done], nt[done], ni[done])
        self.waiting = tuple(x[~done] for x in (g, t, i, pt, pi))
        return result

    def _remember(self, group, is_left, ts, ident, lead, first) -> None:
        current = group == group[-1]
        if first.any():
            self.right, self.left = (NONE, NONE), (NONE, NONE)
        if len(k := np.flatnonzero(lead & current)):
            self.right = (int(ts[k[-1]]), int(ident[k[-1]]))
        if len(k := np.flatnonzero(is_left & current)):
            self.left = (int(ts[k[-1]]), int(ident[k[-1]]))
        self.group = int(group[-1])

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        _, t, i, pt, pi = self.waiting
        return self._choose(t, i, pt, pi, np.full(len(t), FAR), np.full(len(t), NONE))

    def _choose(self, t, i, pt, pi, nt, ni) -> tuple[np.ndarray, np.ndarray]:
        back = np.where(pt == NONE, FAR, t - np.where(pt == NONE, t, pt))
        ahead = np.where(nt == FAR, FAR, np.where(nt == FAR, t, nt) - t)
        best = np.minimum(back, ahead)
        near = best <= self.tolerance
        return i[near], np.where(back <= ahead, pi, ni)[near]


def _merging(tolerance: int):
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _Merge(tolerance)
        for b in batches:
            col = lambda k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            a, c = merge.push(col("_first"), col("_left"), col("_ts"), col("_id"))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], schema=schema)
        a, c = merge.finish()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], schema=schema)

    return run


def side(df: DataFrame, entity: Sequence[Column], ts: Column, ident: Column) -> DataFrame:
    """(_e0, _e1, ..., _ts, _id): what ``nearest_in_time`` takes; rows with a null in any of these match nothing."""
    out = df.select(*(e.alias(f"_e{k}") for k, e in enumerate(entity)), ts.cast("bigint").alias("_ts"), ident.cast("bigint").alias("_id"))
    return out.na.drop()


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, part: int | None = None) -> DataFrame:
    """(left_id, right_id): for each left record the right record of the same entity nearest in time, if within ``tolerance``.

    Both are ``side``. Of equally near right records the earlier counts, then the smaller id. A left record that was
    delivered several times (same entity, time and id) counts once; right records may serve several left ones. Empty
    inputs give an empty result.

    Entities are cut into parts of ``part`` time units (default: 64 tolerances), so a hot entity is spread over tasks;
    a right record within ``tolerance`` of an edge of its part is given to the neighbour as well. Both sides are
    repartitioned together by entity part, sorted within the partitions and merged in one pass.
    """
    part = part or max(64 * tolerance, 1)
    if part < tolerance:
        raise ValueError("a part must be at least as long as the tolerance")
    keys = [c for c in left.columns if c.startswith("_e")]
    near = F.array_distinct(F.array(*(F.floor((F.col("_ts") + d) / part) for d in (-tolerance, 0, tolerance))))
    l_rows = left.select(*keys, F.floor(F.col("_ts") / part).alias("_part"), "_ts", F.lit(True).alias("_left"), "_id")
    r_rows = right.select(*keys, F.explode(near).alias("_part"), "_ts", F.lit(False).alias("_left"), "_id")
    by = [*keys, "_part"]
    order = Window.partitionBy(*by).orderBy("_ts", "_left", "_id")
    flagged = l_rows.unionByName(r_rows).repartition(*by).withColumn("_first", F.row_number().over(order) == 1)
    return flagged.sortWithinPartitions(*by, "_ts", "_left", "_id").select("_first", "_left", "_ts", "_id").mapInArrow(_merging(tolerance), "left_id bigint, right_id bigint")

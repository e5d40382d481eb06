"""Implausible readings per source: impossible values, spikes beyond a peaks-over-threshold cutoff, stuck values.

The residual of a bar is how far h, l and c lie from the level before it and from the level after it, whichever is
nearer and only where both lie on the same side, in logs; a lasting change of level leaves no residual. Residuals are
scaled by the source's ordinary residual at that hour of the day. What a source's scaled residuals exceed its own 90 %
quantile by is fitted with a generalised Pareto tail by maximum likelihood, and the value that the tail exceeds with a
fixed small probability is the source's cutoff. The bad readings themselves are kept out of the fit: at first the top
TRIM of the readings count only as "beyond", then everything beyond the cutoff found so far is left out and the tail is
fitted as truncated there, until the cutoff stands.

A short source says little about its tail. So the tail of all sources together, each in its own units, is fitted
first, and a source's shape and scale are drawn towards it by a normal prior, whose weight fades as the source's own
exceedances grow. There are no bounds on shape, scale or threshold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut

#: Readings of a source in one block of work, and readings of the neighbouring blocks that it also sees.
BLOCK, HALO = 16384, 32
#: Readings on either side that make the level.
REACH = 9
#: Bins of the log residual: BINS_PER_E to a factor e, from FLOOR up; zero residuals are in bin -1.
BINS_PER_E, FLOOR = 25, 1e-7
#: Values at or beyond this are fillers, not readings.
FILLER = 1e15
#: Threshold quantile of the exceedances, and the share of all readings that may be bad before the first fit.
THRESHOLD, TRIM = 0.90, 0.015
#: Chance that an ordinary reading is taken for a spike.
RISK = 3e-5
#: How far sources differ in their tail's shape and log scale: the prior's standard deviations.
SPREAD = (0.02, 0.1)
#: An hour of the day with so many readings has half a say in its own scale.
SEASON_PRIOR = 200
#: Upper decile over the middle of ordinary residuals, where a coarse tick hides the middle.
UPPER_OVER_MIDDLE = 2.8


def _nearest_residual(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Residuals of positive readings in time order."""
    n = len(c)
    if n < 3:
        return np.zeros(n)
    x = np.log(c)
    pad = np.concatenate([np.full(REACH, np.nan), x, np.full(REACH, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(pad, REACH)  # window i holds x[i-REACH .. i-1]
    inner = np.median(windows, axis=1)
    for i in np.flatnonzero(np.isnan(inner)):
        own = windows[i][~np.isnan(windows[i])]
        inner[i] = np.median(own) if len(own) else np.nan
    before, after = inner[:n], inner[REACH + 1 : REACH + 1 + n]
    out = np.zeros(n)
    for y in (np.log(h), np.log(lo), x):
        a, b = y - before, y - after
        near = np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0)
        near = np.where(np.isnan(before), np.abs(b), np.where(np.isnan(after), np.abs(a), near))
        out = np.maximum(out, near)
    return out


_FLAGGED = "symbol string, tf string, ts_ms bigint, resid double, impossible boolean, stuck boolean"


def _block(stuck_bars: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rn")
        h, lo, c, ts = (rows[k].to_numpy() for k in ("h", "l", "c", "ts_ms"))
        own = rows["own"].to_numpy(zero_copy_only=False).astype(bool)
        with np.errstate(invalid="ignore"):
            bad = ~((lo > 0) & (lo <= c) & (c <= h) & (h < FILLER))
            level = ~bad | ((c > 0) & (c < FILLER) & (h > 0) & (h < FILLER) & (lo > 0) & (lo < FILLER))
        resid = np.full(len(c), np.nan)
        resid[level] = _nearest_residual(h[level], lo[level], c[level])
        start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.array([], int)
        length = np.diff(np.append(start, len(c)))
        stuck = np.repeat(length, length) >= stuck_bars
        n = int(own.sum())
        return pa.table({"symbol": pa.repeat(key[0], n), "tf": pa.repeat(key[1], n), "ts_ms": pa.array(ts[own]), "resid": pa.array(resid[own]), "impossible": pa.array(bad[own]), "stuck": pa.array(stuck[own])})

    return run


def bar_residuals(bars: DataFrame, tf_ms: Column, stuck_bars: int = 10) -> DataFrame:
    """(symbol, tf, ts_ms, h, l, c, recv_ts) -> (symbol, tf, ts_ms, resid, impossible, stuck), one row per key with a reading.

    Rows without h, l or c, or without a key, are no readings. Of several versions of a key the latest counts, of
    equally late ones the largest (h, l, c). Readings are numbered per source (counts of time chunks, summed, plus the
    number within the chunk), cut into blocks of BLOCK and handed out with HALO readings of either neighbour, so that
    the work on a source of any length is spread and gives what one pass would: a level reaches REACH readings, a
    stuck stretch is recognised by ``stuck_bars`` <= HALO of them.
    """
    if stuck_bars > HALO:
        raise ValueError(f"stuck_bars is at most {HALO}")
    narrow = bars.select("symbol", "tf", F.col("ts_ms").cast("bigint").alias("ts_ms"), *(F.col(k).cast("double").alias(k) for k in "hlc"), "recv_ts", tf_ms.cast("bigint").alias("tf_ms"))
    chunked = narrow.where("symbol IS NOT NULL AND tf_ms IS NOT NULL AND ts_ms IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL").withColumn("chunk", F.floor(F.col("ts_ms") / (F.col("tf_ms") * 4096)))
    keyed = chunked.repartition("symbol", "tf", "chunk").groupBy("symbol", "tf", "chunk", "ts_ms").agg(F.max(F.struct("recv_ts", "h", "l", "c")).alias("r"))
    counts = keyed.groupBy("symbol", "tf", "chunk").count()
    before = Window.partitionBy("symbol", "tf").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "tf", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    numbered = (
        keyed.withColumn("i", F.row_number().over(Window.partitionBy("symbol", "tf", "chunk").orderBy("ts_ms")) - 1)
        .join(offsets, ["symbol", "tf", "chunk"])
        .select("symbol", "tf", "ts_ms", "r.h", "r.l", "r.c", (F.col("i") + F.col("offset")).alias("rn"))
    )
    block, at = F.floor(F.col("rn") / BLOCK), F.col("rn") % BLOCK
    places = F.array_compact(F.array(block, F.when((at < HALO) & (block > 0), block - 1), F.when(at >= BLOCK - HALO, block + 1)))
    spread = numbered.withColumn("home", block).withColumn("block", F.explode(places)).withColumn("own", F.col("home") == F.col("block")).drop("home")
    return spread.groupBy("symbol", "tf", "block").applyInArrow(_block(stuck_bars), _FLAGGED)


def _weighted_quantile(bins: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Of a histogram with bins in order."""
    k = int(np.searchsorted(np.cumsum(counts), q * counts.sum()))
    return float(bins[min(k, len(bins) - 1)])


class Tail(NamedTuple):
    """A generalised Pareto tail: shape and log of the scale."""

    xi: float
    log_sigma: float

    def beyond(self, chance: float) -> float:
        """The excess over the threshold that one exceedance in 1 / chance surpasses."""
        if abs(self.xi) < 1e-6:
            return float(-np.exp(self.log_sigma) * np.log(chance))
        return float(np.exp(self.log_sigma) / self.xi * (chance**-self.xi - 1))


#: Log chance that stands for "impossible", so that sums stay finite.
NEVER = -1e9


def _log_chances(excess: np.ndarray, xi: np.ndarray, log_sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log density, log chance beyond) of each excess (column) under each parameter pair (row)."""
    inner = 1 + xi[:, None] * excess[None] / np.exp(log_sigma)[:, None]
    inside = inner > 0
    grown = np.log(np.where(inside, inner, 1.0))
    beyond = np.where(inside, -grown / xi[:, None], NEVER)
    return np.where(inside, beyond - grown - log_sigma[:, None], NEVER), beyond


def fit_tail(excess: np.ndarray, n: np.ndarray, top: float, beyond: float | None = None, prior: Tail | None = None, spread: tuple[float, float] = (1.0, 1.0), start: Tail = Tail(0.1, 0.0)) -> Tail:
    """Most likely tail of counted excesses up to ``top``; with a prior, the most likely one after it.

    With ``beyond`` so many more exceedances are known to lie above ``top`` (censored); without it nothing is known of
    them (truncated). The search starts from a wide net around ``start`` (or the prior) and follows the maximum, so no
    parameter is held to a range.
    """
    at = prior or start
    x, s = at
    wx, ws = 0.6, 1.0
    for _ in range(40):
        gx, gs = (g.ravel() for g in np.meshgrid(np.linspace(x - wx, x + wx, 9), np.linspace(s - ws, s + ws, 9)))
        gx = np.where(np.abs(gx) < 1e-6, 1e-6, gx)
        density, survival = _log_chances(np.append(excess, top), gx, gs)
        score = (density[:, :-1] * n[None]).sum(1)
        if beyond is None:
            score = score - n.sum() * np.log(np.maximum(-np.expm1(survival[:, -1]), 1e-12))
        else:
            score = score + beyond * survival[:, -1]
        if prior is not None:
            score = score - 0.5 * ((gx - prior.xi) / spread[0]) ** 2 - 0.5 * ((gs - prior.log_sigma) / spread[1]) ** 2
        k = int(np.argmax(score))
        edge = abs(gx[k] - x) > 0.99 * wx or abs(gs[k] - s) > 0.99 * ws
        x, s = float(gx[k]), float(gs[k])
        if not edge:  # the best point is inside the net: draw it in
            wx, ws = wx / 3, ws / 3
            if wx < 1e-4:
                break
    return Tail(x, s)


def robust_tail(excess: np.ndarray, n: np.ndarray, chance: float, share: float, prior: Tail | None = None, spread: tuple[float, float] = (1.0, 1.0)) -> tuple[Tail, float]:
    """(tail, excess at ``chance``) of sorted excesses with counts, the bad readings left out.

    ``share`` is the part of the exceedances that may be bad (TRIM over the part of all readings that are exceedances).
    """
    top = _weighted_quantile(excess, n, max(1 - share, 0.0))
    low = excess <= top
    tail = fit_tail(excess[low], n[low], top, float(n[~low].sum()), prior, spread)
    cutoff = tail.beyond(chance)
    for _ in range(12):
        low = excess <= cutoff
        if not low.any():
            break
        tail = fit_tail(excess[low], n[low], cutoff, None, prior, spread, tail)
        last, cutoff = cutoff, tail.beyond(chance)
        if abs(cutoff - last) <= 1e-3 * last:
            break
    return tail, cutoff


def _scaled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scaled residuals in order, their counts, ordinary residual by hour of the day) from the histogram of one source.

    The histogram (hour, bin, n) has at most 24 x some hundred rows. An hour's own middle counts the more, the more
    readings it has.
    """
    value = np.where(pdf["bin"] < 0, 0.0, FLOOR * np.exp((pdf["bin"].to_numpy() + 0.5) / BINS_PER_E))
    hour, n = pdf["hour"].to_numpy(), pdf["n"].to_numpy("float64")

    def middle(mask: np.ndarray) -> float:
        o = np.argsort(value[mask], kind="stable")
        v, k = value[mask][o], n[mask][o]
        m = _weighted_quantile(v, k, 0.5)
        # a coarse tick leaves more than half of the residuals at zero: then by the upper quantile
        return m if m > 0 else _weighted_quantile(v, k, 0.9) / UPPER_OVER_MIDDLE

    base = middle(np.ones(len(n), bool))
    if base <= 0:
        positive = value[value > 0]
        base = float(positive.min()) if len(positive) else FLOOR
    season = np.ones(24)
    for k in range(24):
        mask = hour == k
        if (m := n[mask].sum()) >= 30 and (own := middle(mask) / base) > 0:
            season[k] = np.exp(m / (m + SEASON_PRIOR) * np.log(own))
    z = value / (base * season[hour])
    order = np.argsort(z, kind="stable")
    return z[order], n[order], base * season


def _exceedances(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a source gives to the tail of all sources: counts of its excesses over its own threshold, by bin."""
    z, n, _ = _scaled(pdf)
    u = _weighted_quantile(z, n, THRESHOLD)
    over = z > u
    bins = np.floor(np.log(np.maximum(z[over] - u, 1e-12)) * BINS_PER_E).astype("int32")
    return pd.DataFrame({"bin": bins, "n": n[over].astype("int64")})


def common_tail(pooled: pd.DataFrame, risk: float) -> Tail:
    """The tail of all sources together from their counted excesses (bin, n); a standard one where there are too few."""
    pooled = pooled.sort_values("bin")
    n = pooled["n"].to_numpy("float64")
    if n.sum() < 50:
        return Tail(0.1, 0.0)
    return robust_tail(np.exp((pooled["bin"].to_numpy() + 0.5) / BINS_PER_E), n, risk / (1 - THRESHOLD), TRIM / (1 - THRESHOLD))[0]


def source_tail(z: np.ndarray, n: np.ndarray, risk: float, prior: Tail, spread: tuple[float, float]) -> tuple[float, Tail, float]:
    """(threshold, tail, cutoff) of scaled residuals in order with counts."""
    u = _weighted_quantile(z, n, THRESHOLD)
    over = z > u
    rate = n[over].sum() / n.sum()
    if not rate or risk >= rate:
        return u, prior, u + prior.beyond(risk / (1 - THRESHOLD))
    tail, excess = robust_tail(z[over] - u, n[over], risk / rate, min(TRIM / rate, 0.5), prior, spread)
    return u, tail, u + excess


def _fit(risk: float, prior: Tail, spread: tuple[float, float]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n, scale = _scaled(pdf)
        u, tail, cutoff = source_tail(z, n, risk, prior, spread)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "tf": pdf["tf"].iloc[0], "hour": np.arange(24, dtype="int32"), "scale": scale, "cutoff": cutoff, "threshold": u, "sigma": float(np.exp(tail.log_sigma)), "xi": tail.xi})

    return run


def tail_cutoffs(residuals: DataFrame, risk: float = RISK, spread: tuple[float, float] = SPREAD) -> DataFrame:
    """``bar_residuals`` -> (symbol, tf, hour, scale, cutoff, threshold, sigma, xi): 24 rows per source, from its histogram.

    ``risk`` is the chance that an ordinary reading lies beyond the cutoff; ``spread`` are the standard deviations of
    shape and log scale between sources. Only the counts of the excesses of all sources together (some hundred bins)
    come to the driver.
    """
    hist = cut(
        residuals.where("resid IS NOT NULL AND NOT isnan(resid) AND NOT stuck")
        .groupBy("symbol", "tf", _hour().alias("hour"), F.when(F.col("resid") < FLOOR, F.lit(-1)).otherwise(F.floor(F.log(F.col("resid") / FLOOR) * BINS_PER_E).cast("int")).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    pooled = hist.groupBy("symbol", "tf").applyInPandas(_exceedances, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    prior = common_tail(pooled, risk)
    return hist.groupBy("symbol", "tf").applyInPandas(_fit(risk, prior, spread), "symbol string, tf string, hour int, scale double, cutoff double, threshold double, sigma double, xi double")


def _hour() -> Column:
    return (F.floor(F.col("ts_ms") / 3600000) % 24).cast("int")


def implausible_bars(bars: DataFrame, tf_ms: Column, risk: float = RISK, stuck_bars: int = 10, spread: tuple[float, float] = SPREAD) -> DataFrame:
    """(symbol, tf, ts_ms, score, impossible, stuck, spike) of the bad bars; ``score`` is the scaled residual over its cutoff.

    A source without residuals (fewer than three readings) has no spikes, only impossible and stuck bars. An empty
    input gives an empty result.
    """
    residuals = cut(bar_residuals(bars, tf_ms, stuck_bars))
    cutoffs = tail_cutoffs(residuals, risk, spread)
    score = F.col("resid") / (F.col("scale") * F.col("cutoff"))
    return (
        residuals.withColumn("hour", _hour())
        .join(cutoffs, ["symbol", "tf", "hour"], "left")
        .select("symbol", "tf", "ts_ms", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("score"), "impossible", "stuck")
        .withColumn("spike", F.col("score") > 1)
        .where("impossible OR stuck OR spike")
    )

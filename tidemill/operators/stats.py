"""Rank statistics, nulls by rotation and bootstrap, multiple testing and gates. Random draws are formulas, not rand()."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemill.operators.aggregates import average_rank
from tidemill.session import cut


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, n, rho): correlation of average ranks over the rows that have both values; null under ``least`` rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_a"), F.col(y).alias("_b"))
    ranked = average_rank(average_rank(both, by, "_a", "_ra"), by, "_b", "_rb")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
    return out.withColumn("rho", F.when((F.col("n") >= least) & ~F.isnan("rho"), F.col("rho")))


def _beta_fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), for all values at once."""
    kept = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1 / kept(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / kept(1 + num * d)
            c = kept(1 + num / c)
            out = out * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return out


def beta_regularised(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for 0 < x < 1, ``b`` being one number."""
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(a, b, np.where(near, x, 0.5)) / a
    high = 1 - front * _mirrored(b, a, np.where(near, 0.5, 1 - x)) / b
    return np.where(near, low, high)


def _mirrored(a: float, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _beta_fraction(np.full_like(x, a), b, x)


@F.pandas_udf(DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation under the t distribution with n - 2 degrees of freedom; null under three rows."""
    r, k = rho.to_numpy(dtype=float, na_value=np.nan), n.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(len(r), np.nan)
    with np.errstate(invalid="ignore"):
        known = ~np.isnan(r) & (k >= 3)
        out[known & (np.abs(r) >= 1)] = 0.0
        out[known & (r == 0)] = 1.0
        inner = known & (np.abs(r) < 1) & (r != 0)
    if inner.any():
        df = k[inner] - 2
        t2 = r[inner] ** 2 * df / (1 - r[inner] ** 2)
        out[inner] = beta_regularised(df / 2, 0.5, df / (df + t2))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def cliffs_delta(df: DataFrame, by: Sequence[str], x: str, group: str, least: int = 8) -> DataFrame:
    """(by, n1, n0, delta, auc): chance that a true row's x exceeds a false row's less the reverse, exactly, by rank sums."""
    rows = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(group).cast("boolean").alias("_g"))
    r = average_rank(rows, by, "_x", "_r").groupBy(*by).agg(F.count_if("_g").alias("n1"), F.count_if(~F.col("_g")).alias("n0"), F.sum(F.when(F.col("_g"), F.col("_r"))).alias("_s"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2
    auc = F.when((F.col("n1") >= least) & (F.col("n0") >= least), u / (F.col("n1") * F.col("n0")))
    return r.select(*by, "n1", "n0", (2 * auc - 1).alias("delta"), auc.alias("auc"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.1, mode: str = "step_up", key: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` and ``passed``. step_up keeps all up to the largest rank under its bound; per_rank those under theirs.

    Null p-values are no tests. Rows are cut into ranges of (p, key), and a rank is the number within the range plus
    the counts of the ranges before, so no task holds all tests.
    """
    ranged = cut(tests.where(F.col(p).isNotNull()).repartitionByRange(p, *key).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    m = counts.agg(F.sum("_n").alias("_m"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(p, *key))
    ranked = ranged.withColumn("rank", within).join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("rank") + F.col("_before")).cast("int")).drop("_part", "_before").crossJoin(F.broadcast(m))
    ok = F.col(p) <= F.lit(alpha) * F.col("rank") / F.col("_m")
    if mode == "per_rank":
        return ranked.withColumn("passed", ok).drop("_m")
    top = ranked.where(ok).agg(F.max("rank").alias("_top"))
    return ranked.crossJoin(F.broadcast(top)).withColumn("passed", F.coalesce(F.col("rank") <= F.col("_top"), F.lit(False))).drop("_m", "_top")


def shift_null(df: DataFrame, by: Sequence[str], order: str, flag: str, outcome: str, shifts: int, least: int = 1) -> DataFrame:
    """(by, n, observed, beyond, got, p): difference of the outcome's mean between flagged and other rows, against rotations.

    Shift j of 1..shifts rotates the flag by floor(n j / (shifts + 1)) rows against the outcome. A rotation counts if
    both sides have ``least`` rows. p = (beyond + 1) / (got + 1); null without an observed difference. Rows of one
    series are numbered without gaps; the flags that are rotated travel, not the series.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(outcome).isNotNull()).select(*by, F.col(order), F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("_f"), F.col(outcome).alias("_y")).withColumn("_i", F.row_number().over(w) - 1)
    total = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_y").alias("_sum"), F.count_if("_f").alias("_k"))
    flags = rows.where("_f").join(total, by).select(*by, "_n", F.col("_i").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(shifts))).alias("_j"))
    moved = flags.withColumn("_i", F.pmod(F.col("_at") + F.floor(F.col("_n") * F.col("_j") / (shifts + 1)), F.col("_n"))).select(*by, "_i", "_j")
    sums = moved.join(rows.select(*by, "_i", "_y"), [*by, "_i"]).groupBy(*by, "_j").agg(F.sum("_y").alias("_s"))
    d = sums.join(total, by).where((F.col("_k") >= least) & (F.col("_n") - F.col("_k") >= least))
    d = d.withColumn("_d", F.col("_s") / F.col("_k") - (F.col("_sum") - F.col("_s")) / (F.col("_n") - F.col("_k")))
    seen = d.groupBy(*by).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_j") == 0, F.col("_d"))).alias("observed"), F.collect_list(F.when(F.col("_j") > 0, F.col("_d"))).alias("_all"))
    beyond = F.size(F.filter("_all", lambda v: F.abs(v) >= F.abs(F.col("observed")) - 1e-12))
    return seen.withColumns({"beyond": beyond, "got": F.size("_all")}).drop("_all").withColumn("p", F.when(F.col("observed").isNotNull(), (F.col("beyond") + 1) / (F.col("got") + 1)))


def draw(b: Column, j: Column, n: Column) -> Column:
    """A number in 0..n-1 that depends on (b, j) alone: a table of random draws as a formula."""
    return F.pmod(b.cast("bigint") * 7919 + j.cast("bigint") * 104729 + b.cast("bigint") * j.cast("bigint") * 1299709 + F.pmod(b.cast("bigint") * b.cast("bigint"), F.lit(1009)) * 15485863, n.cast("bigint"))


def block_bootstrap_drawdown(factors: DataFrame, by: Sequence[str], order: str, factor: str, block: int = 20, samples: int = 100) -> DataFrame:
    """(by, b, max_dd): drawdown in percent of each of ``samples`` series stitched from blocks of ``block`` factors.

    A block may begin anywhere; one that begins near the end is cut off there. The peak begins at 1.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    rows = factors.select(*by, F.col(order), F.col(factor).alias("_f")).withColumn("_i", F.row_number().over(w) - 1)
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    plan = n.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_n") / block) - 1)))
    plan = plan.withColumn("_start", draw(F.col("b"), F.col("_j"), F.col("_n")))
    cells = plan.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumns({"_t": F.col("_j") * block + F.col("_o"), "_i": F.col("_start") + F.col("_o")}).where("_i < _n")
    run = Window.partitionBy(*by, "b").orderBy("_t")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    eq = cells.join(rows.select(*by, "_i", "_f"), [*by, "_i"]).withColumn("_k", F.row_number().over(run)).where("_k <= _n").withColumn("_eq", F.product("_f").over(upto)).withColumn("_pk", F.greatest(F.lit(1.0), F.max("_eq").over(upto)))
    return eq.groupBy(*by, "b").agg((F.max(1 - F.col("_eq") / F.col("_pk")) * 100).alias("max_dd"))


def shuffle_gate(base: DataFrame, idea: DataFrame, by: Sequence[str], order: str, factor: str, block: int = 20, samples: int = 100) -> DataFrame:
    """(by, real, shuffled_median, shuffled_q25, passed): does the idea lower the drawdown more in the true order than stitched?

    ``base`` and ``idea`` are trade factors (by, order, factor). ``real`` is the fall of the drawdown in the true order;
    sample b sets the base's stitched series b against the idea's. Passed: real is positive and above the median and the
    lower quartile of those.
    """
    by = list(by)

    def real(df: DataFrame, name: str) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        eq = df.withColumn("_eq", F.product(factor).over(upto))
        return eq.withColumn("_pk", F.greatest(F.lit(1.0), F.max("_eq").over(upto))).groupBy(*by).agg((F.max(1 - F.col("_eq") / F.col("_pk")) * 100).alias(name))

    a = block_bootstrap_drawdown(base, by, order, factor, block, samples).withColumnRenamed("max_dd", "_a")
    z = block_bootstrap_drawdown(idea, by, order, factor, block, samples).withColumnRenamed("max_dd", "_z")
    diff = a.join(z, [*by, "b"]).groupBy(*by).agg(F.percentile(F.col("_a") - F.col("_z"), F.array(F.lit(0.25), F.lit(0.5))).alias("_q"))
    out = real(base, "_x").join(real(idea, "_y"), by).join(diff, by).select(*by, (F.col("_x") - F.col("_y")).alias("real"), F.col("_q")[1].alias("shuffled_median"), F.col("_q")[0].alias("shuffled_q25"))
    real_, mid, low = (F.round(c, 9) for c in ("real", "shuffled_median", "shuffled_q25"))  # equal but for the order of sums is equal
    return out.withColumn("passed", (real_ > 0) & (real_ > mid) & (real_ > low))


def random_skip(df: DataFrame, by: Sequence[str], order: str, r: str, keep: str, draws: int = 30) -> DataFrame:
    """(by, kept, growth, dd, random_growth, random_dd, better): skipping by a model against skipping as many at random.

    ``keep`` tells which trades the model takes; draw b keeps the trades whose number it draws below the model's share.
    Skipped trades return 0; growth and drawdown (percent, peak from the first) of the draws are medians.
    """
    by = list(by)
    rows = df.select(*by, F.col(order).alias("_o"), F.coalesce(F.col(r), F.lit(0.0)).alias("_r"), F.coalesce(F.col(keep), F.lit(False)).alias("_k")).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_o")) - 1)
    share = rows.groupBy(*by).agg(F.avg(F.col("_k").cast("double")).alias("kept"))
    each = rows.join(share, by).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    taken = F.when(F.col("b") == 0, F.col("_k")).otherwise(draw(F.col("b"), F.col("_i"), F.lit(10_007)) < F.floor(F.col("kept") * 10_007))
    upto = Window.partitionBy(*by, "b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    eq = each.withColumn("_eq", F.product(1 + F.when(taken, F.col("_r")).otherwise(0.0)).over(upto)).withColumn("_dd", 1 - F.col("_eq") / F.max("_eq").over(upto))
    m = eq.groupBy(*by, "b").agg(F.max("kept").alias("kept"), F.max_by("_eq", "_o").alias("_g"), (F.max("_dd") * 100).alias("_d"))
    first = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    mid = lambda c: F.percentile(F.when(F.col("b") > 0, F.col(c)), F.lit(0.5))
    out = m.groupBy(*by).agg(F.max("kept").alias("kept"), first("_g").alias("growth"), first("_d").alias("dd"), mid("_g").alias("random_growth"), mid("_d").alias("random_dd"))
    return out.withColumn("better", (F.col("growth") > F.col("random_growth")) & (F.col("dd") < F.col("random_dd")))


def feature_parameter(results: DataFrame, features: DataFrame, params: Sequence[str], least: int = 4) -> DataFrame:
    """(param, feature, n, rho): does the parameter that paid in a year go with what the year was like?

    ``results`` is (year, ret, params): the preferred value of a year is the mean weighted by the positive returns.
    ``features`` is (year, feature, value). Rank correlation over at least ``least`` years.
    """
    w = F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)
    wanted = results.where(F.col("ret").isNotNull() & ~F.isnan("ret")).groupBy("year").agg(*(F.try_divide(F.sum(w * F.col(p)), F.nullif(F.sum(w), F.lit(0.0))).alias(p) for p in params))
    long = wanted.unpivot(["year"], list(params), "param", "preferred").where("preferred IS NOT NULL")
    return spearman(long.join(features, "year"), ["param", "feature"], "preferred", "value", least).where(F.col("n") >= least)


def anatomy(weeks: DataFrame, series: str, week: str, growth: str, features: Sequence[str], least_weeks: int = 30, least: int = 8) -> DataFrame:
    """(feature, loss, gain, n_series, consistent): how features differ between loss, gain and middle weeks.

    Within each series of at least ``least_weeks`` weeks, the lowest tenth by growth are loss weeks, the highest tenth
    gain weeks. ``loss`` and ``gain`` are Cliff's delta against the middle, pooled; ``consistent`` is the share of the
    series whose own loss delta has the pooled sign.
    """
    q = weeks.groupBy(series).agg(F.count("*").alias("_n"), F.percentile(growth, F.array(F.lit(0.1), F.lit(0.9))).alias("_q")).where(F.col("_n") >= least_weeks)
    kind = F.when(F.col(growth) <= F.col("_q")[0], "loss").when(F.col(growth) >= F.col("_q")[1], "gain").otherwise("mid")
    rows = weeks.join(q, series).withColumn("_kind", kind).select(series, "_kind", *(F.col(f).cast("double").alias(f) for f in features))
    long = rows.unpivot([series, "_kind"], list(features), "feature", "x").where("x IS NOT NULL")
    delta = lambda which, by: cliffs_delta(long.where(F.col("_kind").isin(which, "mid")).withColumn("_is", F.col("_kind") == which), by, "x", "_is", least)
    loss, gain = (delta(k, ["feature"]).select("feature", F.col("delta").alias(k)) for k in ("loss", "gain"))
    own = delta("loss", ["feature", series]).where("delta IS NOT NULL").join(loss, "feature")
    signs = own.groupBy("feature").agg(F.count("*").alias("n_series"), F.avg((F.signum("delta") == F.signum("loss")).cast("double")).alias("consistent"))
    return loss.join(gain, "feature", "full").join(signs, "feature", "left")


def average_scan(df: DataFrame, by: Sequence[str], order: str, c: str, outcome: str, lengths: Sequence[int], after: int = 10, least: int = 100) -> DataFrame:
    """(w, kind, n_on, n_off, diff): outcome by state, for averages of many lengths at once.

    "above": the value before lay above its average of w; "crossed": that changed within the last ``after`` rows, this
    one included. An average comes from two running sums, so a row costs the same for every length. ``diff`` is null
    with fewer than ``least`` rows on either side.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    sums = df.withColumns({"_s": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(w)})
    above = F.array(*(F.coalesce((F.col("_i") >= n) & (F.col(c) > (F.col("_s") - F.coalesce(F.lag("_s", n).over(w), F.lit(0.0))) / n), F.lit(False)) for n in lengths))
    state = sums.withColumn("_above", above).withColumn("_state", F.coalesce(F.lag("_above").over(w), F.transform("_above", lambda x: F.lit(False))))
    crossed = F.when(F.lag("_state").over(w).isNotNull(), F.zip_with("_state", F.lag("_state").over(w), lambda a, b: (a != b).cast("int")))
    marked = state.withColumn("_x", crossed)
    recent = F.collect_list("_x").over(w.rowsBetween(-after, 0))
    near = F.aggregate(recent, F.transform("_state", lambda x: F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b)))
    rows = marked.withColumn("_near", F.transform(near, lambda x: x == 1)).where(F.col(outcome).isNotNull())
    pairs = rows.select(F.col(outcome).alias("_y"), F.explode(F.arrays_zip(F.array(*map(F.lit, lengths)).alias("w"), F.col("_state").alias("above"), F.col("_near").alias("crossed"))).alias("_p"))
    flat = pairs.select("_y", F.col("_p.w").alias("w"), F.col("_p.above").alias("above"), F.col("_p.crossed").alias("crossed"))
    agg = {}
    for kind in ("above", "crossed"):
        on = F.col(kind)
        agg[kind] = F.struct(F.lit(kind).alias("kind"), F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"), (F.avg(F.when(on, F.col("_y"))) - F.avg(F.when(~on, F.col("_y")))).alias("diff"))
    out = flat.groupBy("w").agg(F.array(*agg.values()).alias("_k")).select("w", F.explode("_k").alias("_k")).select("w", "_k.*")
    return out.withColumn("diff", F.when((F.col("n_on") >= least) & (F.col("n_off") >= least), F.col("diff")))


def event_controls(spans: DataFrame, by: Sequence[str], n: str, margin: int = 14, times: int = 4) -> DataFrame:
    """(by, event_day): ``times`` control days for each of a series' events, drawn by formula within its span.

    ``spans`` is (by, lo, hi, n): first and last day and number of events; days keep ``margin`` from both ends.
    """
    room = F.col("hi") - F.col("lo") - 2 * margin
    rows = spans.where((room > 0) & (F.col(n) > 0)).withColumn("_b", F.explode(F.sequence(F.lit(1), F.col(n).cast("int") * times)))
    return rows.select(*by, (F.col("lo") + margin + draw(F.col("_b"), F.lit(3), room)).cast("bigint").alias("event_day"))


def lag_autocorrelation(df: DataFrame, by: Sequence[str], order: str, x: str, lags: Sequence[int]) -> DataFrame:
    """(by, lag, n, rho): Spearman correlation of x with x ``lag`` rows on."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = F.array(*(F.struct(F.lit(k).alias("lag"), F.lead(x, k).over(w).alias("y")) for k in lags))
    pairs = df.select(*by, F.col(x).alias("_x"), ahead.alias("_a")).select(*by, "_x", F.explode("_a").alias("_p"))
    return spearman(pairs.select(*by, "_x", F.col("_p.lag").alias("lag"), F.col("_p.y").alias("_y")), [*by, "lag"], "_x", "_y")


def sign_agreement(df: DataFrame, by: Sequence[str], series: str, half: Column, flag: str, outcome: str, least: int = 5) -> DataFrame:
    """(by, overall, first, second, agree, series_n, series_same): does an effect's sign hold in both halves and in each series?"""
    f, y = F.col(flag), F.col(outcome)
    diff = F.avg(F.when(f, y)) - F.avg(F.when(~f, y))
    d = df.withColumn("_h", half)
    total = d.groupBy(*by).agg(diff.alias("overall"), (F.avg(F.when(f & (F.col("_h") == 0), y)) - F.avg(F.when(~f & (F.col("_h") == 0), y))).alias("first"), (F.avg(F.when(f & (F.col("_h") == 1), y)) - F.avg(F.when(~f & (F.col("_h") == 1), y))).alias("second"))
    each = d.groupBy(*by, series).agg(diff.alias("_d"), F.count_if(f).alias("_a"), F.count_if(~f).alias("_b")).where((F.col("_a") >= least) & (F.col("_b") >= least) & F.col("_d").isNotNull())
    same = each.join(total, list(by)).groupBy(*by).agg(F.count("*").alias("series_n"), F.count_if(F.signum("_d") == F.signum("overall")).alias("series_same"))
    return total.join(same, list(by), "left").withColumn("agree", F.signum("first") == F.signum("second"))


def average_precision(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Mean over the positives of the precision at their score (ties share the precision behind them)."""
    by = list(by)
    counts = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("int")).alias("_p"))
    w = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumns({"_cn": F.sum("_n").over(w), "_cp": F.sum("_p").over(w)})
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_cp") / F.col("_cn")), F.sum("_p")).alias("ap"))


def super_gate(row: DataFrame) -> DataFrame:
    """Six checks of an idea against its base: return over drawdown, matched leverage, bootstrap, right tail, holdout, breadth."""
    checks = {
        "better": F.col("idea_rdd") > F.col("base_rdd"), "beats_matched": F.col("matched_rdd").isNull() | (F.col("idea_rdd") > F.col("matched_rdd")), "bootstrap": F.col("shuffle_passed"),
        "tail_kept": F.col("n5r_idea") >= F.col("n5r_base"), "holdout": F.col("oos_idea_rdd") >= F.col("oos_base_rdd"), "breadth": F.col("coins_passed") >= F.greatest(F.lit(3), F.col("coins") - 1),
    }
    out = row.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    passed = F.lit(True)
    for k in checks:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)

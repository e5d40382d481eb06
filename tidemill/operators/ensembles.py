"""Baskets of members (configurations, series) in equal parts: greedy, exhaustive, balanced, and by constraints.

Returns are long tables (member, month, ret); ``month`` numbers calendar months (year * 12 + month - 1). The months of a
table are few; what is broadcast is one row per month, or a pool whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import joins
from tidemill.operators import metrics as mt

#: Members whose returns are held at every task by the exhaustive search; a larger pool is refused.
MAX_POOL = 64
#: Months with fewer returns say nothing.
LEAST_MONTHS = 6


def basket_measures(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, growth, dd, pos_months, concentration) of return series (by, month, ret).

    The drawdown's peak begins with the first month's equity; years are compounded without the series' first month.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.withColumn("_eq", F.product(1 + F.col("ret")).over(w)).withColumn("_dd", 1 - F.col("_eq") / F.max("_eq").over(w)).withColumn("_first", F.first("month").over(w))
    total = eq.groupBy(*by).agg(F.max_by("_eq", "month").alias("growth"), (F.max("_dd") * 100).alias("dd"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("pos_months"))
    years = eq.where("month > _first").groupBy(*by, F.floor(F.col("month") / 12).alias("_y")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    return total.join(mt.concentration(years, by), by, "left")


def _fall(equity: Column, peak: Column) -> Column:
    """1 - equity / peak as floating point has it (NaN for 0 of 0), as in the SQL; a plain division by 0 is an error."""
    return 1 - F.when(peak == 0, equity * F.pow(peak, F.lit(-1.0))).otherwise(F.try_divide(equity, peak))


def basket_score(pos: Column, concentration: Column, dd: Column) -> Column:
    return pos - 50 * F.coalesce(concentration, F.lit(1.0)) - 0.3 * dd


def greedy_basket(returns: DataFrame, member: str, kmax: int = 6) -> DataFrame:
    """(k, added, growth, dd, pos_months, concentration): the best single member, then what improves the basket most.

    The first is the one with the most growth per drawdown (at least 1 %). A missing month counts as a return of 0.
    Equal scores: the smaller member. One query a step; of the basket only its sum by month is carried on.
    """
    spark = returns.sparkSession
    members, months = returns.select(F.col(member).alias("m")).distinct(), returns.select("month").distinct()
    full = members.crossJoin(F.broadcast(months)).join(returns.select(F.col(member).alias("m"), "month", "ret"), ["m", "month"], "left").select("m", "month", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    chosen: list = []
    steps: list[tuple] = []
    held: dict[int, float] = {}
    for k in range(1, kmax + 1):
        if k == 1:
            cand = full
        else:
            basket = spark.createDataFrame(sorted(held.items()), "month bigint, _sum double")
            cand = full.where(~F.col("m").isin(chosen)).join(F.broadcast(basket), "month").select("m", "month", ((F.col("ret") + F.col("_sum")) / k).alias("ret"))
        measures = basket_measures(cand, ["m"])
        score = F.col("growth") / F.greatest("dd", F.lit(1.0)) if k == 1 else basket_score(F.col("pos_months"), F.col("concentration"), F.col("dd"))
        best = measures.orderBy(F.round(score, 9).desc(), "m").limit(1).collect()
        if not best:
            break
        row = best[0]
        chosen.append(row["m"])
        steps.append((k, row["m"], row["growth"], row["dd"], row["pos_months"], row["concentration"]))
        for r in full.where(F.col("m") == F.lit(row["m"])).select("month", "ret").collect():  # one row a month
            held[r["month"]] = held.get(r["month"], 0.0) + r["ret"]
    kind = dict(returns.dtypes)[member]
    return spark.createDataFrame(steps, f"k int, added {kind}, growth double, dd double, pos_months double, concentration double")


def window_measures(returns: DataFrame, by: Sequence[str], least: int = LEAST_MONTHS) -> DataFrame:
    """(by, n, green, growth, dd, worst) of the series with at least ``least`` returns; the peak begins with the first month."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    eq = returns.where("ret IS NOT NULL").withColumn("_eq", F.product(1 + F.col("ret")).over(w)).withColumn("_dd", _fall(F.col("_eq"), F.max("_eq").over(w)))
    return eq.groupBy(*by).agg(F.count("*").alias("n"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("green"), F.max_by("_eq", "month").alias("growth"), (F.max("_dd") * 100).alias("dd"), (F.min("ret") * 100).alias("worst")).where(F.col("n") >= least)


def ensemble_objective(green: Column, dd: Column, growth: Column) -> Column:
    return green - 1.4 * dd + 6 * F.log1p(F.greatest(growth - 1, F.lit(0.0)))


def best_members(returns: DataFrame, member: str, split: int, pool: int, least: int = LEAST_MONTHS) -> DataFrame:
    """(member, objective): the ``pool`` best members by the objective on the months before ``split``."""
    m = window_measures(returns.where(F.col("month") < split), [member], least)
    return m.select(member, F.round(ensemble_objective(F.col("green"), F.col("dd"), F.col("growth")), 9).alias("objective")).orderBy(F.col("objective").desc(), member).limit(pool)


def _measured(r: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(enough, green, growth, dd) of rows of monthly returns, NaN being no month."""
    held = ~np.isnan(r)
    n = held.sum(1)
    eq = np.cumprod(np.where(held, 1 + r, 1.0), axis=1)
    peak = np.maximum.accumulate(np.where(np.cumsum(held, axis=1) > 0, eq, -np.inf), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):  # 0 of 0 is NaN
        dd = np.where(held, 1 - eq / peak, 0.0).max(1) * 100
    return n >= least, (np.where(held, r, 0) > 0).sum(1) / np.maximum(n, 1) * 100, eq[:, -1] if r.shape[1] else np.ones(len(r)), dd


def exhaustive_ensembles(returns: DataFrame, member: str, split: int, sizes: Sequence[int] = (2, 3, 4, 5), pool: int = 30, keep: int = 400, least: int = LEAST_MONTHS) -> DataFrame:
    """(members, train_objective, train_green, train_growth, train_dd, green, growth, dd, score): every subset of the pool.

    The pool are the best single members by the train months (before ``split``), at most MAX_POOL. Subsets are made and
    measured where they are; an ensemble's month is the mean of the members that have one. The ``keep`` best by the
    train objective are measured on the months from ``split`` on and ranked by green less 1.4 drawdowns there; those
    with fewer than ``least`` months on either side are none.
    """
    if pool > MAX_POOL:
        raise ValueError(f"a pool has at most {MAX_POOL} members")
    spark = returns.sparkSession
    names = [row[0] for row in best_members(returns, member, split, pool, least).select(member).collect()]
    months = sorted(row[0] for row in returns.select("month").distinct().collect())
    matrix = np.full((len(names), len(months)), np.nan)
    for row in returns.where(F.col(member).isin(names)).select(member, "month", "ret").collect():  # at most pool x months rows
        if row[2] is not None:
            matrix[names.index(row[0]), months.index(row[1])] = row[2]
    train = np.array([m < split for m in months], bool)
    shared = spark.sparkContext.broadcast((matrix, train))
    numbers = spark.createDataFrame([(k,) for k in range(len(names))], "k int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, early = shared.value
        for b in batches:
            for size in sorted({len(x) for x in b.column(0).to_pylist()}):
                sets = [x for x in b.column(0).to_pylist() if len(x) == size]
                for a in range(0, len(sets), 4096):
                    part = np.array(sets[a : a + 4096])
                    held = m[part]
                    n = (~np.isnan(held)).sum(1)
                    mean = np.where(n > 0, np.nansum(held, axis=1) / np.maximum(n, 1), np.nan)
                    ok1, g1, w1, d1 = _measured(mean[:, early], least)
                    ok2, g2, w2, d2 = _measured(mean[:, ~early], least)
                    score = g1 - 1.4 * d1 + 6 * np.log1p(np.maximum(w1 - 1, 0))
                    cols = [pa.array(part[ok1].tolist(), pa.list_(pa.int32())), *(pa.array(x[ok1]) for x in (score, g1, w1, d1)), *(pa.array(x[ok1], mask=~ok2[ok1]) for x in (g2, w2, d2))]
                    yield pa.RecordBatch.from_arrays(cols, names=["_k", "train_objective", "train_green", "train_growth", "train_dd", "green", "growth", "dd"])

    found = joins.subsets(numbers, "k", list(sizes)).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "_k array<int>, train_objective double, train_green double, train_growth double, train_dd double, green double, growth double, dd double")
    label = F.array(*map(F.lit, names)) if names else F.array().cast(f"array<{dict(returns.dtypes)[member]}>")
    top = found.withColumn("members", F.array_sort(F.transform("_k", lambda k: F.element_at(label, k + 1)))).orderBy(F.round("train_objective", 9).desc(), "members").limit(keep)
    return top.where("green IS NOT NULL").withColumn("score", F.col("green") - 1.4 * F.col("dd")).drop("_k")


def balanced_ranking(cells: DataFrame, by: Sequence[str], growth_min: float = 1.0, dd_max: float = 80.0, green_min: float = 35.0, top: int = 100) -> DataFrame:
    """(by, least_log_growth, mean_green, max_dd) of what passes the floors on every member, best worst member first.

    ``cells`` is (by, growth, dd, green), one row a member. Order: least log growth, mean green, smallest drawdown, key.
    """
    by = list(by)
    ok = (F.col("growth") >= growth_min) & (F.col("dd") <= dd_max) & (F.col("green") >= green_min)
    g = cells.groupBy(*by).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok"), F.min(F.log(F.greatest("growth", F.lit(1e-9)))).alias("least_log_growth"), F.avg("green").alias("mean_green"), F.max("dd").alias("max_dd"))
    return g.where("_ok").drop("_ok").orderBy(F.round("least_log_growth", 9).desc(), F.round("mean_green", 9).desc(), "max_dd", *by).limit(top)


def constrained_ranking(scalars: DataFrame, months: DataFrame, config: str, member: str, keep: Column, cap: int = 200_000, pos_min: float = 62.0, base: float = 10_000.0) -> DataFrame:
    """(config, proxy, pos_months, worst, growth, dd): constraints on scalars first, then the portfolio of what is left.

    ``scalars`` is (config, member, growth, ...): a configuration passes if ``keep`` holds on all its members. The
    ``cap`` best by the geometric mean of growth (a stated stage of the method) go on to ``months`` (config, member,
    month, bal), where a member's balance is ``base`` before its first month and carried over months without one; the
    portfolio is the mean return of the members in the months after the last of them began. Passers with at least
    ``pos_min`` percent of positive months, by growth.
    """
    passed = scalars.groupBy(config).agg(F.bool_and(F.coalesce(keep, F.lit(False))).alias("_ok"), F.exp(F.avg(F.log(F.greatest("growth", F.lit(1e-9))))).alias("proxy")).where("_ok").drop("_ok")
    passed = passed.orderBy(F.round("proxy", 9).desc(), config).limit(cap)
    rows = months.join(passed, config)
    bounds = rows.groupBy(config).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    each = rows.groupBy(config, member).agg(F.min("month").alias("_first"))
    live = each.groupBy(config).agg(F.max("_first").alias("_live"))
    cal = each.join(bounds, config).select(config, member, F.explode(F.sequence("_lo", "_hi")).alias("month"))
    w = Window.partitionBy(config, member).orderBy("month")
    full = cal.join(months.select(config, member, "month", "bal"), [config, member, "month"], "left").withColumn("bal", F.coalesce(F.last("bal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float(base))))
    ret = full.withColumn("_r", F.try_divide(F.col("bal"), F.nullif(F.lag("bal").over(w), F.lit(0.0))) - 1)
    port = ret.groupBy(config, "month").agg(F.avg("_r").alias("ret")).join(live, config).where("month > _live AND ret IS NOT NULL")
    wp = Window.partitionBy(config).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    eq = port.withColumn("_eq", F.product(1 + F.col("ret")).over(wp)).withColumn("_dd", 1 - F.col("_eq") / F.greatest(F.lit(1.0), F.max("_eq").over(wp)))
    out = eq.groupBy(config).agg((F.avg((F.col("ret") > 0).cast("double")) * 100).alias("pos_months"), (F.min("ret") * 100).alias("worst"), F.max_by("_eq", "month").alias("growth"), (F.max("_dd") * 100).alias("dd"))
    return passed.join(out, config).where(F.col("pos_months") >= pos_min).orderBy(F.col("growth").desc(), config)

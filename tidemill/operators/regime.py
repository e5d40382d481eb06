"""Strategies whose parameters follow a regime: labels by day, schedules, rotated controls, and rules that adapt slowly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import blocks, fold
from tidemill.operators import metrics as mt

DAY_MS = 86_400_000


def labels(days: DataFrame, keys: Sequence[str], day: str, signal: str, least: int = 180) -> DataFrame:
    """(keys, day, label): 0, 1, 2 by where the signal of the day before lies among the terciles of all days up to it.

    1 where the signal is missing or fewer than ``least`` earlier days have one.
    """
    q = blocks.expanding_quantiles(days.select(*keys, day, signal), keys, day, signal, {"_lo": 1 / 3, "_hi": 2 / 3}, least, inclusive=True)
    said = F.when(F.col("_lo").isNotNull() & F.col(signal).isNotNull(), F.when(F.col(signal) <= F.col("_lo"), 0).when(F.col(signal) >= F.col("_hi"), 2).otherwise(1))
    w = Window.partitionBy(*keys).orderBy(day)
    return q.select(*keys, day, F.coalesce(F.lag(said).over(w), F.lit(1)).alias("label"))


def percentile_flag(days: DataFrame, keys: Sequence[str], day: str, x: str, p: float, least: int = 180, below: bool = True) -> DataFrame:
    """(keys, day, flag): whether x of the day before lies at or below (above) the p-quantile of all days up to it."""
    q = blocks.expanding_quantiles(days.select(*keys, day, x), keys, day, x, {"_q": p}, least, inclusive=True)
    said = F.col(x) <= F.col("_q") if below else F.col(x) >= F.col("_q")
    return q.select(*keys, day, F.coalesce(F.lag(said).over(Window.partitionBy(*keys).orderBy(day)), F.lit(False)).alias("flag"))


def scaled_geometry(days: DataFrame, keys: Sequence[str], day: str, atr_share: str, least: int = 120, lo: float = 0.5, hi: float = 2.5) -> DataFrame:
    """(keys, day, ratio): yesterday's range over its median so far, within lo..hi; 1 where there is none."""
    q = blocks.expanding_quantiles(days.select(*keys, day, atr_share), keys, day, atr_share, {"_m": 0.5}, least, inclusive=True)
    x = F.when(F.col("_m") > 0, F.col(atr_share) / F.col("_m"))
    ratio = F.coalesce(F.lag(x).over(Window.partitionBy(*keys).orderBy(day)), F.lit(1.0))
    return q.select(*keys, day, F.least(F.greatest(ratio, F.lit(lo)), F.lit(hi)).alias("ratio"))


def rotated(days: DataFrame, keys: Sequence[str], day: str, value: str, shifts: Sequence[float]) -> DataFrame:
    """(keys, shift, day, value): the values rotated against the days, the day taking that of floor(n * share) days on.

    ``shifts`` are shares of a series' length; 0 leaves it as it is. Rotation keeps a series' own pattern and breaks its
    tie to the market.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(day)
    rows = days.select(*keys, day, value).withColumn("_i", F.row_number().over(w) - 1)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = rows.join(n, keys).withColumn("shift", F.explode(F.array(*(F.lit(float(s)) for s in shifts))))
    moved = at.select(*keys, "shift", F.pmod(F.col("_i") - F.floor(F.col("_n") * F.col("shift")), F.col("_n")).cast("int").alias("_i"), F.col(value).alias("_v"))
    return rows.select(*keys, day, "_i").join(moved, [*keys, "_i"]).select(*keys, "shift", day, F.col("_v").alias(value))


def by_label(labelled: DataFrame, keys: Sequence[str], day: str, mapping: dict[int, dict[str, float]], config_id: Column) -> DataFrame:
    """Schedule (keys, config_id, day, parameters): each day's label looked up in ``mapping``."""
    names = sorted({k for m in mapping.values() for k in m})
    out = {}
    for name in names:
        x = F.lit(None).cast("double")
        for label, m in mapping.items():
            if name in m:
                x = F.when(F.col("label") == label, F.lit(float(m[name]))).otherwise(x)
        out[name] = x
    return labelled.select(*keys, config_id.cast("bigint").alias("config_id"), F.col(day).alias("day"), *(v.alias(k) for k, v in out.items()))


def equity_measures(equity: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, growth, max_dd, green, worst, months) of daily equity (by, day, equity); drawdown and worst month as shares."""
    by = list(by)
    rows = equity.withColumn("_ts", F.col("day") * DAY_MS)
    dd = mt.drawdown(rows, by, "day", "equity").withColumn("max_dd", -F.col("max_dd") / 100)
    months = mt.months_with_close(rows, by, "_ts", "equity").where("ret IS NOT NULL").groupBy(*by).agg(F.avg((F.col("ret") > 0).cast("double")).alias("green"), F.min("ret").alias("worst"), F.count("*").alias("months"))
    growth = rows.groupBy(*by).agg((F.max_by("equity", "day") / F.min_by("equity", "day")).alias("growth"))
    return growth.join(dd, by).join(months, by, "left")


# ---- slow adaptation of one parameter ------------------------------------------------------------------------------------

#: Parameters that a rule may scale, with the range they are held to; the ranges of the multiplier; features.
ADAPTS = {"lev": (0.1, 5.0), "tpd": (0.0, float("inf")), "stop": (0.001, 0.03)}
RANGES = [(0.5, 1.5), (0.33, 1.0), (1.0, 2.0)]
FEATURES = ["rvol", "er", "ncross", "volvol"]


def slow_features(days: DataFrame, keys: Sequence[str], window: int = 90, inner: int = 20) -> DataFrame:
    """(keys, day, FEATURES) of days (keys, day, _rn, c, ncross): realised volatility, efficiency of the log path, crossings
    a day and volatility of volatility over ``window`` days, as of the day before."""

    def fn(df: DataFrame, by: list[str]) -> DataFrame:
        from tidemill.operators.windows import Frames

        f = Frames(by)
        df = df.withColumns({"_lc": F.log("c"), "_lr": f.log_return("c")}).withColumn("_rv", f.std(F.col("_lr"), inner))
        out = {"rvol": f.std(F.col("_lr"), window) * 365**0.5, "er": F.try_divide(F.abs(F.col("_lc") - f.lag("_lc", window)), F.nullif(f.total(F.abs("_lr"), window), F.lit(0.0))), "ncross": f.mean(F.col("ncross").cast("double"), window), "volvol": f.std(F.col("_rv"), window)}
        df = df.withColumns({f"_x_{k}": v for k, v in out.items()})
        return df.select(*by, "day", "_rn", *(f.lag(f"_x_{k}").alias(k) for k in FEATURES))

    return blocks.windowed(days, list(keys), window + inner + 2, fn).drop("_rn")


def normalised(features: DataFrame, keys: Sequence[str], day: str, names: Sequence[str], split_day: int) -> DataFrame:
    """The features as z scores by the days before ``split_day``, clipped to +-2.5 and brought to -1..1; missing is 0."""
    keys = list(keys)
    early = features.where(F.col(day) < split_day).groupBy(*keys).agg(*(F.avg(n).alias(f"_m_{n}") for n in names), *(F.stddev_pop(n).alias(f"_s_{n}") for n in names))
    z = {n: F.coalesce((F.col(n) - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + 1e-12), F.lit(0.0)) for n in names}
    return features.join(early, keys, "left").select(*keys, day, *((F.least(F.greatest(x, F.lit(-2.5)), F.lit(2.5)) / 2.5).alias(n) for n, x in z.items()))


def rules() -> list[tuple[str, str, float, float, bool]]:
    """The 72 rules: parameter, feature, range of the multiplier, turned round or not."""
    return [(p, f, lo, hi, inv) for p in ADAPTS for f in FEATURES for lo, hi in RANGES for inv in (False, True)]


def replay_adaptive(bars: DataFrame, configs: DataFrame, keys: Sequence[str] = ("symbol",), start: float = 10_000.0, floor_per_w: int = 0) -> DataFrame:
    """(keys, POSITION) of configurations one of whose parameters follows a feature, fixed at entry.

    ``bars`` is that of ``fold.replay_grid`` with the normalised FEATURES; ``configs`` also has ``param`` (null: none),
    ``feature``, ``lo``, ``hi``, ``inverted`` and ``shift``, the share of the series by which the feature is rotated. The
    parameter at a bar is its own value times a factor that runs from lo to hi as the feature runs from -1 to 1.
    """
    names = list(keys)
    extra = ["param", "feature", "lo", "hi", "inverted", "shift"]
    rows = bars.where("h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL").select(*names, "w", "ts_ms", F.coalesce("o", "c").alias("o"), "h", "l", "c", "ma", *FEATURES)
    full = fold.with_defaults(configs).join(configs.select("config_id", *extra), "config_id")
    handed, work = fold.spread(rows, full, names)
    schema = fold.arrow_schema(bars, names, fold.POSITION)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = tuple(k.as_py() for k in key)[: len(names)]
        left, right = left.sort_by("ts_ms"), right.sort_by("config_id")
        b, ids = fold.series_of(left), right["config_id"].to_numpy()
        b.day = np.arange(len(b.c))
        z = {f: np.nan_to_num(left[f].to_numpy(zero_copy_only=False).astype(float)) for f in FEATURES}
        said = [right[c].to_pylist() for c in extra]
        found = []
        for s in range(0, len(ids), 256):  # the plan is a matrix of bars x configurations
            part = slice(s, s + 256)
            cfg = fold._slice(fold.vectors(right), part)
            plan = {p: np.tile(cfg[p], (len(b.c), 1)) for p in fold.SCHEDULED}
            for j, (param, feature, lo, hi, inverted, shift) in enumerate(zip(*(c[part] for c in said))):
                if param is not None:
                    x = np.roll(-z[feature] if inverted else z[feature], int(len(b.c) * (shift or 0.0)))
                    least, most = ADAPTS[param]
                    plan[param][:, j] = np.clip(plan[param][:, j] * np.clip(0.5 * (lo + hi) + 0.5 * x * (hi - lo), lo, hi), least, most)
            columns, _, _ = fold.replay(b, cfg, start, floor_per_w * int(right["w"][0].as_py()), schedule=plan)
            found.append(fold.positions_table(key, columns, ids[part], schema))
        return pa.concat_tables(found)

    by = [*names, "w", "chunk"]
    return handed.groupBy(*by).cogroup(work.groupBy(*by)).applyInArrow(run, f"{fold.kinds_of(bars, names)}, {fold.POSITION}")


def window_objective(positions: DataFrame, keys: Sequence[str], span: tuple[int, int], lo: int | None, hi: int | None) -> DataFrame:
    """(config_id, growth, dd, pos_months, objective) of the mean over the series of monthly returns in months lo..hi.

    Months go over ``span`` for every series, flat before its first close. Fewer than six months: a null objective.
    """
    months = mt.monthly(positions, [*keys, "config_id"], "exit_ts", "balance", "flat", span=span).where("ret IS NOT NULL")
    port = months.groupBy("config_id", "month").agg(F.avg("ret").alias("ret"))
    port = port.where((F.col("month") >= (lo if lo is not None else -(10**9))) & (F.col("month") < (hi if hi is not None else 10**9)))
    w = Window.partitionBy("config_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    eq = port.withColumn("_eq", F.product(1 + F.col("ret")).over(w)).withColumn("_dd", 1 - F.col("_eq") / F.max("_eq").over(w))
    m = eq.groupBy("config_id").agg(F.max_by("_eq", "month").alias("growth"), (F.max("_dd") * 100).alias("dd"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("pos_months"), F.count("*").alias("n"))
    return m.withColumn("objective", mt.log_growth_score(F.greatest("growth", F.lit(1e-6)), F.col("dd"), F.col("pos_months"), F.col("n")))


def lockbox(bars: DataFrame, base: dict[str, float], split_ms: int, keys: Sequence[str] = ("symbol",), controls: int = 30) -> DataFrame:
    """(kind, rule, growth, dd, pos_months, objective, wins) of the rule that does best before the split, frozen, after it.

    Rows: the chosen rule in sample and out, the static configuration out of sample, and the 95 % quantile of the same
    rule with its feature rotated by ``controls`` shares. The rule wins if it beats both out of sample.
    """
    spark = bars.sparkSession
    every = rules()
    columns = list(base)
    schema = "config_id bigint, param string, feature string, lo double, hi double, inverted boolean, shift double, " + ", ".join(f"{c} double" for c in columns)
    row = lambda n, rule, shift=0.0: (n, *(rule or (None, None, None, None, None)), shift, *(float(base[c]) for c in columns))
    ends = bars.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z")).select(mt.month_number(F.col("a")).alias("a"), mt.month_number(F.col("z")).alias("z")).first()
    if ends["a"] is None:
        return spark.createDataFrame([], "kind string, rule string, growth double, dd double, pos_months double, objective double, wins boolean")
    span = (ends["a"], ends["z"])
    split = spark.range(1).select(mt.month_number(F.lit(split_ms))).first()[0]
    trained = replay_adaptive(bars, spark.createDataFrame([row(n, x) for n, x in enumerate(every)], schema), keys)
    best = window_objective(trained, keys, span, None, split).orderBy(F.round("objective", 9).desc_nulls_last(), "config_id").limit(1).collect()
    if not best:
        return lockbox(bars.limit(0), base, split_ms, keys, controls)
    rule = every[best[0]["config_id"]]
    shares = [0.25 + 0.5 * (k + 1) / (controls + 1) for k in range(controls)]
    tested = replay_adaptive(bars, spark.createDataFrame([row(0, rule), row(1, None), *(row(2 + k, rule, s) for k, s in enumerate(shares))], schema), keys)
    out = {r["config_id"]: r for r in window_objective(tested, keys, span, split, None).collect()}  # one row a control
    name = "{} by {} {}..{}{}".format(*rule[:4], " inverted" if rule[4] else "")
    of = lambda r: (r["growth"], r["dd"], r["pos_months"], r["objective"]) if r is not None else (None,) * 4
    scores = [out[k]["objective"] for k in out if k >= 2 and out[k]["objective"] is not None]
    bar = float(np.percentile(scores, 95)) if scores else None
    mine, still = of(out.get(0))[3], of(out.get(1))[3]
    wins = None if mine is None or still is None or bar is None else mine > still and mine > bar
    rows = [("in_sample", name, *of(best[0]), None), ("out_of_sample", name, *of(out.get(0)), wins), ("static", "none", *of(out.get(1)), None), ("control_p95", name, None, None, None, bar, None)]
    return spark.createDataFrame(rows, "kind string, rule string, growth double, dd double, pos_months double, objective double, wins boolean")

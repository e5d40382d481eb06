"""The crossing strategy as a relational plan: signals, candidates, outcomes, chain.

With proportional sizing a trade's outcome (exit bar, reason, factor on the balance) depends on its entry bar,
direction and configuration alone, and where it exits on still less: the rungs, the stop and, if it may be liquidated,
the leverage. So every signal gets its exit for each such geometry by a range join to the bars up to the next opposite
signal, where a position ends at the latest; configurations that share a geometry share its exits and add their fee,
leverage and distance guard. Then each configuration walks from a trade's exit to the next signal it may take; equity is
the running product of the factors.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.fold import DEAD, with_defaults

#: Bars of one bucket of the range join.
BUCKET = 512


def crossing_signals(bars: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """``bars`` (keys, i, h, l, c, ma) with ``signal``: +1 or -1 where the average lay in the bar before and not in this one."""
    w = Window.partitionBy(*keys).orderBy("i")
    inside = (F.col("l") < F.col("ma")) & (F.col("ma") < F.col("h")) if strict else (F.col("l") <= F.col("ma")) & (F.col("ma") <= F.col("h"))
    flagged = bars.withColumn("_in", inside)
    crossed = F.lag("_in").over(w) & ~F.col("_in")
    return flagged.withColumn("signal", F.when(F.coalesce(crossed, F.lit(False)), F.when(F.col("c") > F.col("ma"), 1).otherwise(-1)).otherwise(0)).drop("_in")


def geometries(configs: DataFrame) -> DataFrame:
    """The configurations with ``geo``, which those have in common that exit alike."""
    full = with_defaults(configs).select("config_id", "w", "tpd", "ntp", "lev", "stop", "sltp", "maxdist", "fee", "mmr", "liq")
    margin = (F.when(F.col("liq"), F.col(c)) for c in ("lev", "mmr"))
    return full.withColumn("geo", F.xxhash64("w", "tpd", "ntp", "stop", "sltp", "liq", *margin))


def candidates(marked: DataFrame, geo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signals x geometries of the same average length, each with the next opposite signal."""
    after = Window.partitionBy(*keys).orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    s = marked.where("signal <> 0")
    opposite = F.when(F.col("signal") > 0, F.min(F.when(F.col("signal") < 0, F.col("i"))).over(after)).otherwise(F.min(F.when(F.col("signal") > 0, F.col("i"))).over(after))
    s = s.select(*keys, F.col("i").alias("entry_i"), F.col("ts_ms").alias("open_ts"), F.col("signal").alias("dir"), F.col("c").alias("entry"), F.col("ma").alias("entry_ma"), opposite.alias("next_opp"))
    return s.join(geo.drop("config_id", "fee", "maxdist").dropDuplicates(["geo"]), "w")


def outcomes(cand: DataFrame, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each candidate with ``exit_i``, ``exit_ts``, ``exit``, ``reason`` and ``m`` rungs filled; OPEN if it is still held at the end."""
    keys = list(keys)
    last = bars.groupBy(*keys).agg(F.max("i").alias("_last"))
    wide = cand.join(last, keys).withColumn("_to", F.coalesce("next_opp", "_last")).where("_to > entry_i")
    wide = wide.withColumn("_b", F.explode(F.sequence(F.floor((F.col("entry_i") + 1) / BUCKET), F.floor(F.col("_to") / BUCKET))))
    ticks = bars.select(*keys, "i", F.col("ts_ms").alias("t"), F.col("o").alias("bo"), F.col("h").alias("bh"), F.col("l").alias("bl"), F.col("c").alias("bc"), F.col("ma").alias("bma"), F.floor(F.col("i") / BUCKET).alias("_b"))
    held = wide.join(ticks, [*keys, "_b"]).where("i > entry_i AND i <= _to")
    side = F.col("dir")
    best = F.when(side > 0, F.col("bh")).otherwise(F.col("bl"))
    worst = F.when(side > 0, F.col("bl")).otherwise(F.col("bh"))
    run = Window.partitionBy(*keys, "geo", "entry_i").orderBy("i")
    reach = F.when(side > 0, F.max("bh").over(run.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.min("bl").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumns({"reach": reach, "worst": worst, "best": best}).withColumn("reach_before", F.lag("reach").over(run))

    def rungs(x):
        levels = F.transform(F.sequence(F.lit(1), F.greatest(F.col("ntp"), F.lit(1))), lambda k: F.col("entry") * (1 + side * F.col("tpd") * k))
        return F.when(F.col("ntp") > 0, F.coalesce(F.size(F.filter(levels, lambda p: (x - p) * side >= 0)), F.lit(0))).otherwise(0)

    held = held.withColumns({"m0": F.when(F.col("reach_before").isNull(), 0).otherwise(rungs(F.col("reach_before"))), "m1": rungs(F.col("reach"))})
    base = F.col("entry") * (1 - side * F.col("stop"))
    trailed = F.when(side > 0, F.greatest(base, F.col("bma"))).otherwise(F.least(base, F.col("bma")))
    level = F.when(F.col("m0") >= F.col("sltp"), trailed).otherwise(base)
    liq = F.when(F.col("liq") & (F.col("lev") > 0), F.col("entry") * (1 - side * (1 - F.col("mmr")) / F.col("lev")))
    held = held.withColumns({"level": level, "liq_price": liq})
    beyond = lambda x, y: (x - y) * side <= 0
    dead = F.coalesce(beyond(F.col("worst"), F.col("liq_price")) & (beyond(F.col("level"), F.col("liq_price")) | beyond(F.col("bo"), F.col("liq_price"))), F.lit(False))
    reason = F.when(dead, "LIQ").when(beyond(F.col("worst"), F.col("level")), "SL").when(F.col("m1") >= F.greatest(F.col("ntp"), F.lit(1)), "TP").when(F.col("i") == F.col("next_opp"), "REVERSE")
    price = F.when(reason == "LIQ", F.col("liq_price")).when(reason == "SL", F.col("level")).when(reason == "TP", F.col("entry") * (1 + side * F.col("tpd") * F.col("ntp"))).otherwise(F.col("bc"))
    exits = held.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("exit", price)
    filled = F.when(F.col("reason").isin("LIQ", "SL"), F.col("m0")).otherwise(F.least("m1", "ntp"))
    exits = exits.withColumn("m", filled)
    first = exits.groupBy(*keys, "geo", "entry_i").agg(F.min(F.struct("i", "t", "exit", "reason", "m")).alias("x"))
    done = first.select(*keys, "geo", "entry_i", F.col("x.i").alias("exit_i"), F.col("x.t").alias("exit_ts"), "x.exit", "x.reason", "x.m")
    every = cand.select(*keys, "geo", "entry_i", "open_ts", "dir", "entry", "entry_ma")
    return every.join(done, [*keys, "geo", "entry_i"], "left").withColumn("reason", F.coalesce("reason", F.lit("OPEN")))


def factors(found: DataFrame, configs: DataFrame) -> DataFrame:
    """``outcomes`` of each geometry for the configurations that have it, without blocked entries, with ``factor`` on the balance."""
    each = found.join(configs.select("geo", "config_id", "tpd", "ntp", "lev", "maxdist", "fee"), "geo")
    far = (F.col("maxdist") > 0) & (F.col("entry_ma") != 0) & (F.abs(F.col("entry") - F.col("entry_ma")) / F.col("entry_ma") > F.col("maxdist"))
    side = F.col("dir")
    steps = F.col("m") * (F.col("m") + 1) / 2
    n = F.greatest(F.col("ntp"), F.lit(1))
    rest = 1 - F.col("m") / n
    ladder = F.col("lev") * F.col("tpd") * steps / n - F.col("fee") * F.col("lev") * (F.col("m") + side * F.col("tpd") * steps) / n
    tail = F.when(F.col("reason") == "LIQ", -rest).otherwise(F.col("lev") * rest * (side * (F.col("exit") / F.col("entry") - 1) - F.col("fee") * F.col("exit") / F.col("entry")))
    factor = 1 - F.col("fee") * F.col("lev") + ladder + tail
    factor = F.when(F.col("reason") == "LIQ", F.greatest(factor, F.lit(0.0))).otherwise(factor)
    return each.where(~F.coalesce(far, F.lit(False))).withColumn("factor", factor)


def resolve(trades: DataFrame, keys: Sequence[str], start: float = 10_000.0) -> DataFrame:
    """The trades that each configuration really makes, with the balance after each.

    The next trade begins after the exit bar, or on it if the exit was a reverse. A group is the candidates of one
    series and configuration: one row per signal, not per bar.
    """
    names = [*keys, "config_id", "entry_i", "open_ts", "dir", "entry", "exit_i", "exit_ts", "exit", "reason", "factor"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_i", kind="stable")
        take, bal, balances, free, reverse = [], start, [], -1, False
        for k, (e, x, why, f) in enumerate(zip(pdf["entry_i"], pdf["exit_i"], pdf["reason"], pdf["factor"])):
            if bal <= DEAD:
                break
            if e > free or (reverse and e == free):
                if why == "OPEN":
                    break
                bal *= f
                take.append(k)
                balances.append(bal)
                free, reverse = x, why == "REVERSE"
        return pdf.iloc[take][names].assign(balance=balances)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for n in names for f in trades.schema if f.name == n)
    return trades.groupBy(*keys, "config_id").applyInPandas(walk, schema + ", balance double")


def trade_chain(bars: DataFrame, configs: DataFrame, keys: Sequence[str] = ("symbol", "w"), start: float = 10_000.0, floor_per_w: int = 0) -> DataFrame:
    """Trades of every configuration on ``bars`` (keys with w, i, ts_ms, o, h, l, c, ma); bars without an average don't trade.

    ``i`` numbers the bars of a series from 0 without gaps. Positions that are open at the end are no trades. The plan
    covers fixed and trailing stops, ladders, fees, the distance guard and liquidation; sizing that depends on the
    balance's path is for ``fold.replay_grid``.
    """
    marked = crossing_signals(bars, keys).withColumn("signal", F.when(F.col("i") >= F.greatest(F.lit(1), floor_per_w * F.col("w")), F.col("signal")).otherwise(0))
    geo = geometries(configs)
    return resolve(factors(outcomes(candidates(marked, geo, keys), bars, keys), geo), keys, start)

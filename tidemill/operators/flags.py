"""Daily flags: technical ones known the day before, calendar ones of the day itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators import blocks, joins
from tidemill.operators.smoothing import ewm_adjusted, rsi_wilder
from tidemill.operators.windows import Frames

#: Dates of halvings; a new moon in days since 1970 (6 January 2000, 18:14 UTC), the length of a lunation,
#: and the phases that bound new and full moon; the years whose holidays count; share of a level that is near it.
HALVINGS = ["2016-07-09", "2020-05-11", "2024-04-20"]
NEW_MOON, SYNODIC, LATE, FULL = 10962 + (18 * 60 + 14) / 1440, 29.530588, 26.53, 14.765
HOLIDAY_YEARS = (2018, 2025)
NEAR = 0.005

TECHNICAL = [
    "golden_state", "momentum12m", "momentum90d", "dip5", "dip10", "rsi_oversold", "rsi_overbought", "above_ma200", "macd_bull", "macd_bullcross_w5", "bb_lower", "bb_upper", "squeeze_w10",
    "breakout_highvol", "breakout_lowvol", "breakout50", "round_number", "mayer_low", "mayer_high", "picycle_w90", "near_200wma",
]
#: Windows that begin the day after their event and are not lagged again.
AFTER = {"deadcat_w20": 20, "engulf_w5": 5}


def round_levels(closes: DataFrame, key: str, c: str = "c") -> DataFrame:
    """(key, levels): the round numbers of a series' own size: 1 to 9.5 in halves, times the power of ten below its median."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5)))))
    return closes.groupBy(key).agg(size.alias("_s")).select(key, F.transform(F.sequence(F.lit(2), F.lit(19)), lambda k: k / 2 * F.col("_s")).alias("levels"))


def technical(bars: DataFrame, levels: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """(keys, day, TECHNICAL, AFTER) of daily bars (keys, day, _rn, o, h, l, c, v); ``levels`` is ``round_levels``.

    Each is the state of the day itself, not yet lagged; a flag whose windows aren't filled is false. Windows after an
    event go by calendar days.
    """
    keys = list(keys)
    f, days, c = Frames(keys), Frames(keys, "day"), F.col("c")
    m = {n: f.mean(c, n) for n in (20, 50, 111, 200, 350, 1400)}
    df = bars.withColumns({f"m{n}": x for n, x in m.items()} | {"s20": f.std(c, 20), "chg": f.change("c"), "hi20": f.highest(F.col("h"), 20, 1), "hi50": f.highest(F.col("h"), 50, 1), "v20": f.mean(F.col("v"), 20, 1)})
    df = blocks.rank_pct(df.withColumn("width", F.try_divide(4 * F.col("s20"), F.col("m20"))), keys, "width", 250, "narrow")
    df = ewm_adjusted(ewm_adjusted(ewm_adjusted(df, keys, "c", 12, "e12"), keys, "c", 26, "e26").withColumn("macd", F.col("e12") - F.col("e26")), keys, "macd", 9, "sig")
    df = rsi_wilder(df, keys).join(levels, keys[-1], "left")
    bull, pi = F.col("macd") > F.col("sig"), F.coalesce(F.col("m111") > 2 * F.col("m350"), F.lit(False))
    df = df.withColumns({"bull": bull, "pi": pi})
    onset = lambda x: F.col(x) & ~F.coalesce(f.lag(x), F.lit(False))
    engulf = (c > F.col("o")) & (f.lag("o") > f.lag("c")) & (c > f.lag("o")) & (F.col("o") < f.lag("c"))
    df = df.withColumns({"e_squeeze": F.coalesce(F.col("narrow") < 0.10, F.lit(False)), "e_bull": onset("bull"), "e_pi": onset("pi"), "e_cat": F.coalesce((f.change("c", 10) <= -0.20) & (F.col("chg") >= 0.05), F.lit(False)), "e_engulf": F.coalesce(engulf, F.lit(False))})
    up20 = c > F.col("hi20")
    flag: dict[str, Column] = {
        "golden_state": F.col("m50") > F.col("m200"), "momentum12m": f.change("c", 365) > 0, "momentum90d": f.change("c", 90) > 0, "dip5": F.col("chg") <= -0.05, "dip10": F.col("chg") <= -0.10,
        "rsi_oversold": F.col("rsi") < 30, "rsi_overbought": F.col("rsi") > 70, "above_ma200": c > F.col("m200"), "macd_bull": F.col("bull"), "macd_bullcross_w5": days.after_event(F.col("e_bull"), 5),
        "bb_lower": c < F.col("m20") - 2 * F.col("s20"), "bb_upper": c > F.col("m20") + 2 * F.col("s20"), "squeeze_w10": days.after_event(F.col("e_squeeze"), 10),
        "breakout_highvol": up20 & (F.col("v") > 1.5 * F.col("v20")), "breakout_lowvol": up20 & (F.col("v") <= 1.5 * F.col("v20")), "breakout50": c > F.col("hi50"),
        "round_number": F.exists(F.coalesce("levels", F.array().cast("array<double>")), lambda v: F.abs(c / v - 1) < NEAR), "mayer_low": c < F.col("m200"), "mayer_high": c > 2.4 * F.col("m200"),
        "picycle_w90": days.after_event(F.col("e_pi"), 90), "near_200wma": c <= 1.05 * F.col("m1400"), "deadcat_w20": days.after_event(F.col("e_cat"), 20, False), "engulf_w5": days.after_event(F.col("e_engulf"), 5, False),
    }
    return df.select(*keys, "day", "_rn", *(F.coalesce(flag[k], F.lit(False)).alias(k) for k in (*TECHNICAL, *AFTER)))


def daily_flags(bars: DataFrame, levels: DataFrame, keys: Sequence[str] = ("symbol",), events: DataFrame | None = None) -> DataFrame:
    """(keys, day, flags...): the technical flags of the day before, those of AFTER and of the calendar on their day.

    ``events`` (day) names the days of an outside calendar; its flag is ``event_w``.
    """
    keys = list(keys)
    f = Frames(keys)
    t = technical(bars, levels, keys)
    out = t.select(*keys, "day", *(F.coalesce(f.lag(k), F.lit(False)).alias(k) for k in TECHNICAL), *AFTER)
    out = out.select("*", *(v.alias(k) for k, v in calendar_flags(F.date_from_unix_date(F.col("day").cast("int"))).items()))
    return out if events is None else joins.lookup(out, events.select("day").distinct().withColumn("event_w", F.lit(True)), ["day"], "event_w")


def calendar_flags(d: Column) -> dict[str, Column]:
    month, day, dow = F.month(d), F.dayofmonth(d), F.weekday(d)
    since = F.lit(None).cast("int")
    for h in HALVINGS:
        since = F.when(d >= F.lit(h).cast("date"), F.datediff(d, F.lit(h).cast("date"))).otherwise(since)
    phase = F.pmod(F.unix_date(d).cast("double") + 0.5 - NEW_MOON, F.lit(SYNODIC))
    nxt = F.date_add(d, 1)
    nm, nd, nw = F.month(nxt), F.dayofmonth(nxt), F.weekday(nxt)
    fixed = ((nm == 7) & (nd == 4)) | ((nm == 12) & (nd == 25)) | ((nm == 1) & (nd == 1))
    moving = ((nm == 11) & (nw == 3) & nd.between(22, 28)) | ((nm == 5) & (nw == 0) & (nd >= 25)) | ((nm == 9) & (nw == 0) & (nd <= 7))
    out = {
        "nov_apr": (month >= 11) | (month <= 4), "january": month == 1, "october": month == 10, "september": month == 9, "monday": dow == 0, "weekend": dow >= 5, "turn_of_month": (day >= 28) | (day <= 2),
        "santa": ((month == 12) & (day >= 27)) | ((month == 1) & (day <= 2)), "opex_friday": (dow == 4) & (F.month(F.date_add(d, 7)) != month), "pre_holiday": (fixed | moving) & F.year(nxt).between(*HOLIDAY_YEARS),
        "new_moon_pm3": (phase <= 3) | (phase >= LATE), "full_moon_pm3": F.abs(phase - FULL) <= 3,
    }
    return out | {f"halving_yr{k + 1}": F.coalesce((since >= 365 * k) & (since < 365 * (k + 1)), F.lit(False)) for k in range(4)}


CALENDAR = ["nov_apr", "january", "october", "september", "monday", "weekend", "turn_of_month", "santa", "opex_friday", "pre_holiday", "new_moon_pm3", "full_moon_pm3", "halving_yr1", "halving_yr2", "halving_yr3", "halving_yr4"]


def unpivoted(flags: DataFrame, keys: Sequence[str] = ("symbol", "day")) -> DataFrame:
    names = [c for c in flags.columns if c not in keys]
    return flags.unpivot(list(keys), names, "flag", "is_on")


def session_of_day(ms: Column) -> Column:
    """US for 13 to 21 h UTC, Asia for 0 to 8 h, else other."""
    h = F.hour(F.timestamp_millis(ms))
    return F.when((h >= 13) & (h < 21), "us").when(h < 8, "asia").otherwise("other")

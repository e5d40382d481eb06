"""Equity, months, portfolios and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import grids, learn
from tidemill.operators import metrics as mt
from tidemill.operators.windows import Frames, latest_version
from tidemill.plans.registry import CORE
from tidemill.plans.series import D, daily, r
from tidemill.session import table

#: Closed positions, each delivery once, and their balances as an equity series of closes.
P = "p AS (SELECT DISTINCT pos_id, sim_id, v, open_ts, exit_ts, entry, qty, pnl, balance, reason, lev, risk FROM positions WHERE exit_ts IS NOT NULL), eq AS (SELECT sim_id, v, exit_ts, pos_id, balance, exit_ts * 1000000 + pos_id % 1000000 AS k FROM p)"
M = "mb AS (SELECT sim_id, v, year(make_timestamp(exit_ts * 1000)) * 12 + month(make_timestamp(exit_ts * 1000)) - 1 AS month, arg_max(balance, k) AS bal FROM eq GROUP BY ALL)"
CAL = f"{P}, {M}, cal AS (SELECT sim_id, v, unnest(generate_series(min(month), max(month))) AS month FROM mb GROUP BY sim_id, v), mm AS (SELECT cal.sim_id, cal.v, cal.month, last_value(bal IGNORE NULLS) OVER w AS bal FROM cal LEFT JOIN mb USING (sim_id, v, month) WINDOW w AS (PARTITION BY cal.sim_id, cal.v ORDER BY cal.month)), mr AS (SELECT *, bal / nullif(lag(bal) OVER (PARTITION BY sim_id, v ORDER BY month), 0) - 1 AS ret FROM mm)"
RUN = ["sim_id", "v"]


def closed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "positions").where("exit_ts IS NOT NULL").select("pos_id", "sim_id", "v", "open_ts", "exit_ts", "entry", "qty", "pnl", "balance", "reason", "lev", "risk").distinct()
    return p.withColumn("k", F.col("exit_ts") * 1_000_000 + F.col("pos_id") % 1_000_000)


def run_months(spark: SparkSession, sf: str) -> DataFrame:
    # the key orders the closes of one instant; its month is that of the exit
    eq = closed(spark, sf)
    by = eq.withColumn("month", mt.month_number(F.col("exit_ts"))).groupBy(*RUN, "month").agg(F.max_by("balance", "k").alias("bal"), F.max("exit_ts").alias("exit_ts"))
    return mt.monthly(by, RUN, "exit_ts", "bal")


@CORE.query("max_drawdown", f"WITH {P}, q AS (SELECT sim_id, v, balance, max(balance) OVER (PARTITION BY sim_id, v ORDER BY k) AS pk FROM eq) SELECT sim_id, v, round(max(1 - balance / pk) * 100, 6) AS dd_first, round(max(1 - balance / greatest(pk, 1000)) * 100, 6) AS dd_base FROM q GROUP BY ALL")
def max_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    eq = closed(spark, sf)
    chunk = 90 * 86_400_000 * 1_000_000  # a quarter, in the units of k
    a, b = mt.drawdown(eq, RUN, "k", "balance", chunk=chunk), mt.drawdown(eq, RUN, "k", "balance", 1000.0, chunk)
    return a.select(*RUN, r("max_dd").alias("dd_first")).join(b.select(*RUN, r("max_dd").alias("dd_base")), RUN)


@CORE.query("monthly_green", f"WITH {CAL} SELECT sim_id, v, round(avg((ret > 0)::INT) * 100, 6) AS green, count(*) AS months FROM mr WHERE ret IS NOT NULL GROUP BY ALL")
def monthly_green(spark: SparkSession, sf: str) -> DataFrame:
    return mt.green_share(run_months(spark, sf), RUN).withColumn("green", r("green"))


@CORE.query("green_of_active_months", f"WITH {P}, {M}, mr AS (SELECT *, bal / nullif(lag(bal) OVER (PARTITION BY sim_id, v ORDER BY month), 0) - 1 AS ret FROM mb) SELECT sim_id, v, round(avg((ret > 0)::INT) * 100, 6) AS green, count(*) AS months FROM mr WHERE ret IS NOT NULL GROUP BY ALL")
def green_of_active_months(spark: SparkSession, sf: str) -> DataFrame:
    eq = closed(spark, sf).withColumn("month0", mt.month_number(F.col("exit_ts"))).groupBy(*RUN, "month0").agg(F.max_by("balance", "k").alias("balance"), F.max("exit_ts").alias("exit_ts"))
    return mt.green_share(mt.months_with_close(eq, RUN, "exit_ts", "balance"), RUN).withColumn("green", r("green"))


@CORE.query("months_from_base", f"WITH {CAL}, b AS (SELECT sim_id, v, month, bal / nullif(coalesce(lag(bal) OVER (PARTITION BY sim_id, v ORDER BY month), 1000), 0) - 1 AS ret FROM mm) SELECT sim_id, v, month, round(ret, 6) + 0.0 AS ret FROM b")
def months_from_base(spark: SparkSession, sf: str) -> DataFrame:
    by = closed(spark, sf).withColumn("m0", mt.month_number(F.col("exit_ts"))).groupBy(*RUN, "m0").agg(F.max_by("balance", "k").alias("bal"), F.max("exit_ts").alias("exit_ts"))
    return mt.monthly(by, RUN, "exit_ts", "bal", "base", 1000.0).select(*RUN, "month", (r("ret") + 0.0).alias("ret"))


@CORE.query("months_flat_start", f"WITH {P}, {M}, cal AS (SELECT sim_id, v, unnest(generate_series((SELECT min(month) FROM mb), (SELECT max(month) FROM mb))) AS month FROM (SELECT DISTINCT sim_id, v FROM mb)), j AS (SELECT cal.*, mb.bal AS b FROM cal LEFT JOIN mb USING (sim_id, v, month)), f AS (SELECT sim_id, v, month, coalesce(last_value(b IGNORE NULLS) OVER w, first_value(b IGNORE NULLS) OVER (PARTITION BY sim_id, v ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bal FROM j WINDOW w AS (PARTITION BY sim_id, v ORDER BY month)) SELECT sim_id, v, month, round(bal / nullif(lag(bal) OVER (PARTITION BY sim_id, v ORDER BY month), 0) - 1, 6) + 0.0 AS ret FROM f")
def months_flat_start(spark: SparkSession, sf: str) -> DataFrame:
    by = closed(spark, sf).withColumn("m0", mt.month_number(F.col("exit_ts"))).groupBy(*RUN, "m0").agg(F.max_by("balance", "k").alias("bal"), F.max("exit_ts").alias("exit_ts"))
    ends = by.agg(F.min("m0").alias("lo"), F.max("m0").alias("hi")).first()
    span = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    return mt.monthly(by, RUN, "exit_ts", "bal", "flat", span=span).select(*RUN, "month", (r("ret") + 0.0).alias("ret"))


@CORE.query("yearly_returns", f"WITH {CAL} SELECT sim_id, v, month // 12 AS year, round(product(1 + ret) - 1, 6) + 0.0 AS ret FROM mr WHERE ret IS NOT NULL GROUP BY ALL")
def yearly_returns(spark: SparkSession, sf: str) -> DataFrame:
    return mt.yearly(run_months(spark, sf), RUN).withColumn("ret", r("ret") + 0.0)


# Portfolios of the daily series, by calendar month.
S = f"""{D}, sm AS (SELECT symbol, year(make_timestamp(ts_ms * 1000)) * 12 + month(make_timestamp(ts_ms * 1000)) - 1 AS month, arg_max(c, ts_ms) AS bal FROM d GROUP BY ALL), sc AS (SELECT symbol, unnest(generate_series(min(month), max(month))) AS month FROM sm GROUP BY symbol),
    sf AS (SELECT sc.symbol, sc.month, last_value(bal IGNORE NULLS) OVER (PARTITION BY sc.symbol ORDER BY sc.month) AS bal FROM sc LEFT JOIN sm USING (symbol, month)), sr AS (SELECT symbol, month, bal / nullif(lag(bal) OVER (PARTITION BY symbol ORDER BY month), 0) - 1 AS ret FROM sf), rr AS (SELECT * FROM sr WHERE ret IS NOT NULL), fi AS (SELECT symbol, min(month) AS f FROM rr GROUP BY symbol)"""


def symbol_months(spark: SparkSession, sf: str) -> DataFrame:
    return mt.monthly(daily(spark, sf), ["symbol"], "ts_ms", "c")


YEARS = [f"y{k}" for k in range(2018, 2027)]


@CORE.query("portfolio_equal_weight", f"""WITH m AS (SELECT * FROM config_year_matrix QUALIFY row_number() OVER (PARTITION BY cfg ORDER BY run_ts DESC, port_DD) = 1), u AS (SELECT campaign, cfg, substr(year, 2)::BIGINT AS month, ret FROM (UNPIVOT m ON {', '.join(YEARS)} INTO NAME year VALUE ret))
    SELECT campaign, month, round(avg(ret), 6) + 0.0 AS ret, count(*) AS n FROM u GROUP BY campaign, month HAVING count(*) = (SELECT count(*) FROM m WHERE m.campaign = u.campaign)""")
def portfolio_equal_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations of a campaign in equal parts, in the years that all of them have."""
    m = latest_version(table(spark, sf, "config_year_matrix"), ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    u = m.unpivot(["campaign", "cfg"], YEARS, "year", "ret").select("campaign", "cfg", F.substring("year", 2, 4).cast("bigint").alias("month"), "ret")
    return mt.equal_weight(u, "cfg", "all", by=["campaign"]).select("campaign", "month", (r("ret") + 0.0).alias("ret"), "n")


@CORE.query("portfolio_any", f"WITH {S} SELECT month, round(avg(ret), 6) + 0.0 AS ret, count(*) AS n FROM rr GROUP BY month")
def portfolio_any(spark: SparkSession, sf: str) -> DataFrame:
    return mt.equal_weight(symbol_months(spark, sf), "symbol", "any").select("month", (r("ret") + 0.0).alias("ret"), "n")


@CORE.query("portfolio_live_only", f"WITH {S} SELECT month, round(avg(ret), 6) + 0.0 AS ret, count(*) AS n FROM rr WHERE month > (SELECT max(f) FROM fi) GROUP BY month")
def portfolio_live_only(spark: SparkSession, sf: str) -> DataFrame:
    return mt.equal_weight(symbol_months(spark, sf), "symbol", "live").select("month", (r("ret") + 0.0).alias("ret"), "n")


@CORE.query("inverse_vol", f"WITH {S}, s AS (SELECT symbol, 1 / nullif(stddev_samp(ret), 0) AS w FROM rr GROUP BY symbol) SELECT symbol, round(w / sum(w) OVER (), 6) AS weight FROM s")
def inverse_vol(spark: SparkSession, sf: str) -> DataFrame:
    return mt.inverse_volatility(symbol_months(spark, sf).where("ret IS NOT NULL"), "symbol", "ret").withColumn("weight", r("weight"))


LEVELS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


@CORE.query("leverage_budget", f"""WITH {S}, l AS (SELECT symbol, month, lv, greatest(lv * ret, -0.999) AS x FROM rr, (SELECT unnest({LEVELS})::DOUBLE AS lv)), e AS (SELECT symbol, month, lv, product(1 + x) OVER (PARTITION BY symbol, lv ORDER BY month) AS eq FROM l), p AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, lv ORDER BY month)) AS pk FROM e), dd AS (SELECT symbol, lv, max(1 - eq / pk) * 100 AS dd FROM p GROUP BY ALL)
    SELECT symbol, max(lv) AS leverage, round(arg_max(dd, lv), 6) + 0.0 AS max_dd FROM dd WHERE dd <= 30 GROUP BY symbol""")
def leverage_budget(spark: SparkSession, sf: str) -> DataFrame:
    return mt.leverage_budget(symbol_months(spark, sf).where("ret IS NOT NULL"), ["symbol"], "month", "ret", 30.0, LEVELS).withColumn("max_dd", r("max_dd") + 0.0)


@CORE.query("scores", """WITH g AS (SELECT DISTINCT cfg, port_growth AS g, port_DD AS dd, port_posMo AS p FROM config_year_matrix WHERE isfinite(port_growth) AND port_growth > 0)
    SELECT cfg, g, dd, p, round(CASE WHEN dd > 1e-9 THEN (g - 1) * 100 / dd END, 6) + 0.0 AS ret_dd, round(CASE WHEN dd > 1e-9 THEN (g - 1) * 100 / dd * (0.5 + 0.5 * p / 100) END, 9) + 0.0 AS objective, round(power(g, 12 / 60.0::DOUBLE) - 1, 6) + 0.0 AS cagr, round((power(g, 12 / 60.0::DOUBLE) - 1) * exp(-0.02 * dd), 6) + 0.0 AS cagr_score,
    round(ln(g) / greatest(dd, 5) * 100 + p, 6) AS log_score, round(p - 1.4 * dd + 6 * ln(1 + greatest(g - 1, -0.999999)), 6) + 0.0 AS ensemble FROM g""")
def scores(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "config_year_matrix").where("NOT isnan(port_growth) AND port_growth > 0 AND port_growth < double('infinity')").select("cfg", F.col("port_growth").alias("g"), F.col("port_DD").alias("dd"), F.col("port_posMo").alias("p")).distinct()
    gr, dd, p, n = F.col("g"), F.col("dd"), F.col("p"), F.lit(60.0)
    return g.select("cfg", "g", "dd", "p", (r(mt.return_over_drawdown(gr, dd)) + 0.0).alias("ret_dd"), (r(mt.train_objective(gr, dd, p), 9) + 0.0).alias("objective"), (r(mt.cagr(gr, n)) + 0.0).alias("cagr"), (r(mt.cagr_score(gr, n, dd)) + 0.0).alias("cagr_score"), r(mt.log_growth_score(gr, dd, p, n)).alias("log_score"), (r(mt.ensemble_score(gr, dd, p)) + 0.0).alias("ensemble"))


@CORE.query("concentration", f"WITH {S}, y AS (SELECT symbol, month // 12 AS y, product(1 + ret) AS g FROM rr GROUP BY ALL), x AS (SELECT symbol, CASE WHEN g > 1 THEN ln(g) END AS x FROM y) SELECT symbol, round(max(x) / sum(x), 6) AS concentration FROM x GROUP BY symbol")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    return mt.concentration(mt.yearly(symbol_months(spark, sf), ["symbol"]), ["symbol"]).withColumn("concentration", r("concentration"))


@CORE.query("pairwise_corr", f"WITH {D}, q AS (SELECT symbol, day, c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM d) SELECT a.symbol AS a, b.symbol AS b, count(a.x + b.x) AS n, round(corr(a.x, b.x), 5) + 0.0 AS corr FROM q a JOIN q b ON a.day = b.day AND a.symbol < b.symbol GROUP BY ALL HAVING count(a.x + b.x) >= 30")
def pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    x = daily(spark, sf).withColumn("x", Frames(["symbol"], "day").change("c"))
    return mt.pairwise_corr(x, "symbol", "day", "x", 30).withColumn("corr", r("corr", 5) + 0.0)


@CORE.query("benchmark_rebased", f"WITH {D}, cal AS (SELECT symbol, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY symbol), f AS (SELECT cal.symbol, cal.day, last_value(d.c IGNORE NULLS) OVER (PARTITION BY cal.symbol ORDER BY cal.day) AS c FROM cal LEFT JOIN d USING (symbol, day)) SELECT symbol, day, c, round(10000 * c / first_value(c) OVER (PARTITION BY symbol ORDER BY day), 4) AS value FROM f")
def benchmark_rebased(spark: SparkSession, sf: str) -> DataFrame:
    return mt.rebased(daily(spark, sf), ["symbol"], "day", "c").withColumn("value", r("value", 4))


@CORE.query("trade_factors", f"WITH {P} SELECT sim_id, v, count(*) AS n, round(sum(CASE WHEN balance - pnl <= 1e-9 THEN 0 ELSE balance / (balance - pnl) END) / count(*), 6) AS mean_factor, round(sum(lev * qty * entry) / sum(qty * entry), 6) AS avg_lev, coalesce(count_if(risk > 0 AND pnl / risk > 5), 0)::BIGINT AS gt5r, round(avg((reason = 'SL')::INT), 6) AS stop_share FROM p GROUP BY ALL")
def trade_factors(spark: SparkSession, sf: str) -> DataFrame:
    p = mt.trade_factors(closed(spark, sf))
    notional = F.col("qty") * F.col("entry")
    return p.groupBy(*RUN).agg(F.count("*").alias("n"), r(F.avg("factor")).alias("mean_factor"), r(F.try_divide(F.sum(F.col("lev") * notional), F.sum(notional))).alias("avg_lev"), F.count_if((F.col("risk") > 0) & (F.try_divide("pnl", "risk") > 5)).alias("gt5r"), r(F.avg((F.col("reason") == "SL").cast("double"))).alias("stop_share"))


@CORE.query("skip_threshold", f"WITH {P}, q AS (SELECT sim_id, v, k, CASE WHEN lev > 2 THEN 0 ELSE pnl / 1000 END AS x FROM p JOIN eq USING (sim_id, v, pos_id)) SELECT sim_id, v, round(sum(x), 6) + 0.0 AS total, count_if(x <> 0)::BIGINT AS taken FROM q GROUP BY ALL")
def skip_threshold(spark: SparkSession, sf: str) -> DataFrame:
    x = mt.skip_above(F.col("lev"), F.lit(2.0), F.col("pnl") / 1000)
    return closed(spark, sf).withColumn("x", x).groupBy(*RUN).agg((r(F.sum("x")) + 0.0).alias("total"), F.count_if(F.col("x") != 0).alias("taken"))


@CORE.query("vol_target", f"""WITH {D}, q AS (SELECT symbol, day, c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM d), a AS (SELECT symbol, day, CASE WHEN count(x) OVER w = 20 THEN stddev_samp(x) OVER w * sqrt(365) END AS vol FROM q WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    t AS (SELECT symbol, day, vol, CASE WHEN count(vol) OVER p >= 40 THEN quantile_cont(vol, 0.5) OVER p END AS target FROM a WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT symbol, day, round(CASE WHEN target / nullif(vol, 0) IS NOT NULL THEN least(greatest(target / vol, 0.5), 2) END, 6) AS leverage FROM t""")
def vol_target(spark: SparkSession, sf: str) -> DataFrame:
    x = daily(spark, sf).withColumn("x", Frames(["symbol"], "day").change("c"))
    return mt.vol_target_leverage(x, ["symbol"], "day", "x", 20, least=40).select("symbol", "day", r("leverage").alias("leverage"))


@CORE.query("vol_target_static", f"""WITH {D}, q AS (SELECT symbol, day, c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM d), a AS (SELECT symbol, day, CASE WHEN count(x) OVER w = 20 THEN stddev_samp(x) OVER w * sqrt(365) END AS vol FROM q WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    t AS (SELECT symbol, day, vol, CASE WHEN count(vol) OVER p >= 40 THEN quantile_cont(vol, 0.5) OVER p END AS target FROM a WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), l AS (SELECT symbol, day, CASE WHEN target / nullif(vol, 0) IS NOT NULL THEN least(greatest(target / vol, 0.5), 2) END AS x FROM t),
    m AS (SELECT symbol, day, x * 1.5 / avg(x) OVER (PARTITION BY symbol ORDER BY day) AS y FROM l) SELECT symbol, day, round(CASE WHEN y IS NOT NULL THEN least(greatest(y, 0.5), 2) END, 6) AS leverage FROM m""")
def vol_target_static(spark: SparkSession, sf: str) -> DataFrame:
    """The same, brought to a mean of one and a half."""
    x = daily(spark, sf).withColumn("x", Frames(["symbol"], "day").change("c"))
    return mt.vol_target_leverage(x, ["symbol"], "day", "x", 20, least=40, static=1.5).select("symbol", "day", r("leverage").alias("leverage"))


@CORE.query("portfolio_least", f"""WITH m AS (SELECT * FROM config_year_matrix QUALIFY row_number() OVER (PARTITION BY cfg ORDER BY run_ts DESC, port_DD) = 1), u AS (SELECT campaign, W, cfg, substr(year, 2)::BIGINT AS month, ret FROM (UNPIVOT m ON {', '.join(YEARS)} INTO NAME year VALUE ret)), s AS (SELECT campaign, W, count(DISTINCT cfg) AS members FROM u GROUP BY ALL),
    f AS (SELECT campaign, W, month, avg(ret) AS ret, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT f.*, count(*) OVER (PARTITION BY campaign, W) AS months FROM f JOIN s USING (campaign, W) WHERE f.n = s.members) SELECT campaign, W, month, round(ret, 9) + 0.0 AS ret, n FROM k WHERE months >= 6""")
def portfolio_least(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of configurations in equal parts, in the years that all have, where these are six or more."""
    m = latest_version(table(spark, sf, "config_year_matrix"), ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    u = m.unpivot(["campaign", "W", "cfg"], YEARS, "year", "ret").select("campaign", "W", "cfg", F.substring("year", 2, 4).cast("bigint").alias("month"), "ret")
    return mt.equal_weight(u, "cfg", "all", 6, by=["campaign", "W"]).select("campaign", "W", "month", (r("ret", 9) + 0.0).alias("ret"), "n")


@CORE.query("lockbox_split", f"WITH {P} SELECT sim_id, v, CASE WHEN exit_ts < 1609459200000 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(pnl), 4) + 0.0 AS pnl FROM p GROUP BY ALL")
def lockbox_split(spark: SparkSession, sf: str) -> DataFrame:
    """Closes before and from 2021 on."""
    return grids.lockbox(closed(spark, sf), "exit_ts", 1_609_459_200_000).groupBy(*RUN, "part").agg(F.count("*").alias("n"), (r(F.sum("pnl"), 4) + 0.0).alias("pnl"))


@CORE.query("next_target", f"WITH {D}, q AS (SELECT symbol, day, c / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM d) SELECT symbol, day, (lead(x) OVER (PARTITION BY symbol ORDER BY day) > 0)::INT::DOUBLE AS target FROM q")
def next_target(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the next day rises; nothing for the last."""
    x = daily(spark, sf).withColumn("x", Frames(["symbol"], "day").change("c"))
    return learn.next_period_target(x, ["symbol"], "day", "x").select("symbol", "day", "target")

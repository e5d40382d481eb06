"""Baskets, ensembles and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import ensembles as en
from tidemill.operators import metrics as mt
from tidemill.operators.windows import latest_version
from tidemill.plans.metric_queries import CAL, RUN, YEARS, S, closed, run_months, symbol_months
from tidemill.plans.registry import CORE
from tidemill.plans.series import r
from tidemill.session import table

#: The years before count as train months, each year as one.
SPLIT, LEAST = 2023 * 12, 4


def _stats_sql(src: str, dst: str) -> str:
    return f"""{dst}e AS (SELECT *, product(1 + ret) OVER w AS eq, min(month) OVER (PARTITION BY m) AS first FROM {src} WINDOW w AS (PARTITION BY m ORDER BY month)), {dst}f AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY m ORDER BY month) AS fall FROM {dst}e),
    {dst}y AS (SELECT m, month // 12 AS y, product(1 + ret) AS g FROM {dst}e WHERE month > first GROUP BY ALL), {dst}c AS (SELECT m, max(CASE WHEN g > 1 THEN ln(g) END) / sum(CASE WHEN g > 1 THEN ln(g) END) AS conc FROM {dst}y GROUP BY m),
    {dst}s AS (SELECT m, arg_max(eq, month) AS growth, max(fall) * 100 AS dd, avg((ret > 0)::INT) * 100 AS pos, any_value(conc) AS conc FROM {dst}f LEFT JOIN {dst}c USING (m) GROUP BY m)"""


def _greedy_sql(kmax: int) -> str:
    parts = [S, "ms AS (SELECT DISTINCT symbol AS m FROM rr), mo AS (SELECT DISTINCT month FROM rr), fl AS (SELECT ms.m, mo.month, coalesce(rr.ret, 0) AS ret FROM ms CROSS JOIN mo LEFT JOIN rr ON rr.symbol = ms.m AND rr.month = mo.month)", _stats_sql("fl", "g1"), "b1 AS (SELECT 1 AS k, *, [m] AS held FROM g1s ORDER BY round(growth / greatest(dd, 1), 9) DESC, m LIMIT 1)"]
    for k in range(2, kmax + 1):
        parts += [f"h{k} AS (SELECT month, sum(ret) AS s FROM fl, b{k - 1} WHERE list_contains(b{k - 1}.held, fl.m) GROUP BY month), q{k} AS (SELECT fl.m, fl.month, (fl.ret + h{k}.s) / {k} AS ret FROM fl JOIN h{k} USING (month), b{k - 1} WHERE NOT list_contains(b{k - 1}.held, fl.m))", _stats_sql(f"q{k}", f"g{k}"), f"b{k} AS (SELECT {k} AS k, g{k}s.*, list_append((SELECT held FROM b{k - 1}), m) AS held FROM g{k}s ORDER BY round(pos - 50 * coalesce(conc, 1) - 0.3 * dd, 9) DESC, m LIMIT 1)"]
    return "WITH " + ", ".join(parts) + " SELECT k, added, round(growth, 6) AS growth, round(dd, 6) + 0.0 AS dd, round(pos, 6) AS pos_months, round(conc, 6) AS concentration FROM (" + " UNION ALL ".join(f"SELECT k, m AS added, growth, dd, pos, conc FROM b{k}" for k in range(1, kmax + 1)) + ")"


@CORE.query("greedy_basket", _greedy_sql(4))
def greedy_basket(spark: SparkSession, sf: str) -> DataFrame:
    """Four series chosen one after another, each for what it does to the basket."""
    b = en.greedy_basket(symbol_months(spark, sf).where("ret IS NOT NULL"), "symbol", 4)
    return b.select("k", "added", *((r(x) + 0.0).alias(x) for x in ("growth", "dd", "pos_months", "concentration")))


_MEASURE = lambda src, dst, cond: f"{dst}e AS (SELECT *, product(1 + ret) OVER (PARTITION BY m ORDER BY month) AS eq FROM {src} WHERE {cond} AND ret IS NOT NULL), {dst}f AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY m ORDER BY month) AS fall FROM {dst}e), {dst} AS (SELECT m, avg((ret > 0)::INT) * 100 AS green, arg_max(eq, month) AS growth, max(fall) * 100 AS dd FROM {dst}f GROUP BY m HAVING count(*) >= {LEAST})"
_OBJECTIVE = "green - 1.4 * dd + 6 * ln(1 + greatest(growth - 1, 0))"


@CORE.query(
    "exhaustive_ensembles",
    f"""WITH lm AS (SELECT * FROM config_year_matrix QUALIFY row_number() OVER (PARTITION BY cfg ORDER BY run_ts DESC, port_DD) = 1), one AS (SELECT cfg AS m, substr(year, 2)::BIGINT * 12 AS month, ret FROM (UNPIVOT lm ON {', '.join(YEARS)} INTO NAME year VALUE ret)),
    {_MEASURE('one', 't1', f'month < {SPLIT}')}, pool AS (SELECT m FROM t1 ORDER BY round({_OBJECTIVE}, 9) DESC, m LIMIT 8),
    sets AS (SELECT list_sort([a.m, b.m]) AS m FROM pool a JOIN pool b ON a.m < b.m UNION ALL SELECT list_sort([a.m, b.m, c.m]) FROM pool a JOIN pool b ON a.m < b.m JOIN pool c ON b.m < c.m),
    en AS (SELECT sets.m, one.month, avg(one.ret) AS ret FROM sets JOIN one ON list_contains(sets.m, one.m) GROUP BY ALL), {_MEASURE('en', 't2', f'month < {SPLIT}')}, {_MEASURE('en', 't3', f'month >= {SPLIT}')},
    top AS (SELECT *, {_OBJECTIVE} AS objective FROM t2 ORDER BY round({_OBJECTIVE}, 9) DESC, m LIMIT 40)
    SELECT array_to_string(top.m, '+') AS members, round(top.objective, 6) + 0.0 AS train_objective, round(t3.green, 6) AS green, round(t3.growth, 6) AS growth, round(t3.dd, 6) + 0.0 AS dd, round(t3.green - 1.4 * t3.dd, 6) + 0.0 AS score FROM top JOIN t3 ON top.m = t3.m""",
)
def exhaustive_ensembles(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs and triples of the eight best configurations: picked on the early years, ranked on the later ones."""
    m = latest_version(table(spark, sf, "config_year_matrix"), ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    u = m.unpivot(["cfg"], YEARS, "year", "ret").where("ret IS NOT NULL").select("cfg", (F.substring("year", 2, 4).cast("bigint") * 12).alias("month"), "ret")
    e = en.exhaustive_ensembles(u, "cfg", SPLIT, (2, 3), 8, 40, LEAST)
    return e.select(F.array_join("members", "+").alias("members"), *((r(x) + 0.0).alias(x) for x in ("train_objective", "green", "growth", "dd", "score")))


_LATEST = "m AS (SELECT * FROM config_year_matrix QUALIFY row_number() OVER (PARTITION BY cfg ORDER BY run_ts DESC, port_DD) = 1)"


@CORE.query(
    "balanced_ranking",
    f"WITH {_LATEST}, u AS (SELECT cfg, port_DD AS dd, port_posMo AS green, 1 + ret AS growth FROM (UNPIVOT m ON {', '.join(YEARS)} INTO NAME year VALUE ret)) SELECT cfg, round(min(ln(greatest(growth, 1e-9))), 9) AS least_log_growth, round(avg(green), 9) AS mean_green, max(dd) AS max_dd FROM u GROUP BY cfg HAVING bool_and(growth >= 0.5 AND dd <= 60 AND green >= 40) ORDER BY least_log_growth DESC, mean_green DESC, max_dd, cfg LIMIT 100",
)
def balanced_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations by their worst year, of those that keep the floors in all of them."""
    m = latest_version(table(spark, sf, "config_year_matrix"), ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    u = m.unpivot(["cfg", "port_DD", "port_posMo"], YEARS, "year", "ret").where("ret IS NOT NULL").select("cfg", (1 + F.col("ret")).alias("growth"), F.col("port_DD").alias("dd"), F.col("port_posMo").alias("green"))
    b = en.balanced_ranking(u, ["cfg"], 0.5, 60.0, 40.0)
    return b.select("cfg", F.round("least_log_growth", 9).alias("least_log_growth"), F.round("mean_green", 9).alias("mean_green"), "max_dd")


@CORE.query(
    "constrained_ranking",
    f"""WITH {CAL}, g AS (SELECT sim_id, v, arg_max(balance, k) / 1000 AS growth, count(*) AS n FROM eq GROUP BY ALL), ok AS (SELECT sim_id, exp(avg(ln(greatest(growth, 1e-9)))) AS proxy FROM g GROUP BY sim_id HAVING bool_and(growth > 0.2 AND n >= 2)), ca AS (SELECT * FROM ok ORDER BY round(proxy, 9) DESC, sim_id LIMIT 50),
    b AS (SELECT mb.* FROM mb JOIN ca USING (sim_id)), fi AS (SELECT v, sim_id, min(month) AS f FROM b GROUP BY ALL), sp AS (SELECT sim_id, min(month) AS lo, max(month) AS hi FROM b GROUP BY sim_id), lv AS (SELECT sim_id, max(f) AS live FROM fi GROUP BY sim_id),
    fc AS (SELECT fi.v, fi.sim_id, unnest(generate_series(sp.lo, sp.hi)) AS month FROM fi JOIN sp USING (sim_id)), ff AS (SELECT fc.*, coalesce(last_value(b.bal IGNORE NULLS) OVER (PARTITION BY fc.v, fc.sim_id ORDER BY fc.month), 1000) AS bal FROM fc LEFT JOIN b ON b.v = fc.v AND b.sim_id = fc.sim_id AND b.month = fc.month),
    fr AS (SELECT sim_id, month, bal / nullif(lag(bal) OVER (PARTITION BY v, sim_id ORDER BY month), 0) - 1 AS x FROM ff), po AS (SELECT sim_id, month, avg(x) AS ret FROM fr GROUP BY ALL), pl AS (SELECT po.* FROM po JOIN lv USING (sim_id) WHERE month > live AND ret IS NOT NULL),
    pe AS (SELECT *, product(1 + ret) OVER (PARTITION BY sim_id ORDER BY month) AS eq FROM pl), pd AS (SELECT *, 1 - eq / greatest(1, max(eq) OVER (PARTITION BY sim_id ORDER BY month)) AS fall FROM pe)
    SELECT sim_id, round(any_value(proxy), 6) AS proxy, round(avg((ret > 0)::INT) * 100, 6) AS pos_months, round(min(ret) * 100, 6) + 0.0 AS worst, round(arg_max(eq, month), 6) AS growth, round(max(fall) * 100, 6) + 0.0 AS dd FROM pd JOIN ca USING (sim_id) GROUP BY sim_id HAVING pos_months >= 30""",
)
def constrained_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Simulations over their variations: constraints on every run, then the portfolio of the runs."""
    eq = closed(spark, sf)
    scalars = eq.groupBy(*RUN).agg((F.max_by("balance", "k") / 1000).alias("growth"), F.count("*").alias("n"))
    months = eq.withColumn("month", mt.month_number(F.col("exit_ts"))).groupBy(*RUN, "month").agg(F.max_by("balance", "k").alias("bal"))
    c = en.constrained_ranking(scalars, months, "sim_id", "v", (F.col("growth") > 0.2) & (F.col("n") >= 2), 50, 30.0, 1000.0)
    return c.select("sim_id", r("proxy").alias("proxy"), r("pos_months").alias("pos_months"), (r("worst") + 0.0).alias("worst"), r("growth").alias("growth"), (r("dd") + 0.0).alias("dd"))


@CORE.query(
    "top_portfolios",
    f"""WITH j AS (SELECT sim_id, idx AS v, symbol FROM jobs), {CAL}, g AS (SELECT v, max(bal) AS best FROM mm GROUP BY v ORDER BY best DESC, v LIMIT 5), l AS (SELECT mr.* FROM mr JOIN g USING (v) WHERE ret IS NOT NULL)
    SELECT v, month, round(avg(ret), 6) + 0.0 AS ret, count(*) AS n FROM l GROUP BY ALL""",
)
def top_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    """The five variations with the highest month-end balance, each as a portfolio of its runs."""
    m = run_months(spark, sf)
    best = m.groupBy("v").agg(F.max("bal").alias("best")).orderBy(F.col("best").desc(), "v").limit(5).select("v")
    return mt.equal_weight(m.join(F.broadcast(best), "v"), "sim_id", "any", by=["v"]).select("v", "month", (r("ret") + 0.0).alias("ret"), "n")


@CORE.query(
    "extreme_pairs",
    f"""WITH {_LATEST}, u AS (SELECT cfg, year, ret FROM (UNPIVOT (SELECT cfg, {', '.join(YEARS)} FROM m WHERE cfg IN (SELECT cfg FROM m ORDER BY port_DD, cfg LIMIT 40)) ON {', '.join(YEARS)} INTO NAME year VALUE ret)),
    c AS (SELECT a.cfg AS a, b.cfg AS b, count(*) AS n, corr(a.ret, b.ret) AS corr FROM u a JOIN u b ON a.year = b.year AND a.cfg < b.cfg GROUP BY ALL HAVING count(*) >= 4), k AS (SELECT * FROM c WHERE corr IS NOT NULL AND NOT isnan(corr))
    SELECT 'lowest' AS which, a, b, n, round(corr, 6) + 0.0 AS corr FROM (SELECT * FROM k ORDER BY round(corr, 9), a, b LIMIT 1) UNION ALL SELECT 'highest', a, b, n, round(corr, 6) + 0.0 FROM (SELECT * FROM k ORDER BY round(corr, 9) DESC, a, b LIMIT 1) UNION ALL SELECT 'mean', NULL, NULL, count(*), round(avg(corr), 6) + 0.0 FROM k""",
)
def extreme_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Of the forty configurations with the least drawdown, the pair whose years go together least, most, and the mean."""
    m = latest_version(table(spark, sf, "config_year_matrix"), ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    pool = m.orderBy("port_DD", "cfg").limit(40)
    u = pool.unpivot(["cfg"], YEARS, "year", "ret").where("ret IS NOT NULL")
    pairs = mt.pairwise_corr(u, "cfg", "year", "ret", 4).where("corr IS NOT NULL AND NOT isnan(corr)")
    return mt.extreme_pairs(pairs).select("which", "a", "b", "n", (r("corr") + 0.0).alias("corr"))

"""Statistics, parameter spaces and the fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import chain, fold, grids, stats
from tidemill.operators.aggregates import average_rank
from tidemill.operators.windows import Frames
from tidemill.plans.metric_queries import CAL, RUN, P, S, closed, run_months, symbol_months
from tidemill.plans.registry import CORE
from tidemill.plans.series import D, daily, numbered, r
from tidemill.session import table

#: Feature of the day and the return of the next: what the tests below relate.
FX = f"{D}, fx AS (SELECT symbol, day, rn, ts_ms, c, (h - l) / c AS x, c > o AS up, lead(c) OVER (PARTITION BY symbol ORDER BY day) / c - 1 AS y FROM n)"


def features(spark: SparkSession, sf: str) -> DataFrame:
    f = Frames(["symbol"], "day")
    return daily(spark, sf).select("symbol", "day", "ts_ms", "c", ((F.col("h") - F.col("l")) / F.col("c")).alias("x"), (F.col("c") > F.col("o")).alias("up"), (f.lead("c") / F.col("c") - 1).alias("y"))


def rank_sql(cte: str, src: str, by: str, x: str, name: str) -> str:
    return f"{cte} AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2 AS {name} FROM {src})"


@CORE.query("spearman", f"WITH {FX}, b AS (SELECT * FROM fx WHERE y IS NOT NULL), {rank_sql('r1', 'b', 'symbol', 'x', 'rx')}, {rank_sql('r2', 'r1', 'symbol', 'y', 'ry')} SELECT symbol, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM r2 GROUP BY symbol HAVING count(*) >= 3")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(features(spark, sf), ["symbol"], "x", "y").where("n >= 3").withColumn("rho", r("rho") + 0.0)


@CORE.query("spearman_p")
def spearman_p(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.spearman(features(spark, sf), ["symbol"], "x", "y").where("rho IS NOT NULL")
    return s.withColumn("p", stats.correlation_p("rho", F.col("n").cast("double")))


@CORE.query("cliffs_delta", f"WITH {FX}, b AS (SELECT * FROM fx WHERE y IS NOT NULL), {rank_sql('r1', 'b', 'symbol', 'y', 'ry')}, s AS (SELECT symbol, coalesce(count_if(up), 0)::BIGINT AS n1, coalesce(count_if(NOT up), 0)::BIGINT AS n0, sum(CASE WHEN up THEN ry END) AS s FROM r1 GROUP BY symbol) SELECT symbol, n1, n0, round(CASE WHEN n1 >= 8 AND n0 >= 8 THEN 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n0) - 1 END, 6) + 0.0 AS delta, round(CASE WHEN n1 >= 8 AND n0 >= 8 THEN (s - n1 * (n1 + 1) / 2) / (n1 * n0) END, 6) AS auc FROM s")
def cliffs_delta(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cliffs_delta(features(spark, sf), ["symbol"], "y", "up").withColumns({"delta": r("delta") + 0.0, "auc": r("auc")})


@CORE.query("bh_stepup", "WITH t AS (SELECT DISTINCT cfg, port_DD / 100 AS p FROM config_year_matrix), k AS (SELECT cfg, p, row_number() OVER (ORDER BY p, cfg)::INT AS rank, count(*) OVER () AS m FROM t) SELECT cfg, round(p, 6) AS p, rank, rank <= coalesce((SELECT max(rank) FROM k WHERE p <= 0.3 * rank / m), 0) AS passed, p <= 0.3 * rank / m AS per_rank FROM k")
def bh_stepup(spark: SparkSession, sf: str) -> DataFrame:
    """The configurations stand for the hypotheses."""
    t = table(spark, sf, "config_year_matrix").select("cfg", (F.col("port_DD") / 100).alias("p")).distinct()
    up = stats.benjamini_hochberg(t, "p", 0.3, key=["cfg"])
    each = stats.benjamini_hochberg(t, "p", 0.3, "per_rank", ["cfg"]).select("cfg", "p", F.col("passed").alias("per_rank"))
    return up.join(each, ["cfg", "p"]).select("cfg", r("p").alias("p"), "rank", "passed", "per_rank")


@CORE.query("circular_shift_p", f"""WITH {FX}, b AS (SELECT symbol, up, y, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM fx WHERE y IS NOT NULL), j AS (SELECT unnest(generate_series(0, 40)) AS j),
    m AS (SELECT f.symbol, j.j, f.n, avg(CASE WHEN f.up THEN o.y END) AS a, avg(CASE WHEN NOT f.up THEN o.y END) AS z, count_if(f.up) AS k FROM b f CROSS JOIN j JOIN b o ON o.symbol = f.symbol AND o.i = (f.i + f.n * j.j // 41) % f.n GROUP BY ALL),
    g AS (SELECT symbol, n, j, a - z AS d FROM m WHERE k >= 5 AND n - k >= 5), o AS (SELECT symbol, d AS obs FROM g WHERE j = 0)
    SELECT g.symbol, n, round(obs, 8) + 0.0 AS observed, coalesce(count_if(j > 0 AND abs(d) >= abs(obs) - 1e-12), 0)::INT AS beyond, coalesce(count_if(j > 0), 0)::INT AS got, round((count_if(j > 0 AND abs(d) >= abs(obs) - 1e-12) + 1) / (count_if(j > 0) + 1), 6) AS p FROM g JOIN o USING (symbol) GROUP BY ALL""")
def circular_shift_p(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shift_null(features(spark, sf), ["symbol"], "day", "up", "y", 40, 5).withColumns({"observed": r("observed", 8) + 0.0, "p": r("p")})


DRAW = "((b * 7919 + j * 104729 + b * j * 1299709 + (b * b % 1009) * 15485863) % n)"


@CORE.query("block_bootstrap_dd", f"""WITH {FX}, f AS (SELECT symbol, 1 + y AS f, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM fx WHERE y IS NOT NULL), p AS (SELECT symbol, n, b, unnest(generate_series(0, ceil(n / 10)::BIGINT - 1)) AS j FROM (SELECT DISTINCT symbol, n FROM f), (SELECT unnest(generate_series(0, 19)) AS b)),
    c AS (SELECT symbol, n, b, j * 10 + o AS t, {DRAW} + o AS i FROM p, (SELECT unnest(generate_series(0, 9)) AS o)), z AS (SELECT *, row_number() OVER (PARTITION BY symbol, b ORDER BY t) AS k FROM c WHERE i < n), e AS (SELECT z.symbol, z.b, z.t, product(f.f) OVER (PARTITION BY z.symbol, z.b ORDER BY t) AS eq FROM z JOIN f ON f.symbol = z.symbol AND f.i = z.i WHERE z.k <= z.n),
    k AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, b ORDER BY t)) AS pk FROM e) SELECT symbol, b::INT AS b, round(max(1 - eq / pk) * 100, 5) AS max_dd FROM k GROUP BY ALL""")
def block_bootstrap_dd(spark: SparkSession, sf: str) -> DataFrame:
    x = features(spark, sf).where("y IS NOT NULL").withColumn("f", 1 + F.col("y"))
    return stats.block_bootstrap_drawdown(x, ["symbol"], "day", "f", 10, 20).withColumn("max_dd", r("max_dd", 5))


_BOOT = lambda x, name: f"{name}p AS (SELECT symbol, n, b, unnest(generate_series(0, ceil(n / 10)::BIGINT - 1)) AS j FROM (SELECT DISTINCT symbol, n FROM f), (SELECT unnest(generate_series(0, 39)) AS b)), {name}c AS (SELECT symbol, n, b, j * 10 + o AS t, {DRAW} + o AS i FROM {name}p, (SELECT unnest(generate_series(0, 9)) AS o)), {name}z AS (SELECT *, row_number() OVER (PARTITION BY symbol, b ORDER BY t) AS k FROM {name}c WHERE i < n), {name}e AS (SELECT z.symbol, z.b, z.t, product(f.{x}) OVER (PARTITION BY z.symbol, z.b ORDER BY t) AS eq FROM {name}z z JOIN f ON f.symbol = z.symbol AND f.i = z.i WHERE z.k <= z.n), {name} AS (SELECT symbol, b, max(1 - eq / pk) * 100 AS dd FROM (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, b ORDER BY t)) AS pk FROM {name}e) GROUP BY ALL)"
_TRUE = lambda x, name: f"{name} AS (SELECT symbol, max(1 - eq / greatest(1, pk)) * 100 AS dd FROM (SELECT symbol, i, eq, max(eq) OVER (PARTITION BY symbol ORDER BY i) AS pk FROM (SELECT symbol, i, product({x}) OVER (PARTITION BY symbol ORDER BY i) AS eq FROM f)) GROUP BY symbol)"


@CORE.query("shuffle_gate", f"""WITH {FX}, f AS (SELECT symbol, 1 + y AS f, 1 + y / 2 AS g, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM fx WHERE y IS NOT NULL), {_BOOT('f', 'ba')}, {_BOOT('g', 'bi')}, {_TRUE('f', 'ta')}, {_TRUE('g', 'ti')},
    dq AS (SELECT symbol, quantile_cont(ba.dd - bi.dd, 0.5) AS q50, quantile_cont(ba.dd - bi.dd, 0.25) AS q25 FROM ba JOIN bi USING (symbol, b) GROUP BY symbol)
    SELECT symbol, round(ta.dd - ti.dd, 5) + 0.0 AS real, round(q50, 5) + 0.0 AS shuffled_median, round(q25, 5) + 0.0 AS shuffled_q25, round(ta.dd - ti.dd, 9) > 0 AND round(ta.dd - ti.dd, 9) > round(q50, 9) AND round(ta.dd - ti.dd, 9) > round(q25, 9) AS passed FROM ta JOIN ti USING (symbol) JOIN dq USING (symbol)""")
def shuffle_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Half the exposure against all of it: does it lower the drawdown by more than its size, in the true order?"""
    x = features(spark, sf).where("y IS NOT NULL").withColumns({"f": 1 + F.col("y"), "g": 1 + F.col("y") / 2})
    g = stats.shuffle_gate(x.select("symbol", "day", "f"), x.select("symbol", "day", F.col("g").alias("f")), ["symbol"], "day", "f", 10, 40)
    return g.select("symbol", *((r(c, 5) + 0.0).alias(c) for c in ("real", "shuffled_median", "shuffled_q25")), "passed")


@CORE.query("split_half_sign", f"WITH {FX}, b AS (SELECT *, (day % 2 = 0)::INT AS h FROM fx WHERE y IS NOT NULL), t AS (SELECT avg(CASE WHEN up THEN y END) - avg(CASE WHEN NOT up THEN y END) AS overall, avg(CASE WHEN up AND h = 0 THEN y END) - avg(CASE WHEN NOT up AND h = 0 THEN y END) AS first, avg(CASE WHEN up AND h = 1 THEN y END) - avg(CASE WHEN NOT up AND h = 1 THEN y END) AS second FROM b), e AS (SELECT symbol, avg(CASE WHEN up THEN y END) - avg(CASE WHEN NOT up THEN y END) AS d FROM b GROUP BY symbol HAVING count_if(up) >= 5 AND count_if(NOT up) >= 5) SELECT round(overall, 8) + 0.0 AS overall, sign(first) = sign(second) AS agree, (SELECT count(*) FROM e) AS series_n, (SELECT count(*) FROM e WHERE sign(d) = sign(overall)) AS series_same FROM t")
def split_half_sign(spark: SparkSession, sf: str) -> DataFrame:
    x = features(spark, sf).where("y IS NOT NULL").withColumn("all", F.lit(1))
    return stats.sign_agreement(x, ["all"], "symbol", (F.col("day") % 2 == 0).cast("int"), "up", "y").select((r("overall", 8) + 0.0).alias("overall"), "agree", "series_n", "series_same")


@CORE.query("lag_autocorr", f"WITH {FX}, p AS (SELECT symbol, lag, x, CASE lag WHEN 1 THEN lead(x, 1) OVER w WHEN 2 THEN lead(x, 2) OVER w WHEN 3 THEN lead(x, 3) OVER w WHEN 5 THEN lead(x, 5) OVER w WHEN 7 THEN lead(x, 7) OVER w WHEN 14 THEN lead(x, 14) OVER w END AS z FROM fx, (VALUES (1), (2), (3), (5), (7), (14)) l(lag) WINDOW w AS (PARTITION BY symbol, lag ORDER BY day)), b AS (SELECT * FROM p WHERE z IS NOT NULL), {rank_sql('r1', 'b', 'symbol, lag', 'x', 'rx')}, {rank_sql('r2', 'r1', 'symbol, lag', 'z', 'rz')} SELECT symbol, lag, count(*) AS n, round(corr(rx, rz), 6) + 0.0 AS rho FROM r2 GROUP BY ALL HAVING count(*) >= 3")
def lag_autocorr(spark: SparkSession, sf: str) -> DataFrame:
    return stats.lag_autocorrelation(features(spark, sf), ["symbol"], "day", "x", [1, 2, 3, 5, 7, 14]).where("n >= 3").withColumn("rho", r("rho") + 0.0)


@CORE.query("average_precision", f"WITH {FX}, c AS (SELECT symbol, round(x, 3) AS s, count(*) AS n, sum((y > 0)::INT) AS p FROM fx WHERE y IS NOT NULL GROUP BY ALL), k AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM c WINDOW w AS (PARTITION BY symbol ORDER BY s DESC)) SELECT symbol, round(sum(p * cp / cn) / nullif(sum(p), 0), 6) AS ap FROM k GROUP BY symbol")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    x = features(spark, sf).where("y IS NOT NULL").select("symbol", F.round("x", 3).alias("s"), (F.col("y") > 0).alias("label"))
    return stats.average_precision(x, ["symbol"], "s", "label").withColumn("ap", r("ap"))


@CORE.query("quintile_table", f"WITH {FX}, q AS (SELECT symbol, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q FROM fx WHERE y IS NOT NULL GROUP BY symbol), b AS (SELECT f.symbol, y, len(list_filter(q, lambda v: f.x > v))::INT AS bin FROM fx f JOIN q USING (symbol) WHERE y IS NOT NULL) SELECT bin, count(*) AS n, round(avg(y), 8) + 0.0 AS mean, round(exp(avg(ln(1 + y))) - 1, 8) + 0.0 AS geo FROM b GROUP BY bin")
def quintile_table(spark: SparkSession, sf: str) -> DataFrame:
    from tidemill.operators.aggregates import quantile_bins

    b = quantile_bins(features(spark, sf).where("y IS NOT NULL"), ["symbol"], "x")
    return b.groupBy("bin").agg(F.count("*").alias("n"), (r(F.avg("y"), 8) + 0.0).alias("mean"), (r(F.exp(F.avg(F.log(1 + F.col("y")))) - 1, 8) + 0.0).alias("geo"))


#: Lengths of the averages that are scanned.
SCAN = list(range(10, 1001, 10))


@CORE.query("ma_scan", f"""WITH {FX}, w AS (SELECT unnest({SCAN}) AS w), cs AS (SELECT symbol, day, rn, c, y, sum(c) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS s FROM fx), a AS (SELECT f.symbol, f.day, f.rn, w.w, f.y, CASE WHEN f.rn >= w.w - 1 THEN f.c > (f.s - coalesce(g.s, 0)) / w.w ELSE false END AS above FROM cs f CROSS JOIN w LEFT JOIN cs g ON g.symbol = f.symbol AND g.rn = f.rn - w.w),
    b AS (SELECT *, coalesce(lag(above) OVER p, false) AS state FROM a WINDOW p AS (PARTITION BY symbol, w ORDER BY rn)), k AS (SELECT *, state <> lag(state) OVER p AS crossed FROM b WINDOW p AS (PARTITION BY symbol, w ORDER BY rn)),
    x AS (SELECT *, coalesce(bool_or(crossed) OVER (PARTITION BY symbol, w ORDER BY rn ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), false) AS near FROM k),
    l AS (SELECT w, 'above' AS kind, state AS is_on, y FROM x WHERE y IS NOT NULL UNION ALL SELECT w, 'crossed', near, y FROM x WHERE y IS NOT NULL)
    SELECT w, kind, coalesce(count_if(is_on), 0)::BIGINT AS n_on, coalesce(count_if(NOT is_on), 0)::BIGINT AS n_off, CASE WHEN count_if(is_on) >= 100 AND count_if(NOT is_on) >= 100 THEN round(avg(CASE WHEN is_on THEN y END) - avg(CASE WHEN NOT is_on THEN y END), 8) + 0.0 END AS diff FROM l GROUP BY ALL""")
def ma_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Next-day return while the close of the day before was above its average, and within ten days of a crossing, against
    the other days, for a hundred lengths in one pass; a difference needs a hundred days on either side."""
    return stats.average_scan(features(spark, sf), ["symbol"], "day", "c", "y", SCAN).withColumn("diff", r("diff", 8) + 0.0)


# ---- grids and splits ------------------------------------------------------------------------------------------------

AXES = {"w": [500, 1000, 1500, 2000], "tpd": [0.05, 0.1, 0.2], "ntp": [3, 6, 9, 12, 15], "lev": [1.0, 2.0], "stop": [0.004, 0.008, 0.012]}


def _axis_sql() -> str:
    out, step = [], 1
    for k in reversed(list(AXES)):
        out.append(f"{AXES[k]}[(g // {step} % {len(AXES[k])} + 1)::INT]{'::DOUBLE' if isinstance(AXES[k][0], float) else '::INT'} AS {k}")
        step *= len(AXES[k])
    return ", ".join(reversed(out))


@CORE.query("grid_decode", f"SELECT g AS gidx, {_axis_sql()} FROM (SELECT unnest(generate_series(0, {grids.grid_size(AXES) - 1})) AS g)")
def grid_decode(spark: SparkSession, sf: str) -> DataFrame:
    return grids.grid(spark, AXES)


@CORE.query("grid_scaled_stops", f"WITH {D}, m AS (SELECT symbol, median((h - l) / c) AS med FROM d GROUP BY symbol) SELECT symbol, k::INT AS k, round(med * k, 8) AS stop FROM m, (SELECT unnest([1, 2, 4, 8]) AS k)")
def grid_scaled_stops(spark: SparkSession, sf: str) -> DataFrame:
    m = daily(spark, sf).groupBy("symbol").agg(F.median((F.col("h") - F.col("l")) / F.col("c")).alias("med"))
    return m.select("symbol", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("k"), "med").select("symbol", "k", r(F.col("med") * F.col("k"), 8).alias("stop"))


@CORE.query("grid_topk", f"WITH g AS (SELECT g AS gidx, {_axis_sql()} FROM (SELECT unnest(generate_series(0, {grids.grid_size(AXES) - 1})) AS g)) SELECT gidx, round(lev * tpd / stop - w / 1000.0, 6) AS score FROM g ORDER BY score DESC, gidx LIMIT 25")
def grid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return grids.grid(spark, AXES).select("gidx", r(F.col("lev") * F.col("tpd") / F.col("stop") - F.col("w") / 1000.0).alias("score")).orderBy(F.col("score").desc(), "gidx").limit(25)


@CORE.query("sobol_coverage", "SELECT d::INT AS dim, c AS cell, 64::BIGINT AS n FROM (SELECT unnest(generate_series(0, 24)) AS d), (SELECT unnest(generate_series(0, 15)) AS c)")
def sobol_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Points of a 25-dimensional low-discrepancy sample per sixteenth of each axis: 1,024 points leave 64 in each."""
    pts = grids.sobol(spark, 1024, 25, seed=7)
    return pts.select(F.posexplode("u").alias("dim", "x")).groupBy("dim", F.floor(F.col("x") * 16).alias("cell")).agg(F.count("*").alias("n"))


@CORE.query("halton_points", "SELECT i, " + ", ".join("round(" + " + ".join(f"(i // {b ** (k - 1)}::BIGINT % {b}) / {float(b) ** k}" for k in range(1, 13)) + f", 8) AS h{b}" for b in (2, 3)) + " FROM (SELECT unnest(generate_series(0, 499)) AS i)")
def halton_points(spark: SparkSession, sf: str) -> DataFrame:
    i = spark.range(500).withColumnRenamed("id", "i")
    return i.select("i", *(r(grids.halton(F.col("i"), b, 12), 8).alias(f"h{b}") for b in (2, 3)))


@CORE.query("is_oos_split", f"WITH {FX}, k AS (SELECT *, CASE WHEN rn < count(*) OVER (PARTITION BY symbol) // 2 THEN 'is' ELSE 'oos' END AS part, least(rn // greatest(1, count(*) OVER (PARTITION BY symbol) // 6), 5)::INT AS fold FROM fx) SELECT symbol, part, fold, count(*) AS n, round(avg(y), 8) + 0.0 AS mean FROM k GROUP BY ALL")
def is_oos_split(spark: SparkSession, sf: str) -> DataFrame:
    x = grids.folds(grids.in_out_sample(features(spark, sf), ["symbol"], "day"), ["symbol"], ["day"], 5)
    return x.groupBy("symbol", "part", "fold").agg(F.count("*").alias("n"), (r(F.avg("y"), 8) + 0.0).alias("mean"))


# ---- the strategy ----------------------------------------------------------------------------------------------------

#: Configurations of the test replay: id, length, rung distance and number, leverage, stop, rungs to trail, distance guard, fee.
CONFIGS = [(0, 10, 0.03, 3, 1.0, 0.05, 1, None, 0.0005), (1, 10, 0.08, 2, 2.0, 0.10, 2, 0.04, 0.001), (2, 20, 0.05, 4, 1.0, 0.08, 2, None, 0.0), (3, 20, 0.10, 1, 3.0, 0.04, 1, 0.06, 0.0005)]


def strategy_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    f = Frames(["symbol"])
    d = numbered(daily(spark, sf))
    each = F.array(*(F.struct(F.lit(w).alias("w"), f.mean(F.col("c"), w, 1).alias("ma")) for w in (10, 20)))
    bars = d.withColumn("e", each).withColumn("e", F.explode("e")).select("symbol", "e.w", F.col("_rn").alias("i"), "ts_ms", "o", "h", "l", "c", "e.ma")
    configs = spark.createDataFrame(CONFIGS, "config_id bigint, w int, tpd double, ntp int, lev double, stop double, sltp int, maxdist double, fee double").withColumn("liq", F.lit(False))
    return bars, configs


_CFG = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in c) + ")" for c in CONFIGS)
REPLAY = f"""{D}, cfg(id, w, tpd, ntp, lev, stop, sltp, maxdist, fee) AS (VALUES {_CFG}),
    ma AS (SELECT n.*, CASE WHEN count(c) OVER a = 10 THEN avg(c) OVER a END AS m10, CASE WHEN count(c) OVER b = 20 THEN avg(c) OVER b END AS m20 FROM n WINDOW a AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    mw AS (SELECT symbol, rn, ts_ms, h, l, c, w, CASE w WHEN 10 THEN m10 ELSE m20 END AS ma FROM ma, (SELECT DISTINCT w FROM cfg)),
    sg AS (SELECT *, CASE WHEN lag(l) OVER p <= lag(ma) OVER p AND lag(ma) OVER p <= lag(h) OVER p AND NOT (l <= ma AND ma <= h) THEN CASE WHEN c > ma THEN 1 ELSE -1 END ELSE 0 END AS sig, ma IS NOT NULL AND lag(ma) OVER p IS NOT NULL AS ok FROM mw WINDOW p AS (PARTITION BY symbol, w ORDER BY rn)),
    st AS (SELECT symbol, id, 0::BIGINT AS rn, 0 AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS rem, 0 AS hit, 10000.0::DOUBLE AS bal, 0::BIGINT AS opened, NULL::VARCHAR AS why, 0::BIGINT AS c_open, 0 AS c_dir, 0.0::DOUBLE AS c_bal FROM (SELECT DISTINCT symbol FROM n), cfg
      UNION ALL
      SELECT symbol, id, rn, npos, CASE WHEN opens THEN c ELSE entry END, CASE WHEN opens THEN nqty ELSE qty END, CASE WHEN opens THEN nqty WHEN npos = 0 THEN 0 ELSE rem1 END, CASE WHEN opens THEN 0 ELSE m END, CASE WHEN opens THEN bal1 - fee * nqty * c ELSE bal1 END, CASE WHEN opens THEN ts_ms ELSE opened END, why1, opened, pos, bal1
      FROM (SELECT *, CASE WHEN opens THEN sig WHEN why1 IS NOT NULL THEN 0 ELSE pos END AS npos, bal1 * lev / c AS nqty FROM (
        SELECT *, ok AND sig <> 0 AND bal1 > 1e-9 AND NOT far AND (pos = 0 OR why1 = 'REVERSE') AS opens FROM (
          SELECT *, CASE WHEN why1 IS NULL THEN bal + ladder ELSE bal + ladder + CASE WHEN why1 = 'TP' THEN 0 ELSE (px - entry) * pos * rem1 - fee * rem1 * px END END AS bal1 FROM (
            SELECT *, CASE why1 WHEN 'SL' THEN level WHEN 'REVERSE' THEN c END AS px FROM (
              SELECT *, CASE WHEN pos = 0 OR NOT ok THEN NULL WHEN stopped THEN 'SL' WHEN m >= ntp THEN 'TP' WHEN sig <> 0 AND sig <> pos THEN 'REVERSE' END AS why1,
                CASE WHEN pos = 0 THEN 0 ELSE qty / ntp * list_sum(list_transform(generate_series(hit + 1, m), lambda k: entry * tpd * k - fee * entry * (1 + pos * tpd * k))) END AS lad0, coalesce(lad0, 0) AS ladder, qty * (1 - m / ntp) AS rem1 FROM (
                SELECT *, CASE WHEN pos = 0 OR NOT ok OR stopped THEN hit ELSE hit + len(list_filter(generate_series(hit + 1, ntp), lambda k: (best - entry * (1 + pos * tpd * k)) * pos >= 0))::INT END AS m FROM (
                  SELECT *, pos <> 0 AND ok AND (worst - level) * pos <= 0 AS stopped FROM (
                    SELECT st.symbol, st.id, sg.rn, st.pos, st.entry, st.qty, st.hit, st.bal, st.opened, sg.ts_ms, sg.c, sg.sig, sg.ok, sg.ma, cfg.tpd, cfg.ntp, cfg.lev, cfg.fee,
                      CASE WHEN st.pos > 0 THEN sg.l ELSE sg.h END AS worst, CASE WHEN st.pos > 0 THEN sg.h ELSE sg.l END AS best, coalesce(cfg.maxdist > 0 AND abs(sg.c - sg.ma) / sg.ma > cfg.maxdist, false) AS far,
                      CASE WHEN st.hit >= cfg.sltp THEN CASE WHEN st.pos > 0 THEN greatest(st.entry * (1 - cfg.stop), sg.ma) ELSE least(st.entry * (1 + cfg.stop), sg.ma) END ELSE st.entry * (1 - st.pos * cfg.stop) END AS level
                    FROM st JOIN cfg ON cfg.id = st.id JOIN sg ON sg.symbol = st.symbol AND sg.w = cfg.w AND sg.rn = st.rn + 1))))))))
    )"""


@CORE.query("trade_chain", f"WITH RECURSIVE {REPLAY} SELECT st.symbol, id::BIGINT AS config_id, c_open AS open_ts, n.ts_ms AS exit_ts, why AS reason, round(c_bal / 10000, 8) AS growth FROM st JOIN n ON n.symbol = st.symbol AND n.rn = st.rn WHERE why IS NOT NULL")
def trade_chain(spark: SparkSession, sf: str) -> DataFrame:
    bars, configs = strategy_inputs(spark, sf)
    return chain.trade_chain(bars, configs).select("symbol", "config_id", "open_ts", "exit_ts", "reason", r(F.col("balance") / 10_000, 8).alias("growth"))


@CORE.query("replay_fold", f"WITH RECURSIVE {REPLAY} SELECT st.symbol, id::BIGINT AS config_id, c_open AS open_ts, n.ts_ms AS exit_ts, why AS reason, round(c_bal / 10000, 8) AS growth FROM st JOIN n ON n.symbol = st.symbol AND n.rn = st.rn WHERE why IS NOT NULL")
def replay_fold(spark: SparkSession, sf: str) -> DataFrame:
    bars, configs = strategy_inputs(spark, sf)
    return fold.replay_grid(bars.drop("i"), configs).select("symbol", "config_id", "open_ts", "exit_ts", "reason", r(F.col("balance") / 10_000, 8).alias("growth"))

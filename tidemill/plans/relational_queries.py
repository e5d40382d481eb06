"""Joins, aggregates, orderings, scalar functions and log reconstruction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalars as sc
from tidemill.operators import aggregates as ag
from tidemill.operators import joins, sessions, windows
from tidemill.operators.regular_grid import epoch_ms
from tidemill.operators.windows import Frames
from tidemill.plans.registry import CORE
from tidemill.plans.series import HOUR_MS, D, E, bars, bars_cte, daily, events, r
from tidemill.plans.window_queries import CROSS, H, _crosses, hourly
from tidemill.session import table

SIDE = "CASE WHEN upper(trim(side)) IN ('LONG', 'BUY') THEN 1 WHEN upper(trim(side)) IN ('SHORT', 'SELL') THEN -1 END"


def direction():
    said = F.upper(F.trim("side"))
    return F.when(said.isin("LONG", "BUY"), 1).when(said.isin("SHORT", "SELL"), -1)


@CORE.query("asof_backward", f"WITH {H}, t AS (SELECT symbol, hour, c FROM hb), l AS (SELECT symbol, event_id, ts_ms // {HOUR_MS} AS hour FROM e) SELECT l.event_id, t.hour AS asof_hour, t.c FROM l ASOF LEFT JOIN t ON l.symbol = t.symbol AND l.hour >= t.hour")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    ticks = events(spark, sf).select("symbol", "event_id", F.floor(F.col("ts_ms") / HOUR_MS).alias("hour"))
    return joins.asof_backward(ticks, hourly(spark, sf).select("symbol", "hour", "c"), ["symbol"], "hour", ["c"], part=720).select("event_id", "asof_hour", "c")


@CORE.query("asof_clipped", f"WITH {H}, l AS (SELECT symbol, event_id, ts_ms // {HOUR_MS} - 400000 AS hour FROM e), t AS (SELECT symbol, hour - 399900 AS hour, c FROM hb), f AS (SELECT symbol, min(hour) AS hour, arg_min(c, hour) AS c FROM t GROUP BY symbol) SELECT l.event_id, coalesce(t.hour, f.hour) AS asof_hour, coalesce(t.c, f.c) AS c FROM l ASOF LEFT JOIN t ON l.symbol = t.symbol AND l.hour >= t.hour LEFT JOIN f ON f.symbol = l.symbol")
def asof_clipped(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks against hours that are shifted a hundred hours on, so that the first ticks have none before them."""
    ticks = events(spark, sf).select("symbol", "event_id", (F.floor(F.col("ts_ms") / HOUR_MS) - 400_000).alias("hour"))
    hours = hourly(spark, sf).select("symbol", (F.col("hour") - 399_900).alias("hour"), "c")
    return joins.asof_clipped(ticks, hours, ["symbol"], "hour", ["c"], part=720).select("event_id", "asof_hour", "c")


@CORE.query("asof_strict_recent", f"WITH {H}, t AS (SELECT symbol, hour, c FROM hb), l AS (SELECT symbol, event_id, ts_ms // {HOUR_MS} AS hour FROM e) SELECT l.event_id, CASE WHEN l.hour - t.hour <= 3 THEN t.hour END AS asof_hour, CASE WHEN l.hour - t.hour <= 3 THEN t.c END AS c FROM l ASOF LEFT JOIN t ON l.symbol = t.symbol AND l.hour > t.hour")
def asof_strict_recent(spark: SparkSession, sf: str) -> DataFrame:
    ticks = events(spark, sf).select("symbol", "event_id", F.floor(F.col("ts_ms") / HOUR_MS).alias("hour"))
    return joins.asof_backward(ticks, hourly(spark, sf).select("symbol", "hour", "c"), ["symbol"], "hour", ["c"], strict=True, lookback=3).select("event_id", "asof_hour", "c")


@CORE.query("trade_features", f"""WITH {bars_cte('hb', '60m')}, f AS (SELECT symbol, ts_ms // {HOUR_MS} AS hour, arg_max(c, ts_ms) AS c FROM hb GROUP BY ALL), p AS (SELECT DISTINCT p.pos_id, j.symbol, p.open_ts // {HOUR_MS} - 1 AS hour FROM positions p JOIN jobs j ON p.sim_id = j.sim_id AND p.v = j.idx WHERE j.symbol IS NOT NULL)
    SELECT p.pos_id, f.c FROM p LEFT JOIN f ON p.symbol = f.symbol AND p.hour = f.hour""")
def trade_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each opening with the close of the hour before it: on a regular grid an as-of join is an equi-join."""
    h = bars(spark, sf, "60m").groupBy("symbol", F.floor(F.col("ts_ms") / HOUR_MS).alias("hour")).agg(F.max_by("c", "ts_ms").alias("c"))
    jobs = table(spark, sf, "jobs").where("symbol IS NOT NULL").select("sim_id", F.col("idx").alias("v"), "symbol")
    p = table(spark, sf, "positions").join(jobs, ["sim_id", "v"]).select("pos_id", "symbol", (F.floor(F.col("open_ts") / HOUR_MS) - 1).alias("hour")).distinct()
    return p.join(h, ["symbol", "hour"], "left").select("pos_id", "c")


@CORE.query("zero_fill_left", f"""WITH {D}, o AS (SELECT j.symbol, p.exit_ts // 86400000 AS day, sum(p.pnl) AS pnl FROM (SELECT DISTINCT pos_id, sim_id, v, exit_ts, pnl FROM positions WHERE exit_ts IS NOT NULL) p JOIN jobs j ON p.sim_id = j.sim_id AND p.v = j.idx WHERE j.symbol IS NOT NULL GROUP BY ALL), s AS (SELECT symbol, min(day) AS lo, max(day) AS hi FROM o GROUP BY symbol)
    SELECT d.symbol, d.day, round(CASE WHEN d.day BETWEEN lo AND hi THEN coalesce(o.pnl, 0) ELSE o.pnl END, 4) AS pnl FROM d LEFT JOIN o ON d.symbol = o.symbol AND d.day = o.day LEFT JOIN s ON d.symbol = s.symbol""")
def zero_fill_left(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "positions").where("exit_ts IS NOT NULL").select("pos_id", "sim_id", "v", "exit_ts", "pnl").distinct()
    jobs = table(spark, sf, "jobs").where("symbol IS NOT NULL").select("sim_id", F.col("idx").alias("v"), "symbol")
    o = p.join(jobs, ["sim_id", "v"]).groupBy("symbol", F.floor(F.col("exit_ts") / 86_400_000).alias("day")).agg(F.sum("pnl").alias("pnl"))
    return joins.zero_fill(daily(spark, sf).select("symbol", "day"), o, ["symbol"], "day", ["pnl"]).select("symbol", "day", r("pnl", 4).alias("pnl"))


@CORE.query("panel_join", f"WITH {D}, m AS (SELECT symbol, ts_ms // 86400000 AS day, median(c) AS c, count(*) AS bars FROM bars WHERE tf = '60m' AND c IS NOT NULL GROUP BY ALL) SELECT d.symbol, d.day, d.c, round(m.c, 6) AS c_x, m.bars FROM d LEFT JOIN m USING (symbol, day)")
def panel_join(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with the middle hourly close of the day and the number of deliveries."""
    m = table(spark, sf, "bars").where("tf = '60m' AND c IS NOT NULL").groupBy("symbol", F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(r(F.median("c")).alias("c"), F.count("*").alias("bars"))
    return joins.with_suffix(daily(spark, sf).select("symbol", "day", "c"), m, ["symbol", "day"])


@CORE.query("inner_symbols", f"WITH {H}, k AS (SELECT hour FROM hb GROUP BY hour HAVING count(*) = 5) SELECT symbol, hour, c FROM hb WHERE hour IN (SELECT hour FROM k)")
def inner_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that all five event types have."""
    return joins.complete_only(hourly(spark, sf).select("symbol", "hour", "c"), ["hour"], "symbol", 5)


@CORE.query("lookup_default", f"WITH {CROSS}, z AS (SELECT symbol, day FROM k WHERE x) SELECT d.symbol, d.day, z.day IS NOT NULL AS crossed FROM d LEFT JOIN z USING (symbol, day)")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    flags = _crosses(spark, sf).where("x").select("symbol", "day", F.lit(True).alias("crossed"))
    return joins.lookup(daily(spark, sf).select("symbol", "day"), flags, ["symbol", "day"], "crossed")


@CORE.query("resume_anti_join", "SELECT j.sim_id, j.idx FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.sim_id = j.sim_id AND p.v = j.idx)")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "positions").select("sim_id", F.col("v").alias("idx"))
    return joins.unfinished(table(spark, sf, "jobs").select("sim_id", "idx"), done, ["sim_id", "idx"])


@CORE.query("event_window_join", f"WITH {CROSS} SELECT a.day - b.day AS \"offset\", count(*) AS n, round(avg(a.c / b.c), 6) AS rel FROM k b JOIN d a ON a.symbol = b.symbol AND a.day BETWEEN b.day - 7 AND b.day + 7 WHERE b.x GROUP BY ALL")
def event_window_join(spark: SparkSession, sf: str) -> DataFrame:
    ev = _crosses(spark, sf).where("x").select("symbol", "day", F.col("c").alias("c0"))
    around = joins.around_events(daily(spark, sf).select("symbol", "day", "c"), ev, ["symbol"], "day", -7, 7)
    with_base = around.join(ev.select("symbol", F.col("day").alias("event_day"), "c0"), ["symbol", "event_day"])
    return with_base.groupBy(F.col("offset").cast("bigint").alias("offset")).agg(F.count("*").alias("n"), r(F.avg(F.col("c") / F.col("c0"))).alias("rel"))


@CORE.query("interval_join", f"""WITH {bars_cte('mb', '60m')}, p AS (SELECT DISTINCT p.pos_id, j.symbol, p.open_ts, p.exit_ts, p.entry, {SIDE.replace('side', 'p.side')} AS s FROM positions p JOIN jobs j ON p.sim_id = j.sim_id AND p.v = j.idx WHERE j.symbol IS NOT NULL AND p.exit_ts >= p.open_ts)
    SELECT pos_id, count(*) AS n, round(max(s * (CASE WHEN s > 0 THEN h ELSE l END / entry - 1)), 6) AS mfe, round(min(s * (CASE WHEN s > 0 THEN l ELSE h END / entry - 1)), 6) AS mae FROM p JOIN mb ON p.symbol = mb.symbol AND mb.ts_ms BETWEEN p.open_ts AND p.exit_ts GROUP BY pos_id""")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Best and worst excursion of each closed position over the hourly bars that it spans."""
    jobs = table(spark, sf, "jobs").where("symbol IS NOT NULL").select("sim_id", F.col("idx").alias("v"), "symbol")
    p = table(spark, sf, "positions").join(jobs, ["sim_id", "v"]).select("pos_id", "symbol", "open_ts", "exit_ts", "entry", direction().alias("s")).distinct()
    x = joins.within_interval(bars(spark, sf, "60m").select("symbol", "ts_ms", "h", "l"), p, ["symbol"], "ts_ms", "open_ts", "exit_ts", 24 * HOUR_MS)
    good, bad = F.when(F.col("s") > 0, F.col("h")).otherwise(F.col("l")), F.when(F.col("s") > 0, F.col("l")).otherwise(F.col("h"))
    return x.groupBy("pos_id").agg(F.count("*").alias("n"), r(F.max(F.col("s") * (good / F.col("entry") - 1))).alias("mfe"), r(F.min(F.col("s") * (bad / F.col("entry") - 1))).alias("mae"))


@CORE.query("self_lag_join", f"WITH {D} SELECT symbol, day, round((h - l) / c, 6) AS feature, round(lead(c) OVER (PARTITION BY symbol ORDER BY day) / c - 1, 6) + 0.0 AS outcome FROM d")
def self_lag_join(spark: SparkSession, sf: str) -> DataFrame:
    f = Frames(["symbol"], "day")
    return daily(spark, sf).select("symbol", "day", r((F.col("h") - F.col("l")) / F.col("c")).alias("feature"), (r(f.lead("c") / F.col("c") - 1) + 0.0).alias("outcome"))


@CORE.query("venue_overlap", f"WITH {H}, b AS (SELECT max(a) AS lo, min(z) AS hi FROM (SELECT min(hour) AS a, max(hour) AS z FROM hb GROUP BY symbol)) SELECT symbol, hour, c FROM hb, b WHERE hour BETWEEN lo AND hi")
def venue_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return joins.overlap(hourly(spark, sf).select("symbol", "hour", "c"), "symbol", "hour")


@CORE.query("config_subsets", """WITH RECURSIVE p AS (SELECT n_nationkey AS k FROM nation), s AS (SELECT 1 AS size, k AS first, k AS last, k AS total FROM p UNION ALL SELECT size + 1, first, p.k, total + p.k FROM s JOIN p ON p.k > s.last WHERE size < 5)
    SELECT size, first, last, total FROM s WHERE size >= 2""")
def config_subsets(spark: SparkSession, sf: str) -> DataFrame:
    s = joins.subsets(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), "k", [2, 3, 4, 5])
    return s.select(F.size("members").alias("size"), F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"), F.aggregate("members", F.lit(0).cast(s.schema["members"].dataType.elementType), lambda a, x: a + x).alias("total"))


# ---- aggregates and orderings ---------------------------------------------------------------------------------------

@CORE.query("group_summaries", """SELECT campaign, W, count(*) AS n, count(DISTINCT cfg) AS configs, round(median(port_DD), 6) AS med_dd, round(quantile_cont(port_DD, 0.9), 6) AS q90, round(avg((port_posMo > 50)::INT), 6) AS pos_share, round(sum(port_posMo * lev) / sum(lev), 6) AS wmean, round(exp(avg(ln(CASE WHEN isfinite(port_growth) AND port_growth > 0 THEN port_growth END))), 6) AS geo,
    round(product(1 + y2021 / 100) - 1, 6) AS comp, arg_max(cfg, (port_DD, cfg)) AS worst FROM config_year_matrix GROUP BY campaign, W""")
def group_summaries(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "config_year_matrix")
    return m.groupBy("campaign", "W").agg(
        F.count("*").alias("n"), F.countDistinct("cfg").alias("configs"), r(F.median("port_DD")).alias("med_dd"), r(F.percentile("port_DD", F.lit(0.9))).alias("q90"), r(ag.share(F.col("port_posMo") > 50)).alias("pos_share"),
        r(ag.weighted_mean(F.col("port_posMo"), F.col("lev"))).alias("wmean"), r(ag.geometric_mean(sc.finite(F.col("port_growth"), None))).alias("geo"), r(ag.compound(F.col("y2021") / 100)).alias("comp"), F.max_by("cfg", F.struct("port_DD", "cfg")).alias("worst"),
    )


@CORE.query("quantile_bins", f"WITH {D}, q AS (SELECT symbol, min(c) AS lo, [quantile_cont(c, 0.2), quantile_cont(c, 0.4), quantile_cont(c, 0.6), quantile_cont(c, 0.8)] AS qs FROM d GROUP BY symbol) SELECT d.symbol, d.day, len(list_filter(list_distinct(qs), lambda x: d.c > x AND x > lo))::INT AS bin FROM d JOIN q USING (symbol)")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return ag.quantile_bins(daily(spark, sf), ["symbol"], "c").select("symbol", "day", "bin")


@CORE.query("config_year_pivot", "SELECT campaign, " + ", ".join(f"round(sum(CASE WHEN W % 5 = {k} THEN port_DD END), 4) AS w{k}" for k in range(5)) + " FROM (SELECT campaign, W // 50 AS W, port_DD FROM config_year_matrix) GROUP BY campaign")
def config_year_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "config_year_matrix").withColumn("k", F.concat(F.lit("w"), (F.floor(F.col("W") / 50) % 5).cast("string")))
    return ag.pivot(m, ["campaign"], "k", [f"w{k}" for k in range(5)], F.round(F.sum("port_DD"), 4))


@CORE.query("unpivot_years", "SELECT cfg, run_ms, year, growth FROM (UNPIVOT (SELECT cfg, epoch_ms(run_ts) AS run_ms, y2018, y2019, y2020, y2021, y2022, y2023, y2024, y2025, y2026 FROM config_year_matrix) ON y2018, y2019, y2020, y2021, y2022, y2023, y2024, y2025, y2026 INTO NAME year VALUE growth)")
def unpivot_years(spark: SparkSession, sf: str) -> DataFrame:
    years = [f"y{k}" for k in range(2018, 2027)]
    m = table(spark, sf, "config_year_matrix").select("cfg", F.unix_millis("run_ts").alias("run_ms"), *years)
    return m.unpivot(["cfg", "run_ms"], years, "year", "growth").where("growth IS NOT NULL")


@CORE.query("sort_top_k", "SELECT DISTINCT cfg, port_DD, port_posMo FROM config_year_matrix ORDER BY port_DD, port_posMo DESC, cfg LIMIT 60")
def sort_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return ag.top_k(table(spark, sf, "config_year_matrix").select("cfg", "port_DD", "port_posMo").distinct(), [F.col("port_DD"), F.col("port_posMo").desc(), F.col("cfg")], 60)


@CORE.query("top_fraction", "WITH m AS (SELECT DISTINCT campaign, cfg, port_DD FROM config_year_matrix) SELECT campaign, cfg, port_DD FROM m QUALIFY row_number() OVER (PARTITION BY campaign ORDER BY port_DD, cfg) <= greatest(20, floor(0.01 * count(*) OVER (PARTITION BY campaign)))")
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "config_year_matrix").select("campaign", "cfg", "port_DD").distinct()
    return ag.top_fraction(m, ["campaign"], [F.col("port_DD"), F.col("cfg")]).select("campaign", "cfg", "port_DD")


@CORE.query("set_operations", f"WITH {D}, a AS (SELECT DISTINCT symbol, day // 30 AS m FROM d WHERE c > o), b AS (SELECT DISTINCT symbol, day // 30 AS m FROM d WHERE c < o) SELECT symbol, m, bool_or(s = 0) AS rose, bool_or(s = 1) AS fell FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the months in which a series rose or fell, and in which of the two sets they are."""
    d = daily(spark, sf).withColumn("m", F.floor(F.col("day") / 30))
    a, b = (d.where(p).select("symbol", "m").distinct().withColumn("s", F.lit(k)) for k, p in enumerate(("c > o", "c < o")))
    return a.unionByName(b).groupBy("symbol", "m").agg(F.bool_or(F.col("s") == 0).alias("rose"), F.bool_or(F.col("s") == 1).alias("fell"))


# ---- scalars and the log ----------------------------------------------------------------------------------------------

@CORE.query("calendar_parts", "SELECT sim_id, idx, year(t)::INT AS y, month(t)::INT AS m, hour(t)::INT AS h, (isodow(t) - 1)::INT AS dow, date_diff('day', DATE '1970-01-01', date_trunc('month', t)::DATE) AS month, s_ms // 900000 AS q, s_ms // 86400000 // 7 AS week FROM (SELECT *, make_timestamp(s_ms * 1000) AS t FROM jobs)")
def calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    t, ms = sc.utc(F.col("s_ms")), F.col("s_ms")
    return table(spark, sf, "jobs").select("sim_id", "idx", F.year(t).alias("y"), F.month(t).alias("m"), F.hour(t).alias("h"), sc.weekday(ms).alias("dow"), F.unix_date(sc.month(ms)).cast("bigint").alias("month"), sc.bucket(ms, 900_000).alias("q"), F.floor(sc.bucket(ms, 86_400_000) / 7).alias("week"))


@CORE.query("scalar_maps", """WITH j AS (SELECT sim_id, idx, cfg.leverage AS lev, cfg.stop_loose AS stop, cfg.longSMA AS w, med, fee, (idx % 100) / 100.0::DOUBLE AS u FROM jobs)
    SELECT sim_id, idx, round(1 + u * 9, 6) AS lin, round(exp(ln(0.001) + u * (ln(0.1) - ln(0.001))), 8) AS lg, (500 + round_even(u * 3500 / 50, 0) * 50)::INT AS step, CASE WHEN u < 0.3 THEN lev END AS gated, greatest(lev * -0.5, -0.999)::DOUBLE AS levered,
    coalesce(med > 0 AND abs(103.0 - 100.0) / 100.0 > med, false) AS far, round(1 + 0.4 * least(greatest(u * 10 - 5, -2.5), 2.5) / 2.5, 6) AS mult, round(stop / nullif(fee, 0), 4) AS ratio FROM j""")
def scalar_maps(spark: SparkSession, sf: str) -> DataFrame:
    u = (F.col("idx") % 100) / 100.0
    j = table(spark, sf, "jobs")
    return j.select(
        "sim_id", "idx", r(sc.linear(u, 1, 10)).alias("lin"), r(sc.logarithmic(u, 0.001, 0.1), 8).alias("lg"), sc.integer(u, 500, 4000, 50).alias("step"), sc.gate(u, 0.3, F.col("cfg.leverage")).alias("gated"), sc.levered(F.lit(-0.5), F.col("cfg.leverage")).alias("levered"),
        sc.too_far(F.lit(103.0), F.lit(100.0), F.col("med")).alias("far"), r(sc.multiplier(u * 10 - 5, 0.4)).alias("mult"), r(sc.ratio(F.col("cfg.stop_loose"), F.col("fee")), 4).alias("ratio"),
    )


@CORE.query("null_policy", "SELECT cfg, count_if(port_growth IS NULL OR NOT isfinite(port_growth))::BIGINT AS unusable, round(sum(CASE WHEN isfinite(port_growth) THEN port_growth ELSE 0 END), 4) AS total FROM config_year_matrix GROUP BY cfg")
def null_policy(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("port_growth")
    return table(spark, sf, "config_year_matrix").groupBy("cfg").agg(F.count_if(sc.finite(g, None).isNull()).alias("unusable"), r(F.sum(sc.finite(g, 0.0)), 4).alias("total"))


@CORE.query("text_keys", "SELECT sim_id, idx, upper(sim_id) || '/' || lpad(idx::VARCHAR, 4, '0') AS key, substr(sim_id, 1, 8) AS short, TRY_CAST(regexp_extract(sim_id, '[0-9]+') AS INT) AS digits, printf('W%d lev%.1f', cfg.longSMA, cfg.leverage) AS label FROM jobs")
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "jobs")
    return j.select("sim_id", "idx", F.concat(F.upper("sim_id"), F.lit("/"), F.lpad(F.col("idx").cast("string"), 4, "0")).alias("key"), F.substring("sim_id", 1, 8).alias("short"), sc.number(F.regexp_extract("sim_id", "[0-9]+", 0), "int").alias("digits"), F.format_string("W%d lev%.1f", "cfg.longSMA", "cfg.leverage").alias("label"))


@CORE.query("round_levels", f"WITH {D} SELECT symbol, day, len(list_filter([0.5, 1, 10, 50, 100, 500, 1000, 5000], lambda v: abs(c / v - 1) < 0.05)) > 0 AS near FROM d")
def round_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.array(*map(F.lit, (0.5, 1.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0)))
    return daily(spark, sf).select("symbol", "day", sc.near_round_level(F.col("c"), levels, 0.05).alias("near"))


@CORE.query("time_slice", "WITH b AS (SELECT sim_id, v, CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 WHEN timestamp < 100000000000000 THEN timestamp ELSE timestamp // 1000 END AS t, market_price FROM ma_hourly), k AS (SELECT sim_id, v, count_if(t BETWEEN 1550000000000 AND 1600000000000) AS n FROM b GROUP BY ALL) SELECT b.sim_id, b.v, count(*) AS n FROM b JOIN k USING (sim_id, v) WHERE k.n < 50 OR t BETWEEN 1550000000000 AND 1600000000000 GROUP BY ALL")
def time_slice(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "ma_hourly").withColumn("timestamp", epoch_ms(F.col("timestamp")))
    return sc.time_slice(b, ["sim_id", "v"], "timestamp", F.lit(1550000000000), F.lit(1600000000000), 50).groupBy("sim_id", "v").agg(F.count("*").alias("n"))


POSITIONS = f"""g AS (SELECT sim_id, v, timestamp AS ts, row_no, event_type AS k, coalesce(price, 0) AS price, coalesce(amount, 0) AS amount, balance, {SIDE} AS s FROM trade_log WHERE event_type IN ('Execute', 'StopLoose', 'Close Position')),
    q AS (SELECT *, coalesce(sum((k = 'Close Position')::INT) OVER (PARTITION BY sim_id, v ORDER BY ts, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sess FROM g),
    f AS (SELECT sim_id, v, sess, min((ts, row_no)) AS a, max((ts, row_no)) AS z, max(CASE WHEN balance IS NOT NULL THEN (ts, row_no) END) AS b, bool_or(k = 'StopLoose')::INT AS stop_hit, count_if(k = 'Execute')::BIGINT AS n_fills FROM q WHERE k <> 'Close Position' GROUP BY ALL),
    e1 AS (SELECT DISTINCT sim_id, v, sess FROM q WHERE k = 'Close Position'),
    pp AS (SELECT f.sim_id, f.v, qa.ts AS open_ts, qz.ts AS exit_ts, (CASE WHEN qa.k = 'StopLoose' THEN -qa.s ELSE qa.s END)::INT AS direction, qa.price AS entry_price, qz.price AS exit_price, qa.amount AS qty, qa.balance AS entry_balance, qb.balance AS exit_balance, f.stop_hit, f.n_fills
      FROM f JOIN e1 USING (sim_id, v, sess) JOIN q qa ON qa.row_no = f.a[2] JOIN q qz ON qz.row_no = f.z[2] LEFT JOIN q qb ON qb.row_no = f.b[2])"""


@CORE.query("position_sessionize", f"""WITH {POSITIONS} SELECT sim_id, v, open_ts, exit_ts, direction, entry_price, exit_price, qty, entry_balance, exit_balance, stop_hit, n_fills, CASE WHEN stop_hit = 1 THEN 'stop' ELSE 'reverse_or_tp' END AS exit_type, round(exit_balance - entry_balance, 6) + 0.0 AS pnl, round((exit_balance - entry_balance) / nullif(entry_balance, 0), 6) + 0.0 AS ret,
    (exit_ts - open_ts) / 1000.0::DOUBLE AS duration_s, coalesce((exit_balance - entry_balance) / nullif(entry_balance, 0) < 0, false)::INT AS loss, strftime(make_timestamp(open_ts * 1000), '%Y-%m') AS month FROM pp""")
def position_sessionize(spark: SparkSession, sf: str) -> DataFrame:
    p = sessions.reconstruct_positions(table(spark, sf, "trade_log"), ["sim_id", "v"], direction())
    return p.withColumns({"pnl": r("pnl") + 0.0, "ret": r("ret") + 0.0})


@CORE.query("ladder_decode", """WITH x AS (SELECT sim_id, v, timestamp, row_no, price, first_value(price IGNORE NULLS) OVER w AS p0 FROM trade_log WHERE event_type = 'Execute' WINDOW w AS (PARTITION BY sim_id, v ORDER BY timestamp, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT sim_id, v, len(l)::INT AS n, l[1] AS first, l[len(l)] AS last FROM (SELECT sim_id, v, list_slice(list_sort(list_distinct(list(round(abs(price / p0 - 1), 2)))), 1, 30) AS l FROM x WHERE price IS NOT NULL AND p0 > 0 GROUP BY ALL)""")
def ladder_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The thirty smallest distinct rounded offsets of fills from the first fill's price."""
    x = table(spark, sf, "trade_log").where("event_type = 'Execute' AND price IS NOT NULL")
    first = x.groupBy("sim_id", "v").agg(F.min_by("price", F.struct("timestamp", "row_no")).alias("p0")).where("p0 > 0")
    offsets = x.join(first, ["sim_id", "v"]).select("sim_id", "v", F.round(F.abs(F.col("price") / F.col("p0") - 1), 2).alias("d")).distinct()
    l = offsets.groupBy("sim_id", "v").agg(F.slice(F.array_sort(F.collect_list("d")), 1, 30).alias("l"))
    return l.select("sim_id", "v", F.size("l").alias("n"), F.element_at("l", 1).alias("first"), F.element_at("l", -1).alias("last"))

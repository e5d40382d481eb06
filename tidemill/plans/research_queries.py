"""Streams, feature panels, models, flags and payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import grids, learn, payloads, stats
from tidemill.operators.windows import latest_version
from tidemill.plans.metric_queries import P, RUN, closed
from tidemill.plans.registry import CORE
from tidemill.plans.panel_queries import hourly
from tidemill.plans.series import E, r
from tidemill.session import cut, remove, shared_folder, table
from tidemill.streaming import bars as streams


def ticks(spark: SparkSession, sf: str, streaming: bool) -> DataFrame:
    path = f"{sf}/events.parquet"
    still = spark.read.parquet(path)
    rows = streams.tick_stream(spark, path, still.schema) if streaming else still
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


LATE_MS = 86_400_000


@CORE.query("stream_ohlcv", f"WITH {E}, b AS (SELECT symbol, ts_ms // 900000 * 900000 AS start_ms, arg_min(price, (ts_ms, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts_ms, event_id)) AS c, count(*)::DOUBLE AS v, count(*) AS n FROM e GROUP BY ALL) SELECT * FROM b WHERE start_ms + 900000 <= (SELECT max(ts_ms) FROM e) - {LATE_MS}")
def stream_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-hour bars by Structured Streaming over what is there: a bar goes out, once, when the watermark has passed it.

    Ticks may be a day late; the bars of the last day are thus still open at the end, and their state is all that is kept.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    kept = cut(streams.run_once(streams.windowed_ohlcv(ticks(spark, sf, True), late="1 day"), f"{place}/out", f"{place}/state"))
    remove(spark, place)
    return kept


@CORE.query("tick_sessions", f"WITH {E}, g AS (SELECT symbol, ts_ms, (ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) >= 7200000)::INT AS brk FROM e), s AS (SELECT symbol, ts_ms, sum(coalesce(brk, 0)) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT symbol, min(ts_ms) AS begin_ms, max(ts_ms) AS end_ms, count(*) AS n FROM s GROUP BY symbol, k")
def tick_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(ticks(spark, sf, False), "2 hours")


LEARNED = ["ret_1h", "vol_24h", "dist_ma", "price_slope_24", "rsi_14", "bb_width", "bb_pos", "mom_5"]


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    x = learn.next_period_target(hourly(spark, sf), RUN, "slot", "ret_1h")
    rows = x.na.drop(subset=[*LEARNED, "target"]).select(*RUN, "slot", "target", *LEARNED)
    return cut(grids.folds(rows, RUN, ["slot"], 3))  # models pass over it many times


@CORE.query("walk_forward_scores")
def walk_forward_scores(spark: SparkSession, sf: str) -> DataFrame:
    """AUC and average precision of boosted trees and of logistic regression on expanding windows."""
    folded, out = _folded(spark, sf), None
    for kind in ("gbt", "logistic"):
        p = learn.walk_forward(folded, LEARNED, "target", "fold", 3, kind).withColumn("model", F.lit(kind))
        s = stats.cliffs_delta(p, ["model", "fold"], "p", "target", 1).join(stats.average_precision(p, ["model", "fold"], "p", "target"), ["model", "fold"])
        out = s if out is None else out.unionByName(s)
    return out.select("model", "fold", "n1", "n0", "auc", "ap")


@CORE.query("permutation_importance")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of AUC when a feature's values are dealt anew in the last fold."""
    folded = _folded(spark, sf)
    rows = folded.withColumns({f: F.col(f).cast("double") for f in LEARNED})
    model = learn._fit("logistic", rows.where("fold < 3"), LEARNED, "target", 0)
    test, out = rows.where("fold = 3"), None
    for f in ["", *LEARNED]:
        x = learn.permuted(test, f, [*RUN, "slot"]) if f else test
        s = learn.predict(model, x, LEARNED).select(F.lit(f or "none").alias("feature"), "p", "target")
        out = s if out is None else out.unionByName(s)
    return stats.cliffs_delta(out, ["feature"], "p", "target", 1).select("feature", "auc")


@CORE.query(
    "trade_log_json",
    f"WITH {P}, k AS (SELECT *, exit_ts * 1000000 + pos_id % 1000000 AS o FROM p) SELECT sim_id, v, count(*) AS n, round(sum(pnl), 4) + 0.0 AS pnl, max(length(reason))::INT AS longest, count(DISTINCT exit_ts // 86400000) AS days, round(arg_max(balance, o), 4) AS last, round(arg_max(balance, o) / 1000, 6) AS growth FROM k GROUP BY ALL",
)
def trade_log_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each run as a JSON payload (summary, curve of daily balances, closes in time order), read again from it."""
    again = payloads.read(payloads.results(closed(spark, sf), RUN, 1000.0), RUN)
    trades = again.select(*RUN, "summary", "curve", F.explode("trades").alias("t"))
    return trades.groupBy(*RUN).agg(F.count("*").alias("n"), (r(F.sum("t.pnl"), 4) + 0.0).alias("pnl"), F.max(F.length("t.reason")).alias("longest"), F.max(F.size("curve").cast("bigint")).alias("days"), r(F.max(F.element_at("curve", -1)["balance"]), 4).alias("last"), r(F.max("summary.growth")).alias("growth"))


@CORE.query(
    "campaign_jobs",
    "WITH m AS (SELECT * FROM config_year_matrix WHERE isfinite(port_growth) QUALIFY row_number() OVER (PARTITION BY cfg ORDER BY run_ts DESC, port_DD) = 1), k AS (SELECT *, row_number() OVER (ORDER BY port_growth DESC, cfg) - 1 AS idx FROM m) SELECT 'best' AS sim_id, idx::INT AS idx, W::INT AS longSMA, tpd AS tp_difference, ntp AS tp_count, lev AS leverage, stop AS stop_loose, sltp AS stopLooseTP, CASE WHEN maxdist > 0 THEN maxdist END AS med, cfg FROM k WHERE idx < 100",
)
def campaign_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best configurations as jobs."""
    m = table(spark, sf, "config_year_matrix").where("NOT isnan(port_growth) AND abs(port_growth) < double('infinity')")
    best = latest_version(m, ["cfg"], F.col("run_ts").desc(), F.col("port_DD"))
    jobs = payloads.campaign(best, "best", [F.col("port_growth").desc(), F.col("cfg")], 100)
    return jobs.select("sim_id", "idx", "cfg.*", "med", F.col("config_id").alias("cfg"))

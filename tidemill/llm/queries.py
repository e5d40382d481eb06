"""Queries of the operators tagged llm (problems 2, 4, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import leakage, nearest_time, packing, reading, top_groups
from tidemill.plans.registry import Registry
from tidemill.session import table

LLM = Registry()


def _direction(c: str) -> Column:
    said = F.upper(F.trim(c))
    return F.when(said.isin("LONG", "BUY"), 1).when(said.isin("SHORT", "SELL"), -1)


@LLM.query(
    "p2_found",
    """
    WITH p AS (SELECT DISTINCT pos_id, sim_id, v, open_ts, CASE WHEN upper(trim(side)) IN ('LONG', 'BUY') THEN 1 WHEN upper(trim(side)) IN ('SHORT', 'SELL') THEN -1 END AS s FROM positions),
    t AS (SELECT sim_id, v, row_no, timestamp, CASE WHEN upper(trim(side)) IN ('LONG', 'BUY') THEN 1 WHEN upper(trim(side)) IN ('SHORT', 'SELL') THEN -1 END AS s FROM trade_log WHERE event_type = 'Execute')
    SELECT p.pos_id, t.row_no FROM p JOIN t ON p.sim_id = t.sim_id AND p.v = t.v AND p.s = t.s AND abs(t.timestamp - p.open_ts) <= 90000
    QUALIFY row_number() OVER (PARTITION BY p.pos_id ORDER BY abs(t.timestamp - p.open_ts), t.timestamp, t.row_no) = 1
    """,
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    entity = [F.col("sim_id"), F.col("v"), _direction("side")]
    opens = nearest_time.side(table(spark, sf, "positions"), entity, F.col("open_ts"), F.col("pos_id"))
    fills = nearest_time.side(table(spark, sf, "trade_log").where("event_type = 'Execute'"), entity, F.col("timestamp"), F.col("row_no"))
    return nearest_time.nearest_in_time(opens, fills, 90_000).select(F.col("left_id").alias("pos_id"), F.col("right_id").alias("row_no"))


_SCORES = """
    WITH latest AS (SELECT campaign, W, cfg, CASE WHEN isfinite(port_growth) THEN port_growth END AS score FROM config_year_matrix
      QUALIFY row_number() OVER (PARTITION BY campaign, W, cfg ORDER BY run_ts DESC, CASE WHEN isfinite(port_growth) THEN port_growth END DESC NULLS LAST) = 1),
    ranked AS (SELECT campaign, W, cfg, score, row_number() OVER (PARTITION BY campaign, W ORDER BY score DESC, cfg) AS rank FROM latest WHERE score IS NOT NULL)
"""


def _best(spark: SparkSession, sf: str, n: int) -> DataFrame:
    runs = table(spark, sf, "config_year_matrix")
    return top_groups.top_per_group(top_groups.latest_score(runs, ["campaign", "W"], "cfg", "port_growth", "run_ts"), ["campaign", "W"], "cfg", n)


@LLM.query("p4_found", _SCORES + "SELECT campaign, W, cfg FROM ranked WHERE rank <= 5")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf, 5).select("campaign", "W", "cfg")


@LLM.query("p4_ranked", _SCORES + "SELECT campaign, W, cfg, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5")
def p4_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf, 5)


@LLM.query("p6_packed")
def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"))


@LLM.query("p6_use")
def p6_use(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of space in use."""
    each = packing.pack_texts(table(spark, sf, "documents")).groupBy("container").agg(F.sum("length").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").cast("bigint").alias("fullest"), (F.sum("tokens") / (F.count("*") * 2048)).alias("used"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@LLM.query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


@LLM.query("p7_spans")
def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


@LLM.query("p7_clean_documents")
def p7_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.without_leaked_documents(table(spark, sf, "documents"), _leaks(spark, sf)).select("doc_id", "text")


@LLM.query("p7_clean_spans")
def p7_clean_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.without_leaked_spans(table(spark, sf, "documents"), _leaks(spark, sf))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_refs"))


@LLM.query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "reading_level")


@LLM.query("p8_profile")
def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean level by source."""
    of = _levels(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return of.groupBy("source", "reading_level").agg(F.count("*").alias("n"), F.avg("theta").alias("theta"))

"""Irregular readings onto a regular grid, with the cells that hold no reading marked.

Readings of one source are taken in pairs of neighbours. The difference of a pair is spread over the grid cells that
the time between the two readings overlaps, in proportion to the overlap. For a cumulative counter a fall is a reset,
after which the whole new reading counts as increment; for a gauge the same rule yields its change within each cell
and, at a cell's end, its level on the line between the two readings. A cell that a pair spans without either reading
lying in it is uncovered, and so are cells before the first and after the last reading; these are the missing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of one chunk of a source. Neighbours are sought within chunks, and across them by way of one row per chunk.
CHUNK_CELLS = 4096
#: Cells that one row unfolds at a time.
STRIDE = 1024


def epoch_ms(stamp: Column) -> Column:
    """Epoch seconds, milli-, micro- or nanoseconds to milliseconds, told apart by magnitude (years 1973 to 5138)."""
    size = F.abs(stamp)
    return F.when(size < 10**11, stamp * 1000).when(size < 10**14, stamp).when(size < 10**17, F.floor(stamp / 1000)).otherwise(F.floor(stamp / 10**6)).cast("bigint")


def readings(df: DataFrame, source: Column, ts_ms: Column, value: Column, cell_ms: Column, version: Column | None = None) -> DataFrame:
    """(source, ts_ms, value, cell_ms, version); rows without source, stamp or cell length are left out, NaN is null."""
    return df.select(
        source.cast("string").alias("source"),
        ts_ms.cast("bigint").alias("ts_ms"),
        F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("value"),
        cell_ms.cast("bigint").alias("cell_ms"),
        (version if version is not None else F.lit(0)).cast("bigint").alias("version"),
    ).where("source IS NOT NULL AND ts_ms IS NOT NULL AND cell_ms > 0")


def regular_grid(rows: DataFrame, kind: str = "gauge") -> DataFrame:
    """``readings`` -> (source, slot_ms, n_readings, increment, level, missing), one row for every cell of every source.

    The cells of a source run from that of its first row to that of its last, rows with a null value included; a cell
    is missing if the pair that spans it, or the end of the readings, leaves it uncovered: no row in it has a value. ``increment`` is what the differences put into the cell (null where no two
    readings enclose any part of it), ``level`` the value at the cell's end, or the last reading in the source's last
    cell (null beyond the readings, and for counters). Several versions of one stamp count once, by the latest version
    that has a value, of equal ones the largest value. An empty input gives an empty result.
    """
    if kind not in ("gauge", "counter"):
        raise ValueError(f"kind is gauge or counter, not {kind!r}")
    chunked = rows.withColumn("slot", F.floor(F.col("ts_ms") / F.col("cell_ms"))).withColumn("chunk", F.floor(F.col("slot") / CHUNK_CELLS))
    stamped = (
        chunked.repartition("source", "chunk")
        .groupBy("source", "chunk", "ts_ms", "cell_ms", "slot")
        .agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("version", "value"))).alias("value"))
    )
    summary = stamped.groupBy("source", "chunk").agg(
        F.min(F.struct("ts_ms", "slot", "cell_ms")).alias("first_row"),
        F.max(F.struct("ts_ms", "slot")).alias("last_row"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("ts_ms", "value"))).alias("last"),
    )
    by_chunk = Window.partitionBy("source").orderBy("chunk")
    carried = summary.select("source", "chunk", F.last("last", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    order = Window.partitionBy("source", "chunk").orderBy("ts_ms")
    valued = stamped.where("value IS NOT NULL").withColumn("prev", F.lag(F.struct("ts_ms", "value")).over(order))
    pairs = (
        valued.join(carried, ["source", "chunk"])
        .withColumn("prev", F.coalesce("prev", "carry"))
        .select("source", "cell_ms", "slot", "ts_ms", "value", F.col("prev.ts_ms").alias("t0"), F.col("prev.value").alias("v0"))
    )
    step = F.col("value") - F.col("v0")
    if kind == "counter":
        step = F.when(step < 0, F.col("value")).otherwise(step)
    spread = (
        pairs.withColumn("slot0", F.coalesce(F.floor(F.col("t0") / F.col("cell_ms")), F.col("slot")))
        .withColumn("step", step)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slot") - F.col("slot0")) / STRIDE))))
        .withColumn("from", F.col("slot0") + F.col("part") * STRIDE)
        .withColumn("cell", F.explode(F.sequence("from", F.least(F.col("slot"), F.col("from") + (STRIDE - 1)))))
    )
    start, end = F.col("cell") * F.col("cell_ms"), (F.col("cell") + 1) * F.col("cell_ms")
    span = F.col("ts_ms") - F.col("t0")
    overlap = F.least(end, F.col("ts_ms")) - F.greatest(start, F.col("t0"))
    here = F.col("cell") == F.col("slot")
    level = F.when(F.col("t0").isNotNull() & (end > F.col("t0")) & (end <= F.col("ts_ms")), F.col("v0") + F.col("step") * (end - F.col("t0")) / span)
    cells = spread.select(
        "source",
        "cell",
        "cell_ms",
        here.cast("int").alias("reading"),
        ((F.col("cell") > F.col("slot0")) & ~here).alias("uncovered"),
        F.when(overlap > 0, F.col("step") * overlap / span).alias("part"),
        (level if kind == "gauge" else F.lit(None).cast("double")).alias("level"),
        F.when(here & F.lit(kind == "gauge"), F.struct("ts_ms", "value")).alias("latest"),
    )
    # Cells outside all pairs: from the first row to the first reading, and from the last reading to the last row.
    ends = (
        summary.groupBy("source")
        .agg(F.min("first_row").alias("a"), F.max("last_row").alias("b"))
        .join(pairs.groupBy("source").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")), "source", "left")
    )
    spans = F.when(F.col("lo").isNull(), F.array(F.struct(F.col("a.slot").alias("x"), F.col("b.slot").alias("y")))).otherwise(
        F.array(F.struct(F.col("a.slot").alias("x"), (F.col("lo") - 1).alias("y")), F.struct((F.col("hi") + 1).alias("x"), F.col("b.slot").alias("y")))
    )
    outer = (
        ends.select("source", F.col("a.cell_ms").alias("cell_ms"), F.explode(spans).alias("s"))
        .where("s.y >= s.x")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("s.y") - F.col("s.x")) / STRIDE))))
        .withColumn("from", F.col("s.x") + F.col("part") * STRIDE)
        .select("source", F.explode(F.sequence("from", F.least(F.col("s.y"), F.col("from") + (STRIDE - 1)))).alias("cell"), "cell_ms")
        .select("source", "cell", "cell_ms", F.lit(0).alias("reading"), F.lit(True).alias("uncovered"), F.lit(None).cast("double").alias("part"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("struct<ts_ms:bigint,value:double>").alias("latest"))
    )
    return (
        cells.unionByName(outer)
        .groupBy("source", "cell", "cell_ms")
        .agg(F.sum("reading").cast("bigint").alias("n_readings"), F.bool_or("uncovered").alias("missing"), F.sum("part").alias("increment"), F.max("level").alias("level"), F.max("latest").alias("latest"))
        .select(
            "source",
            (F.col("cell") * F.col("cell_ms")).alias("slot_ms"),
            "n_readings",
            "increment",
            F.coalesce("level", "latest.value").alias("level"),
            "missing",
        )
    )

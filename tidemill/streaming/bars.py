"""Bars and signals from streams of ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream."""
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_ohlcv(ticks: DataFrame, width: str = "15 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(symbol, start, o, h, l, c, v, n) of ticks (symbol, ts, seq, price); a bar is out once the watermark has passed it.

    Ticks later than ``late`` behind the newest are dropped. Works on batches too. ``slide`` gives overlapping bars.
    """
    order = F.struct("ts", "seq")
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    bars = ticks.withWatermark("ts", late).groupBy("symbol", win.alias("win")).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.count("*").cast("double").alias("v"), F.count("*").alias("n")
    )
    return bars.select("symbol", F.unix_millis(F.col("win.start").cast("timestamp")).alias("start_ms"), "o", "h", "l", "c", "v", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(symbol, begin_ms, end_ms, n): runs of ticks without a pause of ``gap``."""
    win = F.session_window("ts", gap)
    s = ticks.withWatermark("ts", late).groupBy("symbol", win.alias("win")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("symbol", F.unix_millis(F.col("a").cast("timestamp")).alias("begin_ms"), F.unix_millis(F.col("b").cast("timestamp")).alias("end_ms"), "n")


def crossings(bars: DataFrame, w: int) -> DataFrame:
    """(symbol, ts_ms, signal) of a stream of bars (symbol, ts_ms, h, l, c): crossings of the mean of the last w closes.

    The state of a symbol is its last w closes and whether the bar before held the mean; bars of one trigger are taken
    in time order, bars older than those seen are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, closes, held = state.get if state.exists else (-1, [], None)
        closes, out = list(closes), []
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        for ts, h, lo, c in zip(rows["ts_ms"], rows["h"], rows["l"], rows["c"]):
            if ts <= last:
                continue
            now = None
            if len(closes) == w:
                ma = sum(closes) / w
                now = bool(lo <= ma <= h)
                if held and not now:
                    out.append((key[0], int(ts), 1 if c > ma else -1))
            last, held = int(ts), now
            closes = (closes + [float(c)])[-w:]
        state.update((last, closes, held))
        yield pd.DataFrame(out, columns=["symbol", "ts_ms", "signal"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts_ms bigint, signal int", "last bigint, closes array<double>, held boolean", "append", GroupStateTimeout.NoTimeout)


def upsert(path: str, keys: Sequence[str], version: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that a batch delivered twice doesn't change.

    Each batch keeps the newest row of each key by ``version`` and replaces the folder of its own number;
    ``read_latest`` takes the newest over all batches, so nothing is counted twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        newest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def newest(rows: DataFrame, keys: Sequence[str], *version: str) -> DataFrame:
    value = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*version, value)).alias("_r")).select(*keys, "_r.*")


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> DataFrame:
    return newest(spark.read.option("basePath", path).parquet(f"{path}/epoch=*"), keys, version, "epoch").drop("epoch")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet files and reads them."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

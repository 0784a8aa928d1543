"""Windows over event time: sessions and sliding windows of streams, with a watermark for late rows. The same plans run on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(rows: DataFrame, time_col: str, late: str) -> DataFrame:
    return rows.withWatermark(time_col, late) if rows.isStreaming else rows


def sessions(rows: DataFrame, keys: list[str], time_col: str, gap: str, late: str = "1 hour", **sums: Column) -> DataFrame:
    """(keys, start, end, n, and a column for each of sums) of runs of rows of a key that follow each other within gap; end is the
    last row's time and the gap. Rows with a null key are a key of their own, rows without a time belong to no session. Of a stream, a session comes
    out when the watermark has passed its end; rows later than that are left out, and counted by late_rows()."""
    window = F.session_window(time_col, gap)
    made = _timed(rows.where(F.col(time_col).isNotNull()), time_col, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
    return made.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *sums)


def sliding(rows: DataFrame, keys: list[str], time_col: str, width: str, slide: str, late: str = "1 hour", **sums: Column) -> DataFrame:
    """(keys, start, end, n, sums) of windows of one width, one beginning every slide; a row is in all that hold its time."""
    window = F.window(time_col, width, slide)
    made = _timed(rows.where(F.col(time_col).isNotNull()), time_col, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])
    return made.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *sums)


def append(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes finished windows of a stream to a table, each once, also when the query starts again from its checkpoint."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has left out as too late, as far as its progress reports reach back."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])

"""Detection over streams: the line detectors keep no state, so they run on a stream of pages as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect_lines
from ..operators.review import dedup_matches


def detect_stream(pages: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Matches of a stream of pages; cases are a static table. Nothing is shuffled, so appending output is exact."""
    return detect_lines(pages, cases)


def counts_by_window(pages: DataFrame, time_col: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Matches per window of event time and category, for pages with a time column; later ones than the watermark are dropped."""
    timed = pages.withColumn("doc_id", F.to_json(F.struct("doc_id", F.col(time_col).alias("t"))))
    found = detect_lines(timed.select("doc_id", "page_num", "text"))
    at = F.to_timestamp(F.get_json_object("doc_id", "$.t"))
    return found.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width), "category").agg(F.count("*").alias("n"))


def write_matches(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch's deduplicated matches to a table; a page arrives whole, so its batch holds all its matches. A batch that
    runs again after a failure writes its own part (batch=...) anew, so no match is there twice."""

    def batch(rows: DataFrame, number: int) -> None:
        dedup_matches(rows).drop("first_ord").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return detect_stream(pages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

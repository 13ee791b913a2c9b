"""An extension: catalogue rows that arrive as a stream become record triples, each micro-batch merged once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import catalogue_rows, records


def ingest_stream(rows: DataFrame, batch: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the triples of each micro-batch under its own folder: a repeated micro-batch overwrites its own folder only."""

    def write(part: DataFrame, number: int) -> None:
        good, _ = catalogue_rows(part)
        records(good, batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, stamp: str, kind: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and kind, final once the watermark has passed."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")

"""Malformed lines as a stream: the batch reader works on streams too; bad lines are counted per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.sources.reject_csv import parse_lines


def reject_counts(lines: DataFrame, time_col: str = "received_at", late: str = "1 day", window: str = "1 day", id_col: str = "record_id") -> DataFrame:
    """window start, feed, reason, n of a stream (or table) of raw lines; lines later than ``late`` are left out of a
    stream's closed windows. The time travels through the parser with its line, so the only state is that of the windows."""
    bad = parse_lines(lines, id_col, carry=(time_col,)).select(F.col(time_col).alias("_t"), "feed", F.explode("reasons").alias("reason"))
    bad = bad.withWatermark("_t", late) if lines.isStreaming else bad
    return bad.groupBy(F.window("_t", window), "feed", "reason").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "feed", "reason", "n")


def split_stream(lines: DataFrame, good_path: str, bad_path: str, id_col: str = "record_id"):
    """A foreachBatch writer that sends each micro-batch's valid rows and rejects to two tables; batches are keyed by
    their number, so that a batch that is written again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch, id_col)
        parsed.where(F.size("reasons") == 0).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        parsed.where(F.size("reasons") > 0).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    return lines.writeStream.foreachBatch(write)

"""Streaming twins of the batch jobs: files and findings as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.findings import FINDING_KEY
from ..operators.scan import findings
from ..rules import Rule

FILES = "project string, path string, content string, framework string"


def arriving_files(spark: SparkSession, folder: str, schema: str = FILES, max_files: int = 100) -> DataFrame:
    """New parquet files of a corpus folder, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def live_scan(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rule scan of arriving files; stateless, the same expression as in batch."""
    return findings(files, rules)


def live_dedupe(found: DataFrame, time: str = "ts", delay: str = "1 hour", keys: Sequence[str] = tuple(FINDING_KEY)) -> DataFrame:
    """One row per key within the watermark; state older than that is dropped."""
    return found.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def counts_per_window(rows: DataFrame, key: str, time: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding window; rows later than ``delay`` are dropped."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return marked.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def counts_per_session(rows: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per session of a key: a run of rows without a longer pause."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")

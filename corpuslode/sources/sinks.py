"""Sinks for findings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(found: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by severity, sorted by project inside the files.

    Partitioning by severity keeps the number of folders small whatever the
    number of projects; row-group statistics on ``project`` do the rest.
    """
    keys = [c for c in ("project", "path") if c in found.columns]
    found.repartitionByRange("severity", *keys).sortWithinPartitions("severity", *keys).write.mode(mode).partitionBy("severity").parquet(path)

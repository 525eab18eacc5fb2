"""Corpus sources: a folder of source files, or a table of (project, path, content)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import glob_filter


def balanced(files: DataFrame) -> DataFrame:
    """Spread rows over all cores when the source has fewer files than cores.

    A handful of files may be a handful of tasks, whatever they hold.  With more
    files than cores the scan is parallel already and nothing is shuffled.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if len(files.inputFiles()) < cores else files


def read_corpus(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = (),
                project_depth: int = 1) -> DataFrame:
    """Text files under ``root/<project>/...`` as ``(project, path, content)``.

    The globs run on the path column before any text is touched; unreadable
    files and files that are not UTF-8 are skipped.  For a large corpus convert once to parquet with
    ``write_corpus`` and read that.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    below = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    clean = root.rstrip("/") if "://" in root else "/" + root.strip("/")
    parts = F.split(F.substr(below, F.lit(len(clean) + 2)), "/")
    named = found.withColumn("project", F.array_join(F.slice(parts, 1, project_depth), "/")).withColumn(
        "path", F.array_join(F.slice(parts, F.lit(project_depth + 1), F.size(parts)), "/")
    )
    named = glob_filter(named, include, exclude)
    return named.select("project", "path", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content IS NOT NULL")


def write_corpus(files: DataFrame, path: str) -> None:
    """Store a corpus as parquet, projects together so that they can be pruned."""
    files.repartitionByRange("project", "path").sortWithinPartitions("project", "path").write.mode("overwrite").parquet(path)

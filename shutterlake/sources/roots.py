"""The library as a table laid out by scan root: scans replace their roots alone, and reads of some roots leave the others' files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROOT = "scan_root"


def save(photos: DataFrame, table: str) -> None:
    """Replaces the roots that ``photos`` (scan_root, ...) has; others stay. A large root is dealt to many files."""
    photos.hint("rebalance", ROOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ROOT).parquet(table)


def load(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """All roots; a filter on scan_root reads its folders only."""
    return spark.read.schema(schema).parquet(table)


def of_roots(library: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the roots that ``roots`` (scan_root) has; where its rows are filtered by a comparison, Spark prunes the other folders while the query runs."""
    return library.join(roots.select(ROOT), ROOT, "left_semi")

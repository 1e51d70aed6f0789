"""Spreading work that costs more than its bytes suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def heavy_tasks(spark: SparkSession) -> int:
    """Tasks for a stage that is bound by CPU: adaptive execution must not merge them by their few bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(scanned: DataFrame) -> DataFrame:
    """A scan with at least a partition per core.

    Tables of many files come that way and are left alone; only a table of few
    row groups is dealt out, which is cheap because it is small. For scans and
    projections of them, whose plan holds no shuffle.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    found = scanned._jdf.queryExecution().toRdd().getNumPartitions()
    return scanned if found >= cores else scanned.repartition(cores)

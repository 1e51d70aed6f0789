"""Materialised intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="clonewright-")
    return _LOCAL[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it again.

    The table cuts the lineage, survives the loss of executors, and gives the
    optimiser the true size. ``discard`` removes it; what is left is removed
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clonewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._clonewright_path = path
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared folder when the driver's Python ends."""
    _TABLES.append((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove a materialised table that no later plan reads."""
    path = getattr(df, "_clonewright_path", None)
    for entry in [e for e in _TABLES if e[1] == path]:
        _TABLES.remove(entry)
        _remove(*entry)


def _remove_all() -> None:
    for spark, path in _TABLES:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the JVM may have ended first
            return


atexit.register(_remove_all)

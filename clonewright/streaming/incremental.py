"""Sources that keep arriving: scanning and exact-copy counts as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clonewright.operators.renamed import callables
from clonewright.sources.walk import scan


def scan_stream(sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Definitions of a streaming table (lang, file, content); stateless, so nothing is kept between batches."""
    return scan(sources, kinds)


def write_definitions(sources: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the definitions of arriving sources to a Parquet folder; each source is scanned exactly once."""
    writer = scan_stream(sources).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def copy_counts(definitions: DataFrame) -> DataFrame:
    """(digest, n_chars, n): running counts of equal renamed canonicals, for update or complete output.

    State is one row per distinct canonical, a digest and a count.
    """
    x = F.col("analysis.xname_canonical")
    own = callables(definitions).where(x.isNotNull())
    return own.groupBy(F.md5(x).alias("digest"), F.length(x).alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))

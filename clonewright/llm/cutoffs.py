"""Score cutoffs that keep a wanted share of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonewright.plans.scratch import materialise


def cutoffs(scores: DataFrame, targets: DataFrame, source: list[str], score: str, permille: str) -> DataFrame:
    """One row for each targeted source that has scores: ``cutoff``, ``n``, ``n_kept``, ``permille``.

    ``scores`` is first counted by (source, score), with partial aggregation,
    so a hot score is one row; these rows are range-sorted by source and score
    and written with their partition number, rows are counted per partition and
    source, prefix sums over those few counts name the partition that holds the
    wanted rank, and only that partition is ranked row by row. A source that
    holds any share of the rows is thus spread over many partitions.

    The cutoff is the greatest score that at least n * permille / 1000 scores
    reach (a share of 0 gives the greatest score). Null and NaN scores do not
    count. A source without scores gives no row; a source with several targets
    takes the greatest; null source parts match nothing. No side is broadcast by
    order: Spark does so where its own size limit allows, and adaptive execution
    splits a hot source where it does not.
    """
    wanted = targets.groupBy(*source).agg(F.max(permille).alias("permille")).dropna(subset=[*source, "permille"])
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*source, (F.col(score) + F.lit(0.0)).alias("score"))
    usable = usable.join(wanted.select(*source), source, "left_semi")
    counted = usable.groupBy(*source, "score").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(*[F.col(c) for c in source], F.col("score").desc())
    placed = materialise(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*source)
    parts = (
        placed.groupBy(*source, "part")
        .agg(F.sum("n").alias("in_part"))
        .withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
        .withColumn("total", F.sum("in_part").over(every))
        .join(wanted, source)
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("total") * F.col("permille") / 1000)))
        .where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("in_part")))
        .drop("in_part")
    )
    running = Window.partitionBy(*source).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(parts, [*source, "part"])
        .withColumn("reached", F.col("before") + F.sum("n").over(running))
        .where(F.col("reached") >= F.col("rank"))
        .groupBy(*source)
        .agg(
            F.max("score").alias("cutoff"),
            F.first("total").alias("n"),
            F.min("reached").alias("n_kept"),
            F.first("permille").alias("permille"),
        )
    )


def latest_findings(findings: DataFrame) -> DataFrame:
    """(finding_id, kind, severity, thickness) of the row with the greatest ``loaded_at``."""
    best = F.struct("loaded_at", "kind", "severity", "thickness")
    return (
        findings.where(F.col("finding_id").isNotNull())
        .groupBy("finding_id")
        .agg(F.max(best).alias("b"))
        .select("finding_id", "b.kind", "b.severity", "b.thickness")
    )


def kept(scores: DataFrame, cuts: DataFrame, source: list[str], score: str) -> DataFrame:
    """The rows of ``scores`` that reach the cutoff of their source; ``cuts`` has a row per target at most."""
    name = "__clonewright_cutoff"
    limits = cuts.select(*source, F.col("cutoff").alias(name))
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    return usable.join(limits, source).where(F.col(score) >= F.col(name)).select(*[usable[c] for c in scores.columns])

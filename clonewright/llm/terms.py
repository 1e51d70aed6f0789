"""How distinctive a term is for a record, against the whole collection."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonewright.plans.scratch import materialise

TERM = "[A-Za-z_][A-Za-z0-9_]*"


def _count_stage(pattern: str):
    """Rows (id, lines) to rows (id, term, tf, row_total)."""
    find = re.compile(pattern).findall

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts, totals = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tf = Counter(find(text))
                ids += [doc] * len(tf)
                terms += tf.keys()
                counts += tf.values()
                totals += [sum(tf.values())] * len(tf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.array(totals, pa.int32())],
                names=["id", "term", "tf", "row_total"],
            )

    return stage


class TermTable:
    """Counts of terms in records, with the margins of the record-by-term table.

    ``records`` has rows (id, lines) with distinct ids; ``lines`` is an array of
    strings, a null line holds nothing. ``cells``: (id, term, tf, row_total).
    ``margins``: (term, d, col_total), d being the number of records with the
    term. ``n``: number of records, ``total``: sum of all counts.

    Terms are counted within a record where it is read, so margins shuffle only
    their partial sums. Terms in more than one of 100 records are joined by
    broadcast: there are at most 100 times as many of them as a record has
    distinct terms on average. All other terms are joined by shuffle.
    """

    def __init__(self, records: DataFrame, pattern: str = TERM):
        lines = records.select("id", F.array_join("lines", "\n").alias("text"))
        self.cells = materialise(lines.mapInArrow(_count_stage(pattern), "id long, term string, tf int, row_total int"))
        self.margins = materialise(self.cells.groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.sum("tf").alias("col_total")))
        self.n = lines.count()
        self.total = self.margins.agg(F.sum("col_total")).first()[0] or 0

    def with_margins(self) -> DataFrame:
        """The cells with ``d`` and ``col_total``; one row per record and term."""
        hot = self.margins.where(F.col("d") * 100 > self.n)
        common = self.cells.join(F.broadcast(hot), "term")
        rare = self.cells.join(F.broadcast(hot.select("term")), "term", "left_anti")
        return common.unionByName(rare.join(self.margins.where(F.col("d") * 100 <= self.n), "term"))

    def scored(self) -> DataFrame:
        """The cells with three scores.

        ``residual``: observed minus expected count over the square root of the
        expectation row_total * col_total / total. ``adjusted``: the same over
        its standard deviation, the square root of (1 - row share) * (1 - column
        share); 0 where a margin holds everything. ``rarity``: tf * ln(n / d),
        rounded to 6 decimals.
        """
        row, col, total = F.col("row_total").cast("double"), F.col("col_total").cast("double"), F.lit(float(self.total))
        expected = row * col / total
        spread = F.sqrt((1 - row / total) * (1 - col / total))
        residual = (F.col("tf") - expected) / F.sqrt(expected)
        return self.with_margins().select(
            "id",
            "term",
            "tf",
            "d",
            residual.alias("residual"),
            F.when(spread > 0, residual / spread).otherwise(0.0).alias("adjusted"),
            F.round(F.col("tf") * F.log(F.lit(float(self.n)) / F.col("d")), 6).alias("rarity"),
        )


def best_terms(scored: DataFrame, score: str) -> DataFrame:
    """(id, term, score): the highest-scored term of each record, the smallest in byte order among equals."""
    best = F.min(F.struct((-F.col(score)).alias("s"), "term"))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.term", (-F.col("b.s") + F.lit(0.0)).alias("score"))

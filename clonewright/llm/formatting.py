"""Records that are equal but for layout, case, punctuation and the order of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonewright.plans.scratch import materialise

from .common import words_stage


def canonical_digests(values: DataFrame, min_words: int = 8) -> DataFrame:
    """(field, def_id, digest, check), written once, for rows (field, def_id, value) with at least ``min_words`` words.

    The canonical text is the words in lower case, sorted. Rows carry only its
    128-bit digest and a second, independent 64-bit hash; texts never cross the
    shuffle. Nulls and shorter texts give no row.
    """
    words = values.mapInArrow(words_stage(min_words, ordered=False), "field string, def_id long, digest binary, words string")
    return materialise(words.select("field", "def_id", "digest", F.xxhash64("words").alias("check")))


#: Digests under which the second hash differs are collisions: grouping on both tells them apart.
KEY = ["digest", "check", "field"]


def collapse(values: DataFrame, min_words: int = 8) -> DataFrame:
    """(field, def_id, keep_id): the members of every set of two or more records with one canonical text.

    Groups are aggregated with map-side combining, so a value that a third of
    all rows share costs a row per task. Several rows of one ``def_id`` count
    once.
    """
    placed = canonical_digests(values, min_words)
    groups = placed.groupBy(*KEY).agg(F.min("def_id").alias("keep_id"), F.max("def_id").alias("_last"))
    shared = groups.where(F.col("keep_id") < F.col("_last"))
    return placed.join(shared.select(*KEY, "keep_id"), KEY).select("field", "def_id", "keep_id").distinct()


def copies(values: DataFrame, min_words: int = 8) -> DataFrame:
    """(field, keep_id, copies): one row per canonical text, single ones too, with the number of definitions that have it."""
    placed = canonical_digests(values, min_words).distinct()
    return placed.groupBy(*KEY).agg(F.min("def_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).select("field", "keep_id", "copies")

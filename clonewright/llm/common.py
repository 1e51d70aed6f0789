"""Pieces shared by the operators of this package."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonewright.plans.partitions import spread

#: Words: maximal runs of these after lower-casing.
WORDS = re.compile("[a-z0-9_]+")


def words_stage(least: int, ordered: bool = True):
    """Batches of (field, def_id, value) to (field, def_id, digest, words) for values of at least ``least`` words.

    ``words`` are the words joined by one space, in text order or sorted;
    ``digest`` is the 128-bit digest of that. Python's ``re`` does this at a
    fraction of the cost of the JVM's regular expressions.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, digests, texts = [], [], []
            for i, value in enumerate(batch.column(2)):
                found = WORDS.findall(value.as_py().lower())
                if len(found) >= least:
                    text = " ".join(found if ordered else sorted(found))
                    keep.append(i)
                    texts.append(text)
                    digests.append(hashlib.md5(text.encode()).digest())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(digests, pa.binary()), pa.array(texts, pa.string())],
                names=["field", "def_id", "digest", "words"],
            )

    return stage


def slices_by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``most`` characters of a text column, or of one row."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < len(sizes):
        yield batch.slice(at)


def field_values(definitions: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, def_id, value): one row for every definition row and field with a value.

    The fields come out of one scan; rows with a null id or value drop out.
    """
    own = definitions.where(F.col("def_id").isNotNull()).select("def_id", *[value.alias(name) for name, value in fields.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("value")) for name in fields])
    return (
        spread(own)
        .select("def_id", F.explode(pairs).alias("_fv"))
        .select(F.col("_fv.field").alias("field"), "def_id", F.col("_fv.value").alias("value"))
        .where(F.col("value").isNotNull())
    )

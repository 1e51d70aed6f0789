"""Long exact spans that stand in more than one record: winnowed fingerprints route texts to suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonewright.kernels import kernel
from clonewright.plans.scratch import materialise

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a batch that is fingerprinted at once, so positions fit 20 bits.
_BATCH_CHARS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    padded = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    head = np.minimum.accumulate(padded, axis=1).reshape(-1)
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Winnower:
    """Of every run of ``span`` characters, the smallest hash of its ``gram``-character parts.

    Two runs that are equal pick the same part at the same place, so records
    that share a run share a fingerprint.
    """

    def __init__(self, span: int, gram: int):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        self.up, self.down = _powers(_BATCH_CHARS + span)

    def picks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, fingerprint, first run, last run): successive runs with one fingerprint make one row."""
        lengths = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_mixed((chars + np.uint64(1)) * _STEP) * self.up[: len(chars)], out=sums[1:])
        g = len(chars) - self.gram + 1
        grams = _mixed((sums[self.gram :] - sums[:g]) * self.down[:g])
        places = np.arange(g, dtype=np.uint64)
        least = _sliding_min((grams & ~np.uint64(0xFFFFF)) | places, self.window)
        at = (least & np.uint64(0xFFFFF)).astype(np.int64)
        ends = np.cumsum(lengths)
        text = np.repeat(np.arange(len(texts)), lengths)[: len(at)]
        inside = np.arange(len(at)) + self.span <= ends[text]
        start, at, text = np.nonzero(inside)[0], at[inside], text[inside]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(at)) - 1
        begin = (ends - lengths)[text[first]]
        return text[first], grams[at[first]], start[first] - begin, start[last] - begin


def _pieces(text: str, span: int) -> Iterator[tuple[int, str]]:
    """A text in pieces that overlap by ``span`` - 1, so every run lies in one piece."""
    size = _BATCH_CHARS // 2
    for at in range(0, max(1, len(text) - span + 1), size):
        yield at, text[at : at + size + span - 1]


def _fingerprint_stage(span: int, gram: int):
    """Rows (field, def_id, digest, value) to rows (field, rep, print, lo, hi); equal values of a task once."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(span, gram)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            number, prints, lo, hi = winnow.picks([r[3] for r in rows])
            shift = np.array([r[2] for r in rows])[number]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows]).take(pa.array(number)),
                    pa.array([r[1] for r in rows], pa.int64()).take(pa.array(number)),
                    pa.array(prints.view(np.int64)),
                    pa.array((lo + shift).astype(np.int32)),
                    pa.array((hi + shift).astype(np.int32)),
                ],
                names=["field", "rep", "print", "lo", "hi"],
            )

        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for field, rep, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for at, piece in _pieces(value.as_py(), span):
                    if held and chars + len(piece) > _BATCH_CHARS:
                        yield out(held)
                        held, chars = [], 0
                    held.append((field, rep, at, piece))
                    chars += len(piece)
        if held:
            yield out(held)

    return stage


def _explode_stage(span: int):
    """Contexts of hot fingerprints to rows (field, print, h1, h2, rep, start), one for each run."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, mark, rep, lo, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                n = len(text) - span + 1
                digests = [xxhash.xxh128_intdigest(text[i : i + span].encode("utf-8", "surrogatepass")) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([field] * n),
                        pa.array([mark] * n, pa.int64()),
                        pa.array(np.array([h >> 64 for h in digests], np.uint64).view(np.int64)),
                        pa.array(np.array([h & (2**64 - 1) for h in digests], np.uint64).view(np.int64)),
                        pa.array([rep] * n, pa.int64()),
                        pa.array(range(lo, lo + n), pa.int32()),
                    ],
                    names=["field", "print", "h1", "h2", "rep", "start"],
                )

    return stage


def shared_spans(values: DataFrame, span: int = 240, gram: int = 120, hot: int = 2000) -> DataFrame:
    """(field, def_id, n_chars, n_shared, n_spans): records with a run of ``span`` characters that another record holds.

    ``values`` has rows (field, def_id, value). ``n_shared`` counts the
    characters of the value that lie in such runs, ``n_spans`` the maximal
    stretches they make.

    Values are collapsed on a 128-bit digest first; a value of two records is
    shared as a whole. Each distinct value is winnowed to fingerprints of
    ``gram`` characters so that equal runs have an equal fingerprint. Only
    fingerprints of two values or more go on, with the text around them. The
    texts around one fingerprint are a shard: they form one suffix automaton, and
    each is read through it for matching statistics, which give the exact runs
    that another value holds. A value thus only passes the automata that it can
    share a run with, in place of all of them. A shard lies in one task only up
    to ``hot`` texts; the runs of hotter ones are hashed to
    128 bits and counted by a distributed aggregation instead, so no group
    grows with the data. Nulls and values shorter than ``span`` give no row.
    Several rows of one id with one value count once.
    """
    long_enough = values.where(F.length("value") >= span)
    digests = long_enough.select("field", "def_id", F.unhex(F.md5("value")).alias("digest"), F.length("value").alias("n_chars"))
    groups = digests.groupBy("digest", "field").agg(F.min("def_id").alias("rep"), F.max("def_id").alias("_last"))
    groups = groups.select("field", "digest", "rep", (F.col("rep") < F.col("_last")).alias("copied"))
    classes = materialise(digests.distinct().join(groups, ["digest", "field"]).select("field", "def_id", "rep", "copied", "n_chars"))
    reps = classes.select("field", F.col("rep").alias("def_id")).distinct()
    texts = materialise(long_enough.join(reps, ["def_id", "field"], "left_semi").dropDuplicates(["def_id", "field"]).select("field", "def_id", "value"))

    prints = materialise(texts.mapInArrow(_fingerprint_stage(span, gram), "field string, rep long, print long, lo int, hi int"))
    shared = (
        prints.groupBy("print", "field")
        .agg(F.min("rep").alias("_a"), F.max("rep").alias("_b"), F.count(F.lit(1)).alias("n"))
        .where(F.col("_a") < F.col("_b"))
        .select("field", "print", "n")
    )
    cut = F.expr(f"substring(value, lo + 1, hi - lo + {span})")
    around = (
        prints.join(shared, ["print", "field"])
        .join(texts.withColumnRenamed("def_id", "rep"), ["rep", "field"])
        .select("field", "print", "rep", "lo", cut.alias("text"), "n")
    )
    around = materialise(around)
    cool = around.where(F.col("n") <= hot).select("field", "print", "rep", "lo", "text")
    shared_runs = kernel(values.sparkSession, "SharedRuns", "array<struct<rep:bigint,start:int,end:int>>", Path(__file__).parent)
    shards = cool.groupBy("print", "field").agg(F.collect_list(F.struct("rep", F.col("lo").cast("long").alias("lo"), "text")).alias("s"))
    found = shards.select("field", F.inline(shared_runs(F.col("s.rep"), F.col("s.lo"), F.col("s.text"), F.lit(span))))
    runs = around.where(F.col("n") > hot).select("field", "print", "rep", "lo", "text")
    runs = runs.mapInArrow(_explode_stage(span), "field string, print long, h1 long, h2 long, rep long, start int")
    key = ["h1", "h2", "print", "field"]
    twice = runs.groupBy(*key).agg(F.min("rep").alias("_a"), F.max("rep").alias("_b")).where(F.col("_a") < F.col("_b")).select(*key)
    found_hot = runs.join(twice, key).select("field", "rep", "start", (F.col("start") + span).alias("end"))
    stretches = _merged(found.unionByName(found_hot))
    whole = classes.where("copied").select("field", "def_id", "n_chars", F.col("n_chars").cast("long").alias("n_shared"), F.lit(1).cast("long").alias("n_spans"))
    single = (
        classes.where(~F.col("copied"))
        .join(stretches.withColumnRenamed("rep", "def_id"), ["def_id", "field"])
        .select("field", "def_id", "n_chars", "n_shared", "n_spans")
    )
    return whole.unionByName(single)


def _merged(runs: DataFrame) -> DataFrame:
    """(field, rep, n_shared, n_spans) of the union of each value's runs; their number is bounded by its length."""
    before = Window.partitionBy("rep", "field").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    steps = runs.withColumn("reach", reach).select(
        "field",
        "rep",
        F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach")).alias("more"),
        (F.col("start") > F.col("reach")).cast("int").alias("new"),
    )
    return steps.groupBy("rep", "field").agg(F.sum("more").alias("n_shared"), F.sum("new").alias("n_spans"))

"""Near-duplicate records: MinHash banding, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonewright.operators.graph import smallest_label
from clonewright.plans.scratch import discard, materialise

from .common import slices_by_size, words_stage


def miss_chance(similarity: float, bands: int, rows: int) -> float:
    """Chance that two records of this similarity share no band."""
    return (1 - similarity**rows) ** bands


def choose_bands(threshold: float, recall: float, rows: int = 4) -> int:
    """The smallest number of bands of ``rows`` hashes that finds a pair at the threshold with chance ``recall``."""
    bands = 1
    while miss_chance(threshold, bands, rows) > 1 - recall:
        bands += 1
    return bands


class Signer:
    """MinHash bands of word-run sets, many texts at a time."""

    def __init__(self, run: int, rows: int, bands: int, sketch_bits: int = 64, seed: int = 20240229):
        self.run, self.rows, self.bands, self.bits = run, rows, bands, sketch_bits
        draw = np.random.default_rng(seed)
        k = rows * bands + sketch_bits
        self.mul = draw.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, k, dtype=np.uint64)
        self.mix = draw.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = draw.integers(1, 2**63, run, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words: dict[str, int] = {}

    def _word_hashes(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 1_000_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def sign(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(band keys, sketches, set sizes) of texts of at least ``run`` words joined by single spaces."""
        split = [t.split(" ") for t in texts]
        counts = np.array([len(w) for w in split])
        flat = self._word_hashes([w for ws in split for w in ws])
        n = len(flat) - self.run + 1
        runs = np.zeros(n, np.uint64)
        for j in range(self.run):  # a word's place in the run matters
            runs += (flat[j : j + n] ^ (flat[j : j + n] >> np.uint64(29))) * self.place[j]
            runs ^= runs >> np.uint64(31)
        ends = np.cumsum(counts)
        own = np.ones(n, bool)
        for j in range(1, self.run):  # runs that cross into the next text
            own[ends[:-1] - j] = False
        runs = runs[own]
        lengths = counts - self.run + 1
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        mins = np.empty((len(self.mul), len(texts)), np.uint64)
        for k in range(len(self.mul)):
            mins[k] = np.minimum.reduceat(runs * self.mul[k] + self.add[k], starts)
        keys = np.zeros((self.bands, len(texts)), np.uint64)
        for r in range(self.rows):
            part = mins[r : self.rows * self.bands : self.rows]
            keys = (keys ^ (part ^ (part >> np.uint64(32)))) * self.mix[r]
        keys ^= keys >> np.uint64(30)
        keys += np.arange(self.bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        bits = (mins[self.rows * self.bands :] >> np.uint64(33)) & np.uint64(1)
        sketch = (bits << np.arange(self.bits, dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64)
        sizes = _distinct_per_text(runs, lengths)
        return keys.T.view(np.int64), sketch.view(np.int64), sizes


def _distinct_per_text(runs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((runs, text))
    r, t = runs[order], text[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[first], minlength=len(lengths)).astype(np.int32)


def _sign_stage(run: int, rows: int, bands: int):
    """Batches of (rep, words) to rows (rep, n_runs, sketch, keys)."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(run, rows, bands)
        names = ["field", "def_id", "n_runs", "sketch", "keys"]
        for batch in batches:
            for part in slices_by_size(batch, 2, 1 << 20):
                keys, sketch, sizes = signer.sign(part.column(2).to_pylist())
                flat = pa.array(np.ascontiguousarray(keys).reshape(-1))
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(sketch), pa.ListArray.from_arrays(offsets, flat)], names=names
                )

    return stage


def _verify_stage(run: int):
    """Rows with two word texts, to rows (field, a, b, common, either)."""

    def runs_of(words: str) -> set[tuple[str, ...]]:
        w = words.split(" ")
        return set(zip(*[w[j:] for j in range(run)], strict=False))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            common, either = [], []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if a != last:
                    last, left = a, runs_of(a)
                right = runs_of(b)
                both = len(left & right)
                common.append(both)
                either.append(len(left) + len(right) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(common, pa.int32()), pa.array(either, pa.int32())],
                names=["field", "a", "b", "common", "either"],
            )

    return stage


class NearDuplicates:
    """Classes of equal word sequences, and pairs of classes above the threshold.

    ``classes``: (field, def_id, rep), one row per record with at least
    ``min_words`` words; ``rep`` is the smallest id with the same words.
    ``pairs``: (field, a, b, common, either) of representatives ``a < b``.

    Copies collapse on a 128-bit digest with map-side combining, so only
    representatives are signed, banded and compared. Band rows join on the band
    key with themselves; the size of both sets and a 64-bit one-bit MinHash
    sketch are compared in the join, so pairs that cannot reach the threshold
    never leave it (a pair right at the threshold fails the sketch with a chance
    of 1 in 23,000 at 0.6 and 1 in 7,400 at 0.8, beside the chance of 1 - ``recall`` to share no band;
    both fall fast above it). A hot band is an ordinary skewed equi-join that adaptive
    execution splits. Candidates are verified on their full sets of word runs.
    Null values give no row; several rows of one id count once if their words
    agree, and each of their values counts if not.
    """

    def __init__(self, values: DataFrame, run: int = 5, threshold: float = 0.8, min_words: int = 5, recall: float = 0.995, rows: int = 4):
        bands = choose_bands(threshold, recall, rows)
        # a one-bit MinHash agrees with chance (1 + s) / 2; four deviations of slack
        likely = (1 + threshold) / 2
        least_bits = int(64 * likely - 4 * (64 * likely * (1 - likely)) ** 0.5)
        # written once: later steps read the digests or the words of it, never the values again
        words = materialise(values.mapInArrow(words_stage(max(min_words, run)), "field string, def_id long, digest binary, words string"))
        digests = words.select("field", "def_id", "digest")
        first = digests.groupBy("digest", "field").agg(F.min("def_id").alias("rep"))
        self.classes = materialise(digests.join(first, ["digest", "field"]).select("field", "def_id", "rep").distinct())
        reps = self.classes.select("field", F.col("rep").alias("def_id")).distinct()
        texts = words.select("field", "def_id", "words").join(reps, ["def_id", "field"], "left_semi")
        self.texts = materialise(texts.dropDuplicates(["def_id", "field"]).select("field", "def_id", "words"))
        discard(words)
        signed = self.texts.mapInArrow(
            _sign_stage(run, rows, bands), "field string, def_id long, n_runs int, sketch long, keys array<long>"
        )
        banded = signed.select("field", F.col("def_id").alias("id"), "n_runs", "sketch", F.explode("keys").alias("key"))
        left = banded.select("field", "key", *[F.col(c).alias(c + "_a") for c in ("id", "n_runs", "sketch")])
        right = banded.select("field", "key", *[F.col(c).alias(c + "_b") for c in ("id", "n_runs", "sketch")])
        near = (
            (F.col("id_a") < F.col("id_b"))
            & (F.least("n_runs_a", "n_runs_b") >= F.greatest("n_runs_a", "n_runs_b") * threshold)
            & (F.lit(64) - F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) >= least_bits)
        )
        candidates = left.join(right, ["key", "field"]).where(near).select("field", F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
        text_a = self.texts.select("field", F.col("def_id").alias("a"), F.col("words").alias("words_a"))
        text_b = self.texts.select("field", F.col("def_id").alias("b"), F.col("words").alias("words_b"))
        both = candidates.join(text_a, ["a", "field"]).join(text_b, ["b", "field"]).select("field", "a", "b", "words_a", "words_b")
        checked = both.mapInArrow(_verify_stage(run), "field string, a long, b long, common int, either int")
        self.pairs = materialise(checked.where(F.col("common") >= F.col("either") * threshold))

    def record_pairs(self) -> DataFrame:
        """(field, def_id_a, def_id_b): every pair of records, copies written out by equi-joins on the classes."""
        a = self.classes.select("field", F.col("rep").alias("a"), F.col("def_id").alias("da"))
        b = self.classes.select("field", F.col("rep").alias("b"), F.col("def_id").alias("db"))
        across = self.pairs.join(a, ["a", "field"]).join(b, ["b", "field"]).where(F.col("da") != F.col("db"))
        across = across.select("field", F.least("da", "db").alias("def_id_a"), F.greatest("da", "db").alias("def_id_b"))
        same = a.join(b.withColumnRenamed("b", "a"), ["a", "field"]).where(F.col("da") < F.col("db"))
        return across.unionByName(same.select("field", F.col("da").alias("def_id_a"), F.col("db").alias("def_id_b"))).distinct()

    def clusters(self) -> DataFrame:
        """(field, def_id, cluster, n_links): the smallest id linked directly or through others, and the number of other records linked directly."""
        parts = []
        sizes = self.classes.groupBy("rep", "field").agg(F.count(F.lit(1)).alias("n_class"))
        ends = self.pairs.select("field", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        others = (
            ends.select("field", F.col("e.a").alias("id"), F.col("e.b").alias("rep"))
            .join(sizes, ["rep", "field"])
            .groupBy("field", F.col("id").alias("rep"))
            .agg(F.sum("n_class").alias("n_other"))
        )
        for (field,) in self.pairs.select("field").distinct().collect():
            parts.append(smallest_label(self.pairs.where(F.col("field") == field).select("a", "b")).select(F.lit(field).alias("field"), F.col("id").alias("rep"), "label"))
        out = self.classes.join(sizes, ["rep", "field"]).join(others, ["rep", "field"], "left")
        out = out.withColumn("n_links", F.col("n_class") - 1 + F.coalesce("n_other", F.lit(0)))
        if not parts:
            return out.select("field", "def_id", F.col("rep").alias("cluster"), "n_links")
        labels = parts[0]
        for more in parts[1:]:
            labels = labels.unionByName(more)
        return out.join(labels, ["rep", "field"], "left").select("field", "def_id", F.coalesce("label", "rep").alias("cluster"), "n_links")

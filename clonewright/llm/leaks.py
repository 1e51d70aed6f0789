"""Evaluation passages inside corpus documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonewright.plans.partitions import heavy_tasks, spread
from clonewright.plans.scratch import discard, materialise

WORD = re.compile("[A-Za-z0-9]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of ASCII letters and digits, in lower case."""
    return [w.lower() for w in WORD.findall(text or "")]


class Hasher:
    """64-bit hashes of words, remembered up to ``most`` of them, and of runs of words."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def words(self, own: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(own).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))

    def runs(self, own: list[str], n: int) -> np.ndarray:
        """One hash for each run of ``n`` successive words."""
        hashes = self.words(own)
        places = len(hashes) - n + 1
        if places <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(places, np.uint64)
        for j in range(n):
            out = (out ^ (out >> np.uint64(29)) ^ hashes[j : j + places]) * _STEP
        return out


class NgramSet:
    """The hash set of all runs of ``n`` words of the items, and where they stand: flat arrays, some 16 bytes a run."""

    def __init__(self, items: list[tuple[int, str]], n: int = 13):
        self.n = n
        hasher = Hasher()
        split = [(i, words(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if len(w) >= n]
        runs = [hasher.runs(w, n) for _, w in self.items]
        hashes = np.concatenate([np.empty(0, np.uint64), *runs])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owner = np.repeat(np.arange(len(runs), dtype=np.int32), [len(r) for r in runs])[order] if runs else np.empty(0, np.int32)
        self.place = np.concatenate([np.empty(0, np.int32), *[np.arange(len(r), dtype=np.int32) for r in runs]])[order]

    def spans(self, text: str | None, hasher: Hasher) -> Iterator[tuple[int, int, int]]:
        """(item_id, first word, last word + 1) of each maximal run of at least ``n`` words shared with an item."""
        own = words(text)
        runs = hasher.runs(own, self.n)
        low = np.searchsorted(self.hashes, runs, "left")
        found = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == runs) if len(self.hashes) else np.empty(0, np.int64)
        if not len(found):
            return
        hits = np.searchsorted(self.hashes, runs[found], "right") - low[found]
        at = np.repeat(found, hits)
        where = np.repeat(low[found], hits) + np.arange(len(at)) - np.repeat(np.cumsum(hits) - hits, hits)
        owner, place = self.owner[where].astype(np.int64), self.place[where].astype(np.int64)
        # hits of one item on one diagonal in a row are one span; its words are compared, not only their hashes
        order = np.lexsort((at, at - place, owner))
        at, place, owner = at[order], place[order], owner[order]
        first = np.ones(len(at), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)
        starts = np.flatnonzero(first)
        for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True):
            item_id, theirs = self.items[owner[s]]
            a, p, k = int(at[s]), int(place[s]), int(e - s) + self.n - 1
            yield from ((item_id, x, y) for x, y in _equal_stretches(own, theirs, a, p, k, self.n))


def _equal_stretches(own: list[str], theirs: list[str], a: int, p: int, k: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``n`` equal words of two runs of ``k`` words; with equal hashes the whole run, barring a collision."""
    if k < n:
        return
    if own[a : a + k] == theirs[p : p + k]:
        yield a, a + k
        return
    start = 0
    for i in range(k + 1):
        if i == k or own[a + i] != theirs[p + i]:
            if i - start >= n:
                yield a + start, a + i
            start = i + 1


_SPAN = "doc_id long, item_id long, first_word int, n_words int"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "first_word", "n_words"])


def leaked(documents: DataFrame, items: DataFrame, n: int = 13, most_characters: int = 30_000_000) -> DataFrame:
    """(doc_id, item_id, first_word, n_words): every maximal shared run of at least ``n`` words.

    Items of up to ``most_characters`` in all are broadcast as a hash set of
    their runs of ``n`` words, at most half a gigabyte; the corpus is scanned
    once, text and id only, with no shuffle, and the words of every hit are
    compared. Larger item sets meet the corpus in a join of sampled runs
    instead (``leaked_by_join``), with the same rows. Null and empty texts, and
    items of fewer than ``n`` words, share nothing. Repeated rows of a document
    give their rows once; several texts under one id give the rows of each.
    """
    spark = documents.sparkSession
    own = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    if (own.agg(F.sum(F.length("text"))).first()[0] or 0) > most_characters:
        return leaked_by_join(rows, own, n)
    index = spark.sparkContext.broadcast(NgramSet([tuple(r) for r in own.collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, hasher = index.value, Hasher()
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(doc, item, a, b - a) for item, a, b in find.spans(text.as_py(), hasher)]
            yield _span_batch(out)

    return spread(rows).mapInArrow(scan, _SPAN).distinct()


def _sampled_runs(run: int, window: int):
    """Rows (id, text) to rows (hash, id, place): of every ``window`` successive runs of ``run`` words the one with the smallest hash."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, hashes, places = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = hasher.runs(words(text.as_py()), run)
                if len(runs) >= window:
                    views = np.lib.stride_tricks.sliding_window_view(runs, window)
                    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
                    ids.append(np.full(len(at), key, np.int64))
                    hashes.append(runs[at].view(np.int64))
                    places.append(at.astype(np.int32))
            flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, np.int64), (ids, np.int64), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["hash", "id", "place"])

    return stage


def _verify_stage(n: int):
    """Rows (doc_id, item_id, diagonal, text, item_text) to spans; a document's words are found once while its rows follow each other."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, item, diagonal, text, passage in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if text != last:
                    last, own = text, words(text)
                theirs = words(passage)
                a = max(0, diagonal)
                p = a - diagonal
                k = min(len(own) - a, len(theirs) - p)
                out += [(doc, item, x, y - x) for x, y in _equal_stretches(own, theirs, a, p, k, n)]
            yield _span_batch(out)

    return stage


def leaked_by_join(documents: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """The rows of ``leaked`` without a broadcast, for item sets of any size.

    Of every run of ``n`` words, the part of ``n // 2 + 1`` words with the
    smallest hash is sampled on both sides, so equal runs share a part and
    about a quarter of the places are shuffled, as numbers. Parts meet in an
    equi-join, which adaptive execution splits where a part is hot; what meets
    is reduced to (document, item, diagonal), and only then are texts fetched
    and the diagonals compared word by word.
    """
    run = n // 2 + 1
    schema = "hash long, id long, place int"
    theirs = items.select("item_id", "text").mapInArrow(_sampled_runs(run, n - run + 1), schema)
    mine = spread(documents).mapInArrow(_sampled_runs(run, n - run + 1), schema)
    met = mine.select("hash", F.col("id").alias("doc_id"), F.col("place").alias("a")).join(
        theirs.select("hash", F.col("id").alias("item_id"), F.col("place").alias("b")), "hash"
    )
    diagonals = materialise(met.select("doc_id", "item_id", (F.col("a") - F.col("b")).alias("diagonal")).distinct())
    both = diagonals.join(documents, "doc_id").join(items.select("item_id", F.col("text").alias("passage")), "item_id")
    both = both.select("doc_id", "item_id", "diagonal", "text", "passage").repartition(heavy_tasks(documents.sparkSession), "doc_id")
    found = materialise(both.sortWithinPartitions("doc_id", "item_id").mapInArrow(_verify_stage(n), _SPAN).distinct())
    discard(diagonals)
    return found


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that share no passage with any item, whole rows as they were."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def _cut_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to rows (doc_id, text, n_removed): the words of all spans cut out, with what stands between them."""
    for batch in batches:
        texts, removed = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at = [m.span() for m in WORD.finditer(text)] if spans else []
            kept, last, n = [], 0, 0
            done = 0
            for first, length in sorted((s["first_word"], s["n_words"]) for s in spans or ()):
                begin, end = max(first, done), first + length
                if begin < end:
                    kept.append(text[last : at[begin][0]])
                    last, n, done = at[end - 1][1], n + end - begin, end
            texts.append("".join([*kept, text[last:]]))
            removed.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "n_removed"])


def without_spans(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed): every document with the words of its leaked spans cut out; ids and texts that are null are left out.

    Only a document's own spans are gathered, no more than its words allow.
    """
    spans = leaks.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans"))
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.join(spans, "doc_id", "left").mapInArrow(_cut_stage, "doc_id long, text string, n_removed int")

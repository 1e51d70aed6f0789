"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonewright.plans.scratch import discard, materialise


#: Edges of a graph, or of what is left of one, whose rounds are run inside one task: 1.6 MB.
AT_ONCE = 100_000


def smallest_label(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges`` (columns ``a``, ``b`` of bigint): the smallest id it is linked to.

    Each round hooks every vertex to its smallest neighbour (minimum label
    propagation), doubles the hooks until each reaches its root (pointer
    jumping) and contracts the graph to the roots. Roots are never adjacent
    vertices, so the vertices with edges at least halve each round, and a chain
    of any length takes log2 of its length in jumps. Every step is written to
    the shared folder. Once no more than ``AT_ONCE`` edges are left, the same
    rounds run on arrays inside one task, which spares their jobs. Hooks are found with partial aggregation, and labels
    are put together from the rounds' shrinking tables at the end, so a hub that
    a third of all edges share is no single task's work. Edges with a null end,
    loops and repeated edges link nothing new; ids that have only loops are kept.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ids = clean.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    live = materialise(_canonical_edges(clean, F.col("a"), F.col("b")))
    rounds: list[DataFrame] = []
    while (left_over := live.count()) > 0:
        if left_over <= AT_ONCE:
            rounds.append(materialise(live.coalesce(1).mapInArrow(_rounds_at_once, "v long, to long")))
            break
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = F.least(F.min("e.b"), F.col("v")).alias("to")
        roots = _jumped(live.select(both.alias("e")).groupBy(F.col("e.a").alias("v")).agg(least))
        left = roots.select(F.col("v").alias("a"), F.col("to").alias("to_a"))
        right = roots.select(F.col("v").alias("b"), F.col("to").alias("to_b"))
        contracted = materialise(_canonical_edges(live.join(left, "a").join(right, "b"), F.col("to_a"), F.col("to_b")))
        discard(live)
        rounds.append(roots)
        live = contracted
    discard(live)
    labels: DataFrame | None = None
    for pointers in reversed(rounds):  # each round's table is at most half as long as the one before
        labels = pointers if labels is None else _follow(pointers, labels)
    found = ids.withColumn("to", F.col("v"))
    found = found if labels is None else _follow(found, labels)
    return found.select(F.col("v").alias("id"), F.col("to").alias("label"))


def _rounds_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (v, to): minimum labels across edges, then pointer jumping, until no label changes."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ends = np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]) if held else np.empty(0, np.int64)
    ids, place = np.unique(ends, return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        onward = label.copy()
        # a root takes the least label that any of its own members meets
        np.minimum.at(onward, label[a], least)
        np.minimum.at(onward, label[b], least)
        while not np.array_equal(onward, onward[onward]):
            onward = onward[onward]
        if np.array_equal(onward[label], label):
            break
        label = onward[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], names=["v", "to"])


def _jumped(hooks: DataFrame) -> DataFrame:
    """Pointers (v, to) doubled, twice in each written step, until every one ends at a root."""
    pointers = materialise(hooks)
    while True:
        twice = _doubled(pointers)
        fourth = _doubled(twice).withColumnRenamed("to", "end")
        ahead = materialise(twice.join(fourth, "v").select("v", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        discard(pointers)
        if ahead.where("moved").isEmpty():
            return ahead
        pointers = ahead


def _doubled(pointers: DataFrame) -> DataFrame:
    """Each pointer moved on to where its target points."""
    onward = pointers.select(F.col("v").alias("to"), F.col("to").alias("onward"))
    return pointers.select("v", "to").join(onward, "to").select("v", F.col("onward").alias("to"))


def _follow(pointers: DataFrame, labels: DataFrame) -> DataFrame:
    """Pointers with their targets replaced by the targets' labels, where they have one."""
    found = labels.select(F.col("v").alias("to"), F.col("to").alias("label"))
    return pointers.join(found, "to", "left").select("v", F.coalesce("label", "to").alias("to"))


def _canonical_edges(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    return (
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") < F.col("b")).distinct()
    )

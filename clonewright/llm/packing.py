"""Filling containers of fixed capacity with texts measured in tokens."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonewright.plans.partitions import spread
from clonewright.plans.scratch import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of that byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """A tokenizer from a file of base64 tokens and ranks; its special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, part): the length of each text; null texts have none. One scan, no shuffle."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return spread(rows).mapInArrow(stage, "doc_id long, n_tokens long").withColumn("part", F.spark_partition_id())


def length_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in all.

    ``lengths`` rise; padding is the bound less the length, summed over items.
    Dynamic programming over the histogram, exact: the cost of a bucket that
    begins after length i is a line in its bound, so each step keeps the lower
    envelope of those lines and costs a number of operations proportional to
    the number of lengths.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    size = [int(x) for x in lengths]
    items, tokens = [0], [0]
    for x, c in zip(size, counts.tolist(), strict=True):
        items.append(items[-1] + c)
        tokens.append(tokens[-1] + c * x)
    best = [0] + [size[j - 1] * items[j] - tokens[j] for j in range(1, n + 1)]
    cuts: list[array] = []
    for _ in range(1, buckets):
        after, cut = [0] * (n + 1), array("l", [0]) * (n + 1)
        lines: list[int] = []  # starts i of the envelope, steepest last; cost best[i] + tokens[i] - bound * items[i]
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            height = best[i] + tokens[i]
            while len(lines) - at >= 2:
                p, q = lines[-2], lines[-1]
                hp, hq = best[p] + tokens[p], best[q] + tokens[q]
                # q never lies lowest if i overtakes p no later than q does
                if (height - hp) * (items[q] - items[p]) <= (hq - hp) * (items[i] - items[p]):
                    lines.pop()
                else:
                    break
            lines.append(i)
            x = size[j - 1]
            while len(lines) - at >= 2 and best[lines[at + 1]] + tokens[lines[at + 1]] - x * items[lines[at + 1]] <= best[lines[at]] + tokens[lines[at]] - x * items[lines[at]]:
                at += 1
            i = lines[at]
            after[j], cut[j] = best[i] + tokens[i] - x * items[i] + x * items[j] - tokens[j], i
        best = after
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(size[j - 1])
        j = cut[j]
    if j:
        bounds.append(size[j - 1])
    return np.array(bounds[::-1])


def fill_plan(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (bucket, first item, end item, first container, items per container) for the items of each bucket.

    Buckets go from long to short. Items first fill the containers whose free
    room fits them closest, then open new ones with as many as fit. Containers
    that hold the same are treated as one entry with a count, so the work
    depends on the number of buckets, not of items.
    """
    open_groups: list[list[int]] = []  # free room, first container, number of containers
    slots: list[tuple[int, int, int, int, int]] = []
    used = 0
    for b in sorted(range(len(bounds)), key=lambda b: -bounds[b]):
        size, left, placed = bounds[b], counts[b], 0
        while left:
            fitting = [g for g in open_groups if g[0] >= size]
            if fitting:
                group = min(fitting, key=lambda g: (g[0], g[1]))
                each = group[0] // size
            else:
                each = capacity // size
                group = [capacity, used, -(-left // each)]
                used += group[2]
                open_groups.append(group)
            whole = min(group[2], left // each)
            if whole:
                slots.append((b, placed, placed + whole * each, group[1], each))
                placed, left = placed + whole * each, left - whole * each
                _take(open_groups, group, whole, each * size)
            elif left:
                slots.append((b, placed, placed + left, group[1], left))
                _take(open_groups, group, 1, left * size)
                placed, left = placed + left, 0
        open_groups = [g for g in open_groups if g[0] >= min(bounds)]
    return slots


def _take(groups: list[list[int]], group: list[int], containers: int, tokens: int) -> None:
    """Use ``tokens`` of the room of the first ``containers`` of a group."""
    room, first, number = group
    groups.append([room - tokens, first, containers])
    if containers == number:
        groups.remove(group)
    else:
        group[1], group[2] = first + containers, number - containers


class Packing:
    """Containers for every capacity in ``limits`` (limit_id, capacity).

    ``placed``: (limit_id, capacity, container_id, doc_id, first_token,
    n_tokens). A text is one item, or, only if it is longer than the capacity,
    pieces of the capacity and one rest.

    Lengths are counted into one histogram per capacity, of as many lengths as
    the capacity has tokens; dynamic programming chooses the length
    buckets with the least padding, and containers are filled from the buckets
    by counts alone. Each item then finds its place by its rank in its bucket,
    made of counts per partition and a rank within the partition, so a bucket
    that holds most items is no single task's work. Texts without tokens take
    no place. Capacities must be positive; others, and nulls, are left out.

    ``padding``: what the buckets pad in all; ``alone``: the containers it would
    take if each were filled from one bucket only.
    """

    def __init__(self, sizes: DataFrame, limits: DataFrame, buckets: int = 96):
        spark = sizes.sparkSession
        caps = [tuple(r) for r in limits.select("limit_id", "capacity").distinct().collect() if r[1] and r[1] > 0 and r[0] is not None]
        self.sizes = sizes
        self.capacities = caps
        kinds = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in caps or [(0, 1)]])
        full = F.floor(F.col("n_tokens") / F.col("capacity"))
        rest = F.col("n_tokens") % F.col("capacity")
        pieces = F.transform(
            F.sequence(F.lit(0).cast("long"), full),
            lambda k: F.struct((k * F.col("capacity")).alias("first_token"), F.when(k < full, F.col("capacity")).otherwise(rest).alias("n_tokens")),
        )
        items = (
            sizes.where((F.col("n_tokens") > 0) & F.lit(bool(caps)))
            .select("*", F.inline(kinds))
            .select("limit_id", "capacity", "doc_id", "part", F.explode(pieces).alias("p"))
            .select("limit_id", "capacity", "doc_id", "part", "p.first_token", "p.n_tokens")
            .where(F.col("n_tokens") > 0)
        )
        items = items.withColumn("length", F.col("n_tokens").cast("long"))
        histogram = items.groupBy("limit_id", "length").agg(F.count(F.lit(1)).alias("n")).collect()
        bucket_rows: list[tuple[int, int, int]] = []
        slot_rows: list[tuple[int, int, int, int, int, int]] = []
        self.padding: dict[int, int] = {}
        self.alone: dict[int, int] = {}
        for limit_id, capacity in caps:
            own = sorted((r.length, r.n) for r in histogram if r.limit_id == limit_id)
            if not own:
                continue
            lengths, counts = np.array([x for x, _ in own]), np.array([n for _, n in own])
            bounds = length_buckets(lengths, counts, buckets)
            at = np.searchsorted(bounds, lengths)
            self.padding[limit_id] = int(((bounds[at] - lengths) * counts).sum())
            per = np.bincount(at, weights=counts, minlength=len(bounds)).astype(int).tolist()
            self.alone[limit_id] = sum(-(-n // (capacity // bound)) for n, bound in zip(per, bounds.tolist(), strict=True))
            bucket_rows += [(limit_id, int(x), int(b)) for x, b in zip(lengths, at, strict=True)]
            slot_rows += [(limit_id, *s) for s in fill_plan(bounds.tolist(), per, capacity)]
        bucket_of = spark.createDataFrame(bucket_rows, "limit_id int, length long, bucket int")
        slots = spark.createDataFrame(slot_rows, "limit_id int, bucket int, lo long, hi long, container long, each long")
        items = items.join(F.broadcast(bucket_of), ["limit_id", "length"]).drop("length")
        here = Window.partitionBy("limit_id", "bucket", "part").orderBy("doc_id", "first_token")
        ranked = items.withColumn("k", F.row_number().over(here) - 1)
        counted = items.groupBy("limit_id", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("limit_id", "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counted.select("limit_id", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        placed = ranked.join(offsets, ["limit_id", "bucket", "part"]).withColumn("rank", F.col("k") + F.col("offset"))
        inside = (
            (placed["limit_id"] == slots["limit_id"]) & (placed["bucket"] == slots["bucket"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        )
        container = F.col("container") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))
        self.placed = placed.join(F.broadcast(slots), inside).select(
            placed["limit_id"], "capacity", container.alias("container_id"), "doc_id", "first_token", "n_tokens"
        )


def packing(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> Packing:
    """``Packing`` of the texts of ``documents``; each text is tokenised once."""
    return Packing(materialise(token_counts(documents, tokenizer)), limits)


def pack(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The containers of ``packing``."""
    return packing(documents, limits, tokenizer).placed


def fill_beside_buckets(made: Packing) -> DataFrame:
    """``fill``, and how full containers would be if each took from one length bucket only."""
    alone = made.sizes.sparkSession.createDataFrame(list(made.alone.items()), "limit_id int, bucket_containers long")
    filled = fill(made.placed).join(F.broadcast(alone), "limit_id")
    return filled.withColumn("bucket_filled", F.round(F.col("n_tokens") / (F.col("bucket_containers") * F.col("capacity")), 6))


def fill(placed: DataFrame) -> DataFrame:
    """(limit_id, capacity, n_items, n_tokens, n_containers, least_containers, filled) of each capacity.

    ``least_containers`` is the tokens over the capacity, rounded up: no packing can do with fewer.
    """
    boxes = placed.groupBy("limit_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    return boxes.groupBy("limit_id", "capacity").agg(
        F.sum("i").alias("n_items"),
        F.sum("t").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("t") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("filled"),
    )

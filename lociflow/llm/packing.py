"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

A text longer than the capacity is cut into full pieces and a rest; nothing else is split. The pieces are planned
by best fit, longest first, over the histogram of lengths instead of over the pieces: a group of containers with
equal room takes pieces of a length all at once. The plan says for each length which ranks go to which containers;
each piece then finds its place by its rank within its length.

Scale: only the histogram reaches the driver, at most one row per length up to the capacity, and the plan has at
most a few rows per length. Ranks are counted in hash buckets with an offset each, as many as the pieces
need, so a length that a third of all pieces have is no single task. Texts are tokenised once for all capacities.

Defined results: texts without tokens (null or empty) need no room and come out with a null container; every
other token of every document is in exactly one container; equal texts are separate pieces; the same input gives
the same plan; no container holds more than its capacity; an empty table gives an empty result; a capacity below
one is refused; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.session import cut

#: Where the vocabulary (lines of a base64 token and its rank) lies on every worker.
VOCABULARY = os.environ.get("LOCIFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How a text is split before the merges of this vocabulary. Fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_PIECES = 250_000  # about so many pieces are ranked in one group


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(code.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(length, first rank, first container, pieces per container) by length and rank; the number of containers."""
    plan: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first container, how many)
    order: list[int] = []  # the keys of room, ascending
    made = 0

    def leave(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in room:
                room[free] = []
                bisect.insort(order, free)
            room[free].append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                free = order[at]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
                    order.pop(at)
            else:
                free, first, many = capacity, made, -(-left // (capacity // length))
                made += many
            each = free // length
            whole = min(many, left // each)
            if whole:
                plan.append((length, rank, first, each))
                rank, left = rank + whole * each, left - whole * each
                leave(free - each * length, first, whole)
                first, many = first + whole, many - whole
            if left and many:  # fewer are left than one container takes
                plan.append((length, rank, first, each))
                leave(free - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            leave(free, first, many)
    return sorted(plan), made


def pack(counts: DataFrame, capacity: int) -> DataFrame:
    """container, doc_id, piece, n_tokens of every piece of counts (doc_id, n_tokens)."""
    if capacity < 1:
        raise ValueError("a container must hold a token")
    n, c = F.col("n_tokens"), F.lit(capacity)
    made = counts.agg(F.coalesce(F.sum(F.ceil(n / c)), F.lit(0))).first()[0]
    buckets = max(1, -(-made // BUCKET_PIECES))
    pieces = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / c).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(c, n - F.col("piece") * c).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("bucket"))
    sizes = pieces.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("k"))  # at most capacity rows for each bucket
    histogram = {r.n_tokens: r.k for r in sizes.groupBy("n_tokens").agg(F.sum("k").alias("k")).collect()}
    plan, _ = best_fit(histogram, capacity)
    lengths, ranks, firsts, each = (np.array(x, np.int64) for x in (zip(*plan) if plan else ((), (), (), ())))

    before = sizes.select("n_tokens", "bucket", (F.sum("k").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("k")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("inside", inside).join(before, ["n_tokens", "bucket"]).select("doc_id", "piece", "n_tokens", (F.col("inside") + F.col("before")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column("n_tokens")), np.asarray(b.column("rank"))
            lo, hi = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
            while (open_ := hi - lo > 1).any():  # the last plan row of the length that does not begin after the rank
                mid = (lo + hi) >> 1
                below = ranks[np.minimum(mid, len(ranks) - 1)] <= rank
                lo, hi = np.where(open_ & below, mid, lo), np.where(open_ & ~below, mid, hi)
            container = firsts[lo] + (rank - ranks[lo]) // each[lo]
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column("doc_id"), b.column("piece"), b.column("n_tokens")], names=["container", "doc_id", "piece", "n_tokens"])

    placed = ranked.mapInArrow(run, "container bigint, doc_id bigint, piece int, n_tokens bigint")
    nothing = counts.where("n_tokens = 0").select(F.lit(None).cast("long").alias("container"), "doc_id", F.lit(0).alias("piece"), "n_tokens")
    return placed.unionByName(nothing)


def pack_all(docs: DataFrame, capacities: dict[str, int], vocabulary: str = VOCABULARY) -> DataFrame:
    """size_name and pack() of each capacity. The capacities are a short configured list."""
    counts = cut(token_counts(docs, vocabulary))
    out = None
    for name, capacity in sorted(capacities.items()):
        one = pack(counts, capacity).select(F.lit(name).alias("size_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out

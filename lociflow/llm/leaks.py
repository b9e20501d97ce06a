"""Test items that documents contain, wholly or partly: suffix arrays of the training text.

Documents are read in shards of a bounded number of words. A shard is an array of word numbers, in which only words
of the test items have a number; its runs of known words make a suffix array, sorted by prefix doubling to the
length of the longest item. Every suffix of every test item is searched in it by binary search, word by word, to its
full length: the intervals give each place where the suffix stands and the longest match there. A place whose word
before also matches belongs to a longer match and is dropped.

A span of ``span`` words with at most ``edits`` edits holds ceil((span - edits) / (edits + 1)) words in a row (four
of 12 with two edits), so every contained span has a match of that length. A match of ``span`` words is a case; a
shorter one is if, with the words that alignments of furthest reach add on both sides for at most ``edits`` edits
in all, it covers ``span`` words of the item. All matches are extended together, in numpy.

Scale: documents are read once, whole, without a shuffle where the scan has as many partitions as there are cores; a
shard is bounded by ``SHARD_WORDS`` and one document, and its matches are looked at ``CHUNK`` at a time. What travels
to the workers is the test set, at most ``ITEM_BYTES`` of text at a time: a larger one is searched in parts.

Defined results: case, punctuation, spacing, mark-up, line breaks and character forms do not count; a hyphen at the
end of a line joins or parts its words, whatever the items hold; null and empty texts contain nothing; an item of
fewer than ``span`` words cannot be contained; repeated items and documents are each reported by id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.words import readings, words

SHARD_WORDS, CHUNK, ITEM_BYTES = 2_000_000, 1_000_000, 64 << 20
SCHEMA = "doc_id bigint, item_id bigint, longest_match int, at_word int"


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (n[0] numbers), first[1], .."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def known_runs(a: np.ndarray, least: int) -> np.ndarray:
    """Places of the runs of least or more numbered words of a, and of the zero after each run."""
    edge = np.diff(np.r_[0, (a != 0).astype(np.int8), 0])
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= least
    return ranges(first[long], end[long] - first[long] + 1)


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of a that begin with a word, ordered by the depth words that follow, by prefix doubling."""
    rank, step = a.astype(np.int64), 1
    while step < depth and len(a):  # rank orders by step words, then by twice as many
        key = rank * (int(rank.max()) + 2)
        key[: len(a) - step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        if rank.max() == len(a) - 1:
            break
        step *= 2
    starts = np.flatnonzero(a)
    return starts[np.argsort(rank[starts], kind="stable")]


def narrow(a: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, offset: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the intervals [lo, hi) of sa in which the word at the offset is the wanted one, by binary search."""

    def first(after: bool) -> np.ndarray:
        x, y = lo.copy(), hi.copy()
        while (open_ := x < y).any():
            mid = (x + y) >> 1
            v = a[sa[np.minimum(mid, len(sa) - 1)] + offset]
            less = (v <= want) if after else (v < want)
            x = np.where(open_ & less, mid + 1, x)
            y = np.where(open_ & ~less, mid, y)
        return x

    return first(False), first(True)


def matches(a: np.ndarray, sa: np.ndarray, items: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start in items, start in a, length) of the longest match of every suffix of items with every suffix of a, from
    least words on, a chunk at a time. left: words from each place of items to its item's end. a ends with zeros."""
    s = np.flatnonzero(left >= least)
    lo, hi = np.zeros(len(s), np.int64), np.full(len(s), len(sa), np.int64)
    for d in range(least):
        lo, hi = narrow(a, sa, lo, hi, d, items[s + d])
        some = lo < hi
        s, lo, hi = s[some], lo[some], hi[some]
    cuts = np.flatnonzero(np.diff((np.cumsum(hi - lo) - (hi - lo)) // CHUNK)) + 1
    for s, lo, hi in zip(np.split(s, cuts), np.split(lo, cuts), np.split(hi, cuts)):
        if not len(s):
            continue
        n = hi - lo
        base, start, length = np.cumsum(n) - n, np.repeat(s, n), np.full(n.sum(), least, np.int64)
        place = sa[ranges(lo, n)]
        at, low, d = base, lo, least
        while True:  # base + (i - low) is the row of entry i of an interval
            more = left[s] > d
            s, lo, hi, at, low = s[more], lo[more], hi[more], at[more], low[more]
            if not len(s):
                break
            lo, hi = narrow(a, sa, lo, hi, d, items[s + d])
            some = lo < hi
            s, lo, hi, at, low = s[some], lo[some], hi[some], at[some], low[some]
            d += 1
            length[ranges(at + lo - low, hi - lo)] = d
        yield start, place, length


def reach(items: np.ndarray, room: np.ndarray, a: np.ndarray, first: np.ndarray, end: np.ndarray, s: np.ndarray, p: np.ndarray, way: int, edits: int, most: int) -> list[np.ndarray]:
    """How many words of the item from s on (way 1) or back (-1) stand from p on or back in a[first:end] with at most
    0, 1, .. edits: alignments of furthest reach per diagonal. room: words of the item on that side."""
    room = np.minimum(room, most)
    front, out = {0: np.zeros(len(s), np.int64)}, []
    for e in range(edits + 1):
        if e:  # changed: both go on; left out: the item does; added: the text does
            steps = {d: [front[k] + more for k, more in ((d, 1), (d + 1, 1), (d - 1, 0)) if k in front] for d in range(-e, e + 1)}
            front = {d: np.minimum(np.maximum.reduce(x), room) for d, x in steps.items()}
        for d, i in front.items():
            for _ in range(most):
                at = p + way * (i + d)
                go = (i < room) & (at >= first) & (at < end)
                go &= items[np.clip(s + way * i, 0, len(items) - 1)] == a[np.clip(at, 0, len(a) - 1)]
                if not go.any():
                    break
                i = i + go
            front[d] = i
        out.append(np.maximum.reduce(list(front.values())))
    return out


def best_pairs(doc: np.ndarray, item: np.ndarray, length: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per document and item: its longest match, the first of these, and whether any is a case."""
    order = np.lexsort((at, -length, item, doc))
    doc, item, length, at, ok = (x[order] for x in (doc, item, length, at, ok))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], item[new], length[new], at[new], np.logical_or.reduceat(ok, np.flatnonzero(new)) if len(doc) else ok


def _worker(listed: list[tuple[int, list[str]]], span: int, edits: int):
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    n = np.array([len(ws) for _, ws in listed], np.int64)
    items = np.array([0, *(x for _, ws in listed for x in [*(vocab[w] for w in ws), 0])], np.int64)
    of = np.r_[0, np.repeat(np.arange(len(n)), n + 1)]
    before = np.r_[0, ranges(np.zeros(len(n), np.int64), n + 1)]  # words of the item before each place
    left = np.r_[0, np.repeat(n, n + 1) - before[1:]]
    depth, least = int(n.max(initial=0)), -(-(span - edits) // (edits + 1))

    def search(ids: list, texts: list[list[int]], docs: list[int]) -> pa.RecordBatch | None:
        """ids: of the documents; texts: numbered words; docs: the document of each text."""
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes + 1
        a = np.array([0, *(x for t in texts for x in [*t, 0])], np.int64)
        where = known_runs(a, least)
        runs = np.r_[a[where], np.zeros(depth + 1, np.int64)]
        got = []
        for s, p, length in matches(runs, suffix_array(runs, depth), items, left, least):
            p = where[p]
            longest = (items[s - 1] != a[p - 1]) | (items[s - 1] == 0)
            s, p, length = s[longest], p[longest], length[longest]
            text = np.searchsorted(first, p, side="right") - 1
            ok = length >= span
            few = np.flatnonzero(~ok)
            lo, hi = first[text[few]], first[text[few]] + sizes[text[few]] - 1
            e = s[few] + length[few]
            back = reach(items, before[s[few]], a, lo, hi, s[few] - 1, p[few] - 1, -1, edits, span)
            on = reach(items, left[e], a, lo, hi, e, p[few] + length[few], 1, edits, span)
            ok[few] = np.logical_or.reduce([back[i] + length[few] + on[edits - i] >= span for i in range(edits + 1)])
            got.append(best_pairs(np.array(docs)[text], of[s], length, p - first[text], ok))
        if not got:
            return None
        doc, item, length, at, ok = best_pairs(*(np.concatenate(x) for x in zip(*got)))
        doc, item, length, at = (x[ok] for x in (doc, item, length, at))
        cols = [pa.array([ids[d] for d in doc], pa.int64()), pa.array([listed[k][0] for k in item], pa.int64()), pa.array(length, pa.int32()), pa.array(at, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "longest_match", "at_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, docs, held = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for ws in readings(text, vocab) if text and listed else []:
                    texts.append([vocab.get(w, 0) for w in ws])
                    docs.append(len(ids))
                    held += len(ws)
                ids.append(doc_id)
                if held >= SHARD_WORDS:
                    found = search(ids, texts, docs)
                    if found:
                        yield found
                    ids, texts, docs, held = [], [], [], 0
        found = search(ids, texts, docs) if held else None
        if found:
            yield found

    return run


def find_leaks(docs: DataFrame, items: DataFrame, span: int = 12, edits: int = 2, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, longest_match (verbatim, in words), at_word, once per document and item contained."""
    if span <= 2 * edits:
        raise ValueError("a span of so few words with so many edits may hold no two words in a row")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, found = max(1, -(-size // ITEM_BYTES)), None
    for i in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        listed = sorted((r.item_id, ws) for r in part.toLocalIterator() if len(ws := words(r.text)) >= span)
        one = docs.mapInArrow(_worker(listed, span, edits), SCHEMA)
        found = one if found is None else found.unionByName(one)
    best = F.struct("longest_match", (-F.col("at_word")).alias("o"))
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_match").alias("longest_match"), F.max_by("at_word", best).alias("at_word"))


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that contain no test item."""
    return docs.join(leaks.select(F.col("doc_id").alias("_leak")).distinct(), F.col(doc_id) == F.col("_leak"), "left_anti")

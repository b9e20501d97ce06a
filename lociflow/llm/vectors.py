"""k most similar vectors of every vector by cosine: an inverted multi-index.

The two halves of the unit vectors are quantised separately, so K + K centroids make K * K cells. A query
walks the centroid pairs in the order of a summed distance with a heap: for each half, the squared distance
from the query to the border between its own cell and the other one. No vector of a cell is nearer than that,
so the walk ends at a reach ``slack * 2 * (1 - min_similarity)``; with slack 1 nothing can be missed, and for
differences that spread over d dimensions 9 / d is enough (three standard deviations along one direction).
Entries of the visited cells are reranked by exact cosine.

Scale: the codebooks grow with the square root of the rows and are fit on a bounded sample (8 rows per centroid, at
least 16,384 and at most ``sample_rows``, by hash order), every row is indexed. First-half
centroids near each other make a group of at most about ``block_rows`` members; a query travels once per group that it
visits, with the numbers of the cells there. A fuller group (one hot centroid) is cut into blocks of ``block_rows``
members, and its queries into as many parts, so a hot cell is many tasks; a task holds one block of members and streams
its queries. Equal vectors are one entry; what is said of a class is handed to its members by a join. Nothing but the
sample and a count per group reaches the driver.

Defined results: an id counts once (its latest row by the order columns); vectors that are null, of another
length, not finite or all zero take no part; magnitudes do not matter; neighbours are ordered by similarity,
then id, and equal vectors are neighbours of similarity 1; fewer than k where fewer are within reach; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.sampling import hash_sample, together
from lociflow.session import cut

DTYPE = "<f4"


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, order_cols: list[str]) -> DataFrame:
    """id, vec (unit length, as float32 bytes) of the usable vectors, once per id."""
    latest = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id"))
    one = latest.agg(F.max(F.struct(*order_cols, F.col(vec_col).cast("array<double>").alias("v"))).alias("m")).select("id", "m.v")
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0).astype(DTYPE)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])

    return one.where(fine).mapInArrow(run, "id string, vec binary")


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=DTYPE).reshape(-1, dim)


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows of x (which is in hash order)."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        n = np.bincount(a, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _borders(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own centroid of each row, and the squared distance to the border of every other centroid's cell."""
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1), 1e-12))
    h = np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart[own])
    h[np.arange(len(x)), own] = 0
    return own, h * h


def walk(a: np.ndarray, b: np.ndarray, reach: float) -> dict[int, list[int]]:
    """Cells in the order of a[i] + b[j] by a heap, until the sum passes reach: i -> its js."""
    ia, ib = np.flatnonzero(a <= reach), np.flatnonzero(b <= reach)
    ia, ib = ia[np.argsort(a[ia], kind="stable")], ib[np.argsort(b[ib], kind="stable")]
    da, db = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    heap, out = [(da[0] + db[0], 0, 0)], {}
    while heap:
        s, p, q = heapq.heappop(heap)
        if s > reach:
            break
        out.setdefault(ia[p], []).append(ib[q])
        if q + 1 < len(ib):
            heapq.heappush(heap, (da[p] + db[q + 1], p, q + 1))
        if q == 0 and p + 1 < len(ia):
            heapq.heappush(heap, (da[p + 1] + db[0], p + 1, 0))
    return out


def neighbourhoods(c: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """A group number for each centroid: halved along the axis of most spread until a group weighs most or is one centroid."""
    out, todo, made = np.zeros(len(c), np.int32), [np.arange(len(c))], 0
    while todo:
        at = todo.pop()
        if len(at) == 1 or weight[at].sum() <= most:
            out[at], made = made, made + 1
            continue
        order = at[np.argsort(c[at] @ np.linalg.svd(c[at] - c[at].mean(0), full_matrices=False)[2][0], kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2), 1, len(at) - 1))
        todo += [order[:half], order[half:]]
    return out


def _assign(dim: int, ca: np.ndarray, cb: np.ndarray, reach: float, group: np.ndarray):
    half, k = dim // 2, len(cb)

    def visited(a: np.ndarray, b: np.ndarray) -> list[dict]:
        by: dict[int, list[int]] = {}
        for i, js in walk(a, b, reach).items():
            by.setdefault(int(group[i]), []).extend(i * k + j for j in js)
        return [{"i": g, "js": cells} for g, cells in by.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = _matrix(part.column("vec"), dim)
                (i, a), (j, c) = _borders(x[:, :half], ca), _borders(x[:, half:], cb)
                asks = part.column("asks").to_pylist()
                visits = [visited(a[r], c[r]) if asks[r] else [] for r in range(len(x))]
                kind = pa.list_(pa.struct([("i", pa.int32()), ("js", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(group[i], pa.int32()), pa.array(i.astype(np.int64) * k + j, pa.int64()), pa.array(visits, kind)], names=["id", "vec", "i", "j", "visits"])

    return run


def _score(dim: int, k: int, least: float):
    """Rows sorted by block, members first: hold a block's members, stream its queries."""

    def top(ids, names, place, q, m, s):
        """The k best (query, member, similarity) of each query: by similarity, then id, whose place in order is given."""
        order = np.lexsort((place[m], -s, q))
        q, m, s = q[order], m[order], s[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.array([], int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        w = rank < k
        return pa.RecordBatch.from_arrays([pa.array(ids[q[w]], pa.string()), pa.array(names[m[w]], pa.string()), pa.array(s[w].astype(np.float64))], names=["id", "other", "sim"])

    def answer(names, cells, vecs, place, row_of, batch):
        ids = np.array(batch.column("id").to_pylist(), object)
        own = np.array([row_of.get(i, -1) for i in ids])
        js = batch.column("js")
        counts = np.asarray(js.value_lengths())
        flat, of = np.asarray(js.flatten()), np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        x = _matrix(batch.column("vec"), dim)
        qs, ms, ss = [], [], []
        for j in np.unique(cells):
            lo, hi = np.searchsorted(flat, (j, j + 1))
            if lo == hi:
                continue
            a, e = np.searchsorted(cells, (j, j + 1))
            for z in range(lo, hi, 2048):
                who = of[z : min(z + 2048, hi)]
                s = x[who] @ vecs[a:e].T
                self_ = np.flatnonzero((own[who] >= a) & (own[who] < e))
                s[self_, own[who[self_]] - a] = -9
                if e - a > k:  # the k-th best of the row bounds what can matter; ties stay
                    s[s < -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]] = -9
                p, m = np.nonzero(s >= least)
                qs.append(who[p])
                ms.append(m + a)
                ss.append(s[p, m])
        if qs:
            yield top(ids, names, place, np.concatenate(qs), np.concatenate(ms), np.concatenate(ss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for b in batches:
            blocks, kinds = np.array(b.column("block").to_pylist(), object), np.asarray(b.column("kind"))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1 if len(blocks) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, held, ready = blocks[lo], [], None
                if kinds[lo] == 0:
                    held.append((part.column("id").to_pylist(), np.asarray(part.column("j")), _matrix(part.column("vec"), dim)))
                elif held:
                    if ready is None:
                        j = np.concatenate([h[1] for h in held])
                        o = np.argsort(j, kind="stable")
                        names = np.array([n for h in held for n in h[0]], object)[o]
                        place = np.empty(len(names), np.int64)
                        place[np.argsort(names)] = np.arange(len(names))
                        ready = names, j[o], np.concatenate([h[2] for h in held])[o], place, {n: i for i, n in enumerate(names)}
                    yield from answer(*ready, part)

    return run


def nearest(units: DataFrame, k: int, dim: int, min_similarity: float | None = None, reach: float | None = None, slack: float = 0.12, asks=None, sample_rows: int = 65536, cell_rows: int = 9, block_rows: int = 8192) -> DataFrame:
    """id, other, sim, rank of the k most similar ids of each id in units (id, vec).

    asks: a condition on the ids that ask; all ids answer. reach: end of the walk, else from min_similarity.
    """
    spark = units.sparkSession
    units = cut(units)
    classes = cut(units.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max(asks if asks is not None else F.lit(True)).alias("asks")))
    n = classes.count()
    empty = spark.createDataFrame([], "id string, other string, sim double, rank int")
    if n == 0:
        return empty
    wanted = max(4, round((n / cell_rows) ** 0.5))
    sample = hash_sample(classes, "id", min(sample_rows, max(16384, 8 * wanted)), n).select("vec").toArrow()
    x = _matrix(sample.column("vec"), dim)
    size = int(min(wanted, len(x)))
    ca, cb = codebook(x[:, : dim // 2], size), codebook(x[:, dim // 2 :], size)
    least = -1.1 if min_similarity is None else min_similarity
    reach = reach if reach is not None else slack * 2 * (1 - least)

    own = (2 * x[:, : dim // 2] @ ca.T - (ca * ca).sum(1)).argmax(1)
    group = neighbourhoods(ca, np.bincount(own, minlength=size) * n / len(x), 0.7 * block_rows)
    schema = "id string, vec binary, i int, j bigint, visits array<struct<i:int,js:array<bigint>>>"
    placed = cut(classes.select("id", "vec", "asks").mapInArrow(_assign(dim, ca, cb, reach, group), schema))
    parts = {r.i: -(-r.n // block_rows) for r in placed.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect() if r.n > block_rows}  # at most K rows
    cutting = F.coalesce(F.create_map(*(F.lit(v) for p in parts.items() for v in p))[F.col("i")], F.lit(1)) if parts else F.lit(1)
    salt = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("p")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
    name = F.concat_ws(":", "i", "m", "q").alias("block")
    members = placed.select("id", "vec", "i", "j", cutting.alias("p")).select("*", salt(1).alias("m"), every.alias("q")).select(name, F.lit(0).alias("kind"), "id", "vec", "j", F.lit(None).cast("array<bigint>").alias("js"))
    queries = placed.select("id", "vec", F.inline("visits")).select("*", cutting.alias("p")).select("*", salt(2).alias("q"), every.alias("m")).select(name, F.lit(1).alias("kind"), "id", "vec", F.lit(None).cast("long").alias("j"), "js")
    scored = members.unionByName(queries).transform(together, "block", "kind").mapInArrow(_score(dim, k, least), "id string, other string, sim double")
    by_sim = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    best = scored.withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k)

    # hand the classes' neighbours to their members
    multiple = classes.where("n > 1").select("vec", F.col("id").alias("rep"))
    members_of = units.join(multiple, "vec").select("rep", "id")
    firsts = members_of.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("one"))
    others = best.select(F.col("id").alias("from"), F.col("other").alias("rep"), "sim").join(firsts, "rep", "left").select("from", F.coalesce("one", "rep").alias("other"), "sim")
    twins = firsts.select(F.col("rep").alias("from"), F.col("one").alias("other"), F.lit(1.0).alias("sim"))
    shared = others.unionByName(twins)
    alone = shared.join(multiple.select(F.col("rep").alias("from")), "from", "left_anti").withColumnRenamed("from", "id")
    lists = shared.join(multiple.select(F.col("rep").alias("from")), "from", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k + 1)
    lists = lists.groupBy("from").agg(F.collect_list(F.struct("other", "sim")).alias("l"))  # k + 1 at most
    handed = members_of.join(lists.withColumnRenamed("from", "rep"), "rep").select("id", F.inline("l")).where("id <> other")
    if asks is not None:
        handed = handed.where(asks)
    return alone.unionByName(handed).withColumn("rank", F.row_number().over(by_sim)).where(F.col("rank") <= k)

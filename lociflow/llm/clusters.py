"""Grouping records into similarity clusters: reciprocal-nearest-neighbour average linkage on a sparse graph.

The distance of two clusters is the root mean of the squared distances of their members' pairs, so a cluster is
three numbers for linkage: size n, mean m and sum of squares w about it, as
mean d2(A, B) = |mA - mB|^2 + wA / nA + wB / nB. Merging mutual best pairs in parallel gives what merging them
one after another gives, because the linkage is reducible.

1. Equal vectors are one cluster of as many records.
2. The sparse graph: a grid over the dimensions of largest variance puts all that is within the threshold of a
   cluster into its cell; there it is linked to what is near, by a tree instead of all pairs. A cell that is too full
   is cut by further dimensions; what is too full in all of them counts as linked, but for what is apart from a ball
   at its centre. Nothing is merged before this graph is complete.
3. Its connected components share no pair within the threshold, so each is clustered on its own: one of at most
   ``block`` clusters in one task, round by round, until no mutual best pair is within the threshold; more than FULL_ROWS
   without the matrix of their distances. One of which no two are farther apart than the threshold is one cluster, which
   a ball around its mean shows without rounds.
4. In a larger component with few pairs (``most_pairs`` a cluster) Spark rounds merge all mutual best pairs of the
   whole graph and carry its edges over; a merged cluster is never nearer to a third one than its nearer part, so no
   edge can be missing.
5. In a larger component that is dense Spark rounds find every cluster's nearest one by comparing all of them, blocks
   against blocks, without keeping pairs, and merge all mutual best pairs, until the component fits into a task.

All of these are exact and differ in cost only, so the result does not depend on the size of the input or of a block.

Scale: no pairs of a full cell or of a dense component are listed, but a dense component's clusters are compared, which
is quadratic. Only counts and the variances of the dimensions reach the driver; each step is cut by a checkpoint.

Defined results: ids count once (identical rows); vectors that are null, of another length or hold a null or a
value that is not finite take no part; equal vectors merge; ties in distance go to the smaller ids; the
cluster's id is its smallest record id; records near to none are clusters of one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.sampling import together
from lociflow.session import cut, forget

GRID_DIMS, CELL_ROWS, BLOCK_ROWS, FULL_ROWS = 4, 8192, 8192, 2048
_MERGED = "id bigint, into bigint, n bigint, mean array<double>, w double"


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """id, v of the records that can be clustered, once per id."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(v).alias("v"))
    return rows.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _distances(n: np.ndarray, mean: np.ndarray, w: np.ndarray) -> np.ndarray:
    sq, spread = (mean**2).sum(1), w / n
    d = mean @ mean.T
    d *= -2
    d += sq[:, None]
    d += sq
    np.maximum(np.minimum(d, d.T), 0, out=d)
    d += spread[:, None]
    d += spread
    np.fill_diagonal(d, np.inf)
    return d


def _chain(d: np.ndarray, n: np.ndarray, most: float, merges: int) -> np.ndarray:
    """Mutual best pairs one after another, found at the end of chains of nearest neighbours: the row of each row's cluster.

    Each merge costs one row of d, however many rows have the same nearest neighbour.
    """
    into, chain, free = np.arange(len(d)), [], list(range(len(d) - 1, -1, -1))
    while merges > 0:
        while not chain and free:
            if into[free[-1]] == free[-1] and np.isfinite(d[free[-1]]).any():
                chain.append(free[-1])
            free.pop()
        if not chain:
            break
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if d[a, b] > most:  # and so it stays, whatever merges
            d[a], d[:, a] = np.inf, np.inf
            chain.pop()
        elif len(chain) > 1 and b == chain[-2]:
            i, j = min(a, b), max(a, b)
            chain[-2:] = []
            both = (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
            d[i], d[:, i], d[j], d[:, j] = both, both, np.inf, np.inf
            d[i, i] = np.inf
            n[i] += n[j]
            into[j] = i
            free.append(i)
            merges -= 1
        else:
            chain.append(b)
    for i in range(len(into)):  # a row merges into one before it
        into[i] = into[into[i]]
    return into


def _walk(n: np.ndarray, mean: np.ndarray, w: np.ndarray, most: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """_chain without the matrix, until so few rows are left that can merge: each row's cluster, and those rows. n, mean
    and w become those of the clusters. A step compares one row with all that are left."""
    into, rows, centre, chain, steps = np.arange(len(n)), np.arange(len(n)), mean.mean(0), [], []
    x = mean - centre
    sq, spread, out, start, count = (x**2).sum(1), w / n, np.zeros(len(n)), 0, len(n)  # out: infinite once merged or done
    while count > least:
        if not chain:
            if count < 0.7 * len(rows):
                keep = np.flatnonzero(out == 0)
                rows, x, sq, spread, out, start = rows[keep], x[keep], sq[keep], spread[keep], out[keep], 0
            start += int((out[start:] == 0).argmax())
            chain, steps = [start], [np.inf]
        a = chain[-1]
        d = x @ (-2 * x[a])
        d += sq
        d += spread
        d += out
        d[a] = np.inf
        b = int(d.argmin())
        far = max(d[b] + sq[a], 0) + spread[a]
        if len(chain) > 1 and (far >= steps[-1] or b in chain):
            b, far = chain[-2], steps[-1]
        if far > most:  # and so it stays, whatever merges
            out[a], count = np.inf, count - 1
            chain.pop(), steps.pop()
        elif len(chain) > 1 and b == chain[-2]:
            del chain[-2:], steps[-2:]
            i, j = min(a, b), max(a, b)
            ri, rj = rows[i], rows[j]
            both = n[ri] + n[rj]
            w[ri] += w[rj] + n[ri] * n[rj] / both * ((x[i] - x[j]) ** 2).sum()
            x[i] += (x[j] - x[i]) * (n[rj] / both)
            n[ri], into[rj], mean[ri] = both, ri, x[i] + centre
            sq[i], spread[i], out[j], count = (x[i] ** 2).sum(), w[ri] / both, np.inf, count - 1
        else:
            chain.append(b)
            steps.append(far)
    for i in range(len(into)):  # a row merges into one before it
        into[i] = into[into[i]]
    return into, rows[out == 0]


def _one(n: np.ndarray, mean: np.ndarray, w: np.ndarray, most: float) -> bool:
    """Whether a ball shows that no two rows are farther apart than most, so that all merge whatever the order: the
    distance of two clusters is the mean of those of their rows."""
    return 4 * ((mean - mean.mean(0)) ** 2).sum(1).max() + 2 * (w / n).max() <= most * (1 - 1e-9)


def _bests(n: np.ndarray, mean: np.ndarray, w: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Each row's nearest row and its squared distance, and whether no two rows are farther apart than most, without the
    matrix of all distances."""
    sq, spread, best, far, near = (mean**2).sum(1), w / n, np.empty(len(n), np.int64), np.empty(len(n)), True
    step = max(1, 4_000_000 // len(n))
    for lo in range(0, len(n), step):
        at = np.arange(lo, min(lo + step, len(n)))
        d = mean[at] @ mean.T
        d *= -2
        d += sq[at][:, None]
        d += sq
        np.maximum(d, 0, out=d)
        d += spread[at][:, None]
        d += spread
        near = near and bool(d.max() <= most)
        d[at - lo, at] = np.inf
        best[at] = d.argmin(1)
        far[at] = d[at - lo, best[at]]
    return best, far, near


def link(n: np.ndarray, mean: np.ndarray, w: np.ndarray, most: float, least: int = 1) -> np.ndarray:
    """Mutual best pairs of one block, merged up to the squared distance most until so few clusters are left: each row's
    cluster. All pairs of a round merge at once; where rounds find few, as many rows have one nearest row, pairs merge
    one after another."""
    label = np.arange(len(n))
    if least == 1 and _one(n, mean, w, most):
        return np.zeros_like(label)
    live = label.copy()
    n, mean, w = n.astype(float), mean.copy(), w.copy()
    while len(live) > least:
        full, at = len(live) <= FULL_ROWS, np.arange(len(live))
        if full:
            d = _distances(n[live], mean[live], w[live])
            best = d.argmin(1)
            far = d[at, best]
        else:
            best, far, near = _bests(n[live], mean[live], w[live], most)
        a = np.flatnonzero((best[best] == at) & (at < best) & (far <= most))
        if far.min() > most:
            break
        into = np.arange(len(label))
        if least == 1 and not full and near:
            into[live] = live[0]
            return into[label]
        if full and len(a) < 0.05 * len(live):
            into[live] = live[_chain(d, n[live], most, len(live) - least)]
            return into[label]
        if len(a) < 0.05 * len(live):
            part = n[live], mean[live], w[live]
            to, left = _walk(*part, most, max(least, FULL_ROWS))
            n[live], mean[live], w[live] = part
            into[live] = live[to]
            label, live = into[label], live[left]
            continue
        x, y = live[a], live[best[a]]
        both = n[x] + n[y]
        w[x] += w[y] + n[x] * n[y] / both * ((mean[x] - mean[y]) ** 2).sum(1)
        mean[x] += (mean[y] - mean[x]) * (n[y] / both)[:, None]
        n[x] = both
        into[y] = x
        label = into[label]
        stay = far <= most  # the others are done, whatever merges
        stay[best[a]] = False
        live = live[stay] if not full else np.delete(live, best[a])
    return label


def tree(home: np.ndarray, mean: np.ndarray, most: float) -> Iterator[tuple[int, np.ndarray]]:
    """(home row, rows) for each part of a cell's home rows that ways of at most the squared distance most hold together:
    its first row, and all rows of the cell that are so near to a row of it."""
    sq, at, guests = (mean**2).sum(1), np.flatnonzero(home), np.flatnonzero(~home)
    free = np.ones(len(at), bool)

    def near(front: np.ndarray, rows: np.ndarray) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for lo in range(0, len(front), 512):
            f, todo = front[lo : lo + 512], np.flatnonzero(~new)
            if len(todo):
                g = rows[todo]
                new[todo] = (sq[f][:, None] + sq[g] - 2 * mean[f] @ mean[g].T).min(0) <= most
        return new

    for k in range(len(at)):
        if not free[k]:
            continue
        free[k], front, part = False, at[k : k + 1], [at[k : k + 1]]
        while len(front):
            left = np.flatnonzero(free)
            new = left[near(front, at[left])]
            free[new] = False
            front = at[new]
            part.append(front)
        part = np.concatenate(part)
        yield at[k], np.concatenate([part[1:], guests[near(part, guests)]])


def near_pairs(home: np.ndarray, mean: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (home row, row) within the squared distance most, each pair of home rows twice."""
    sq = (mean**2).sum(1)
    at = np.flatnonzero(home)
    for lo in range(0, len(at), 256):
        f = at[lo : lo + 256]
        i, j = np.nonzero(sq[f][:, None] + sq - 2 * mean[f] @ mean.T <= most)
        yield f[i][f[i] != j], j[f[i] != j]


def _by_group(key: str, dim: int, others: tuple[str, ...], done: Callable) -> Callable:
    """Rows sorted by key: done(ids, means, the other columns) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.asarray(b.column(key))
            cols = (np.asarray(b.column("id")), np.asarray(b.column("mean").flatten()).reshape(-1, dim), *(b.column(c).to_numpy(zero_copy_only=False) for c in others))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != now:
                    if held:
                        yield from done(*(np.concatenate(x) for x in zip(*held)))
                    now, held = keys[lo], []
                held.append(tuple(c[lo:hi] for c in cols))
        if held:
            yield from done(*(np.concatenate(x) for x in zip(*held)))

    return run


def _two(names: tuple[str, str], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))


def _trees(most: float, dim: int) -> Callable:
    def done(ids, mean, home):
        for first, rows in tree(home, mean, most):
            if len(rows):
                yield _two(("a", "b"), ids[rows], np.full(len(rows), ids[first]))

    return _by_group("cell", dim, ("home",), done)


def _pairs(most: float, dim: int, count: bool) -> Callable:
    def done(ids, mean, home):
        for i, j in near_pairs(home, mean, most):
            yield _two(("a", "b"), *np.unique(ids[i], return_counts=True)) if count else _two(("a", "b"), ids[i], ids[j])

    return _by_group("cell", dim, ("home",), done)


def _merges(most: float, dim: int) -> Callable:
    """The link of each group; rows of a group ascend by id, so the row a cluster is called by has the smallest."""

    def done(ids, mean, n, w):
        label = link(n, mean, w, most)
        keep, inverse = np.unique(label, return_inverse=True)
        size = np.bincount(inverse, n)
        total = np.zeros((len(keep), dim))
        np.add.at(total, inverse, mean * n[:, None])
        centre = total / size[:, None]
        spread = np.bincount(inverse, w + n * ((mean - centre[inverse]) ** 2).sum(1))
        first = label == np.arange(len(label))
        means = pa.array([centre[inverse[i]] if first[i] else None for i in range(len(label))], pa.list_(pa.float64()))
        cols = [pa.array(ids), pa.array(ids[label]), pa.array(np.where(first, size[inverse], 0).astype(np.int64)), means, pa.array(spread[inverse])]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "into", "n", "mean", "w"])

    return _by_group("part", dim, ("n", "w"), done)


def _square(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _cells(clusters: DataFrame, dims: list[int], threshold: float) -> tuple[list[DataFrame], DataFrame | None]:
    """(cell, home, id, mean) with every cluster in its cell and in those its surroundings reach, in cells of at most
    CELL_ROWS rows; and the rows of cells that are fuller than that by all dimensions."""
    width, out = 2 * threshold, []
    rows = clusters.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "id", "mean")
    for level in range(0, len(dims), GRID_DIMS):
        for d in dims[level : level + GRID_DIMS]:
            x = F.col("mean")[d]
            to = F.sequence(F.floor((x - threshold) / width).cast("long"), F.floor((x + threshold) / width).cast("long"))
            rows = rows.withColumn("c", F.explode(to)).select(F.xxhash64("cell", "c").alias("cell"), (F.col("home") & (F.col("c") == F.floor(x / width))).alias("home"), "id", "mean")
        of = Window.partitionBy("cell")  # without the vectors: most copies are in cells that are nobody's
        slim = rows.select("cell", "home", "id").withColumns({"k": F.count(F.lit(1)).over(of), "any": F.max("home").over(of)})
        slim = cut(slim.where("any AND k > 1").drop("any"))
        out.append(slim.where(F.col("k") <= CELL_ROWS).drop("k").join(clusters.select("id", "mean"), "id"))
        rows = slim.where(F.col("k") > CELL_ROWS).drop("k").join(clusters.select("id", "mean"), "id").select("cell", "home", "id", "mean")
        if rows.isEmpty():
            return out, None
    return out, rows


def _in_cells(cells: list[DataFrame], work: Callable) -> DataFrame:
    out = None
    for rows in cells:
        one = rows.transform(together, "cell", "id").mapInArrow(work, "a bigint, b bigint")
        out = one if out is None else out.unionByName(one)
    return out


def _centre(rows: DataFrame, key: str, dim: int) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*(F.avg(F.col("mean")[d]) for d in range(dim))).alias("centre"))


def _stars(full: DataFrame, dim: int, threshold: float) -> DataFrame:
    """a, b: links of the rows of each cell that is too full, all to one; or, where all rows near its centre are a ball
    that the others are not within the threshold of, those of the ball to one and the others to another."""
    far = full.join(_centre(full.where("home"), "cell", dim), "cell").select("cell", "home", "id", F.sqrt(_square("mean", "centre")).alias("far"))
    ball = far.where(F.col("far") <= threshold / 2).groupBy("cell").agg(F.max("far").alias("ball"))
    outside = F.coalesce(F.col("far") > (F.col("ball") + threshold) * (1 + 1e-9), F.lit(False))
    rows = cut(far.join(ball, "cell", "left").select("cell", "home", "id", outside.alias("outside"), (~outside & (F.coalesce("far", F.lit(0.0)) > threshold / 2)).alias("between")))
    rows = rows.join(rows.groupBy("cell").agg(F.max("between").alias("mixed")), "cell").select("cell", "home", "id", (F.col("outside") & ~F.col("mixed")).alias("outside"))
    return rows.join(rows.where("home").groupBy("cell", "outside").agg(F.min("id").alias("b")), ["cell", "outside"]).select(F.col("id").alias("a"), "b")


def _balls(rows: DataFrame, dim: int, most: float) -> DataFrame:
    """part of the parts that are one cluster as of _one, of rows (part, id, n, mean, w)."""
    far = rows.join(_centre(rows, "part", dim), "part").groupBy("part").agg(F.max(_square("mean", "centre")).alias("r"), F.max(F.col("w") / F.col("n")).alias("s"))
    return far.where(4 * F.col("r") + 2 * F.col("s") <= most * (1 - 1e-9)).select("part")


def components(edges: DataFrame) -> DataFrame:
    """id, part: the smallest id that edges (a, b) lead to, of the ids that have edges, by stars in turn."""
    e, before = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("part")).distinct())
        before = now


def _mutual(best: DataFrame) -> DataFrame:
    """into, gone of the pairs that are each other's best (x, y)."""
    return best.alias("p").join(best.alias("q"), (F.col("p.y") == F.col("q.x")) & (F.col("q.y") == F.col("p.x"))).where("p.x < p.y").select(F.col("p.x").alias("into"), F.col("p.y").alias("gone"))


def _joined(clusters: DataFrame, mutual: DataFrame) -> DataFrame:
    """id, n, mean, w of the clusters that mutual pairs become."""
    x, y = (clusters.select(*(F.col(c).alias(f"{k}_{c}") for c in ("id", "n", "mean", "w"))) for k in "xy")
    joined = mutual.join(x, F.col("into") == F.col("x_id")).join(y, F.col("gone") == F.col("y_id")).withColumn("t", F.col("y_n") / (F.col("x_n") + F.col("y_n")))
    return joined.select(
        F.col("into").alias("id"), (F.col("x_n") + F.col("y_n")).alias("n"),
        F.expr("transform(x_mean, (v, i) -> v + (y_mean[i] - v) * t)").alias("mean"),
        (F.col("x_w") + F.col("y_w") + F.col("x_n") * F.col("t") * _square("x_mean", "y_mean")).alias("w"),
    )


def _rounds(clusters: DataFrame, pairs: DataFrame, most: float) -> DataFrame | None:
    """id, into of the clusters that Spark rounds over all pairs (a, b) within the threshold merge."""

    def distances(pairs: DataFrame) -> DataFrame:
        side = lambda x: clusters.select(F.col("id").alias(x), F.col("mean").alias(f"m{x}"), (F.col("w") / F.col("n")).alias(f"s{x}"))
        d = _square("ma", "mb") + F.col("sa") + F.col("sb")
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", d.alias("d")).where(F.col("d") <= most))

    edges, moves = distances(pairs.where("a < b")), None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "d").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "d"))
        mutual = cut(_mutual(ends.groupBy("x").agg(F.min_by("y", F.struct("d", "y")).alias("y"))))
        new = _joined(clusters, mutual)
        changed = mutual.select(F.col("gone").alias("id")).unionByName(mutual.select(F.col("into").alias("id")))
        clusters = cut(clusters.join(changed, "id", "left_anti").unionByName(new))
        now = mutual.select(F.col("gone").alias("id"), "into")
        moves = now if moves is None else cut(_moved(moves, "into", now).unionByName(now))
        to = lambda end: now.select(F.col("id").alias(end), F.col("into").alias(f"{end}2"))
        carried = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a2", "a").alias("p"), F.coalesce("b2", "b").alias("q")).where("p <> q")
        edges = distances(carried.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    return moves


def _moved(owner: DataFrame, of: str, moves: DataFrame) -> DataFrame:
    """owner with the column of replaced by where moves (id, into) take it."""
    to = moves.select(F.col("id").alias("_from"), F.col("into").alias("_to"))
    return owner.join(to, F.col(of) == F.col("_from"), "left").withColumn(of, F.coalesce("_to", of)).select(owner.columns)


def _nearest(rows: DataFrame, dim: int, most: float) -> DataFrame:
    """x, y: the nearest cluster of the same part within the threshold, of rows (part, id, n, mean, w). Parts are cut into
    blocks; each pair of blocks is a group of its own, whose distances are compared and not kept."""

    def done(ids, mean, home, n, w):
        sq, spread = (mean**2).sum(1), w / n
        best, at = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)

        def take(i, d, y):
            less = (d < best[i]) | ((d == best[i]) & (y < at[i]))
            best[i[less]], at[i[less]] = d[less], y[less]

        home, guests = np.flatnonzero(home), np.flatnonzero(~home)
        for lo in range(0, len(home), 1024):
            f = home[lo : lo + 1024]
            for first in range(0, len(guests), 1024) if len(guests) else range(lo, len(home), 1024):
                g = (guests if len(guests) else home)[first : first + 1024]
                d = np.maximum(sq[f][:, None] + sq[g] - 2 * mean[f] @ mean[g].T, 0) + (spread[f][:, None] + spread[g])
                if f[0] == g[0]:
                    d = np.minimum(d, d.T)  # the same both ways
                    np.fill_diagonal(d, np.inf)
                one, other = d.argmin(1), d.argmin(0)
                take(f, d[np.arange(len(f)), one], ids[g[one]])
                take(g, d[other, np.arange(len(g))], ids[f[other]])
        near = np.flatnonzero(best <= most)
        yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(at[near]), pa.array(best[near])], names=["x", "y", "d"])

    blocks = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("k"))
    b = rows.join(blocks, "part").withColumn("b", F.pmod(F.xxhash64("id"), F.col("k"))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    pairs = b.select(F.xxhash64("part", F.least("b", "c"), F.greatest("b", "c")).alias("cell"), (F.col("b") <= F.col("c")).alias("home"), "id", "mean", "n", "w")
    found = pairs.transform(together, "cell", "id").mapInArrow(_by_group("cell", dim, ("home", "n", "w"), done), "x bigint, y bigint, d double")
    return found.groupBy("x").agg(F.min_by("y", F.struct("d", "y")).alias("y"))


def _compare(rows: DataFrame, dim: int, most: float, block: int) -> DataFrame:
    """id, into of what merges in dense components, rows (part, id, n, mean, w): all mutual best pairs of a round at once,
    found by comparing all clusters, until a component fits into a task."""
    moves, cols = None, ["part", "id", "n", "mean", "w"]
    rows = cut(rows.select(cols))
    while True:
        near = cut(_nearest(rows, dim, most))
        mutual = cut(_mutual(near))
        now = mutual.select(F.col("gone").alias("id"), "into")
        new = _joined(rows, mutual).join(rows.select("id", "part"), "id")
        kept = rows.join(near.select(F.col("x").alias("id")), "id", "left_semi")  # the others stay alone, whatever merges
        kept = kept.join(mutual.select(F.explode(F.array("into", "gone")).alias("id")), "id", "left_anti")
        left = cut(kept.select(cols).unionByName(new.select(cols)))
        forget(rows, near)
        sizes = left.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
        small = left.join(sizes.where(F.col("k") <= block), "part", "left_semi").select(cols)
        done = small.transform(together, "part", "id").mapInArrow(_merges(most, dim), _MERGED).where("id <> into").select("id", "into")
        now = cut(_moved(now, "into", cut(done)).unionByName(done))
        moves = now if moves is None else cut(_moved(moves, "into", now).unionByName(now))
        rows = cut(left.join(sizes.where(F.col("k") > block), "part", "left_semi").select(cols))
        forget(left)
        if rows.isEmpty():
            return moves


def cluster(points: DataFrame, dim: int, threshold: float, block: int = 32768, most_pairs: int = 128) -> DataFrame:
    """points (id, v) -> id, cluster_id."""
    most = threshold**2
    same = points.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    clusters = cut(same.select("id", "n", F.col("v").alias("mean"), F.lit(0.0).alias("w")))
    owner = cut(points.join(clusters.select(F.col("mean").alias("v"), F.col("id").alias("cluster_id")), "v").select("id", "cluster_id"))
    spread = clusters.select(*(F.coalesce(F.var_pop(F.col("mean")[d]), F.lit(0.0)) for d in range(dim))).first()
    dims = sorted(range(dim), key=lambda d: (-spread[d], d))

    cells, full = _cells(clusters, dims, threshold)
    edges = _in_cells(cells, _trees(most, dim))
    if full is not None:  # too near to tell apart by the grid
        edges = edges.unionByName(_stars(full, dim, threshold))
    rows = cut(clusters.join(components(edges), "id"))  # clusters near to none are done
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    small = rows.join(sizes.where(F.col("k") <= block), "part", "left_semi").select("part", "id", "n", "mean", "w")
    merged = small.transform(together, "part", "id").mapInArrow(_merges(most, dim), _MERGED)
    owner = cut(_moved(owner, "cluster_id", merged.where("id <> into")))
    large = cut(rows.join(sizes.where(F.col("k") > block), "part", "left_semi"))
    if large.isEmpty():
        return owner
    balls = cut(_balls(large, dim, most))
    owner = cut(_moved(owner, "cluster_id", large.join(balls, "part", "left_semi").select("id", F.col("part").alias("into"))))
    large = cut(large.join(balls, "part", "left_anti"))
    if large.isEmpty():
        return owner
    cells, full = _cells(large.drop("part"), dims, threshold)
    few = large.select("part").distinct()
    if full is not None:
        few = few.join(large.join(full, "id", "left_semi").select("part").distinct(), "part", "left_anti")
    degree = _in_cells(cells, _pairs(most, dim, True)).groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("pairs"))
    few = cut(large.join(few, "part", "left_semi").join(degree, "id", "left").groupBy("part").agg((F.sum("pairs") / F.count(F.lit(1))).alias("mean_pairs")).where(F.coalesce("mean_pairs", F.lit(0)) <= most_pairs).select("part"))
    sparse = large.join(few, "part", "left_semi").drop("part")
    if not sparse.isEmpty():
        pairs = _in_cells(cells, _pairs(most, dim, False))
        moves = _rounds(cut(sparse), pairs.join(sparse.select(F.col("id").alias("a")), "a", "left_semi"), most)
        owner = owner if moves is None else cut(_moved(owner, "cluster_id", moves))
    dense = large.join(few, "part", "left_anti")
    return owner if dense.isEmpty() else cut(_moved(owner, "cluster_id", _compare(dense, dim, most, block)))


def typical(points: DataFrame, owner: DataFrame, dim: int, k: int = 3) -> DataFrame:
    """cluster_id, n_members, typical_members: the ids nearest to the cluster's mean, nearest first."""
    from pyspark.sql.window import Window

    rows = points.join(owner, "id")
    centres = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"), F.array(*(F.avg(F.col("v")[d]) for d in range(dim))).alias("centre"))
    ranked = rows.join(centres, "cluster_id").withColumn("far", F.round(_square("v", "centre"), 9))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("far", "id"))).where(F.col("r") <= k)
    return ranked.groupBy("cluster_id").agg(F.first("n_members").alias("n_members"), F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical_members"))

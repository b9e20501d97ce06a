import numpy as np
from pyspark.sql import functions as F

from lociflow.llm.vectors import nearest, unit_vectors

DIM = 16
SCHEMA = "node string, v array<double>, at bigint, sim string"


def make(spark, rows):
    return unit_vectors(spark.createDataFrame([(n, v, i, "x") for i, (n, v) in enumerate(rows)], SCHEMA), "node", "v", DIM, ["at"])


def brute(rows, k):
    ids = [n for n, _ in rows]
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    return {ids[i]: sorted(((-s[i, j], ids[j]) for j in range(len(ids)) if j != i))[:k] for i in range(len(ids))}


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, DIM))
    x = base[rng.integers(0, len(base), n)] + 0.15 * rng.normal(size=(n, DIM))
    return [(f"n{i:04d}", list(map(float, v * 10.0 ** rng.integers(-3, 4)))) for i, v in enumerate(x)]


def test_near_pairs_are_all_found(spark):
    rows = data()
    want = {(a, b) for a, l in brute(rows, 3).items() for s, b in l if -s >= 0.9}
    got = {(r.id, r.other) for r in nearest(make(spark, rows), 3, DIM, min_similarity=0.9, slack=9 / DIM).collect()}
    assert len(want & got) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)


def test_recall_without_a_least_similarity(spark):
    rows = data(seed=1)
    asks = F.substring("id", -1, 1) == "0"
    got = nearest(make(spark, rows), 3, DIM, reach=0.5, asks=asks).collect()
    want = brute(rows, 3)
    assert {r.id for r in got} == {n for n, _ in rows if n[-1] == "0"}
    hits = sum((r.other in {b for _, b in want[r.id]}) for r in got)
    assert hits >= 0.9 * 3 * 60


def test_unusable_rows_copies_and_repeats(spark):
    v = [1.0] + [0.0] * (DIM - 1)
    w = [0.0, 1.0] + [0.0] * (DIM - 2)
    bad = [("null", None), ("short", v[1:]), ("zero", [0.0] * DIM), ("nan", [float("nan")] * DIM), ("inf", [float("inf")] * DIM), ("hole", [None] * DIM), (None, v)]
    copies = [(f"c{i}", [x * (i + 1) for x in v]) for i in range(6)]
    got = nearest(make(spark, bad + copies + copies + [("w", w), ("again", w), ("again", v)]), 3, DIM, min_similarity=0.9).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.id, []).append(r.other)
    assert by == {"again": ["c0", "c1", "c2"], **{f"c{i}": [x for x in ("again", "c0", "c1", "c2") if x != f"c{i}"][:3] for i in range(6)}}


def test_hot_cells_are_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{i:04d}", list(map(float, np.eye(DIM)[0] + 0.02 * rng.normal(size=DIM)))) for i in range(300)] + data(100)
    whole = nearest(make(spark, rows), 3, DIM, min_similarity=0.9).select("id", "other").collect()
    cut = nearest(make(spark, rows), 3, DIM, min_similarity=0.9, block_rows=40).select("id", "other").collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in cut}


def test_empty(spark):
    assert nearest(make(spark, []), 3, DIM, min_similarity=0.9).count() == 0
    assert nearest(make(spark, [("a", [1.0] * DIM)]), 3, DIM, min_similarity=0.9).count() == 0

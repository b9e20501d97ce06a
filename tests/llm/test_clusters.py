import numpy as np

from lociflow.llm import clusters
from lociflow.llm.clusters import cluster, link, typical, usable

DIM = 6


def points(spark, rows):
    return usable(spark.createDataFrame([(i, v, 7) for i, v in rows], "pid bigint, c array<double>, n int"), "pid", "c", DIM)


def groups(n_groups, sizes, seed=0, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-8, 8, (n_groups, DIM))
    rows, label = [], {}
    for g, c in enumerate(centres):
        for _ in range(sizes[g % len(sizes)]):
            label[len(rows)] = g
            rows.append((len(rows), list(map(float, c + rng.uniform(-spread, spread, DIM)))))
    return rows, label


def test_clear_groups_whatever_the_block(spark):
    rows, label = groups(40, [1, 2, 5, 120])
    first = {}
    for i, g in label.items():
        first.setdefault(g, i)
    for block in (32, 512):
        got = {r.id: r.cluster_id for r in cluster(points(spark, rows), DIM, 1.0, block=block, most_pairs=0).collect()}
        assert got == {i: first[g] for i, g in label.items()}


def one_by_one(x, most):
    """Average linkage by one merge at a time, from the matrix of squared distances."""
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    n, label = np.ones(len(x)), np.arange(len(x))
    while True:
        i, j = sorted(divmod(int(d.argmin()), len(x)))
        if d[i, j] > most:
            return label
        d[i] = (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
        d[:, i], d[i, i], d[j], d[:, j] = d[i], np.inf, np.inf, np.inf
        n[i] += n[j]
        label[label == j] = i


def recall(label, got):
    """Shares of the pairs of label that got has too, and of got that label has."""
    pairs = lambda a: int(sum(k * (k - 1) // 2 for k in np.unique(a, return_counts=True)[1]))
    both = pairs(np.array(label) * (len(label) + 1) + np.array(got))
    return both / pairs(label), both / pairs(got)


def clustered(spark, x, **options):
    owner = cluster(points(spark, [(i, list(map(float, v))) for i, v in enumerate(x)]), x.shape[1], 1.0, **options)
    return [c for _, c in sorted((r.id, r.cluster_id) for r in owner.collect())]


def test_uniform_points_as_one_merge_at_a_time(spark):
    x = np.random.default_rng(1).uniform(0, 2.5, (1500, DIM))
    assert recall(one_by_one(x, 1.0), clustered(spark, x)) == (1.0, 1.0)  # one task
    few = x[:160] * 0.8
    assert recall(one_by_one(few, 1.0), clustered(spark, few, block=64, most_pairs=10_000)) == (1.0, 1.0)  # Spark rounds


def test_full_cells(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 20)
    x = np.random.default_rng(2).uniform(0, 9, (60, DIM))
    x[:, :4] *= 0.01
    x[40:] = 3 + x[40:] * 0.001  # too full in all dimensions
    assert recall(one_by_one(x, 1.0), clustered(spark, x, block=8)) == (1.0, 1.0)


def test_a_third_in_one_cell(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.04, (6_000, DIM)), rng.uniform(-50, 50, (500, DIM))])
    got = clustered(spark, x)
    assert set(got[:6_000]) == {0} and len(set(got)) == 1 + len(set(one_by_one(x[6_000:], 1.0)))


def test_linkage_equals_one_merge_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 3, (60, DIM))
    label = link(np.ones(60), x, np.zeros(60), 2.0)
    parts = [[i] for i in range(60)]
    d = lambda a, b: np.mean([((x[i] - x[j]) ** 2).sum() for i in a for j in b])
    while True:
        best = min((d(a, b), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        if best[0] > 2.0:
            break
        parts[best[1]] += parts.pop(best[2])
    assert {frozenset(p) for p in parts} == {frozenset(np.flatnonzero(label == k)) for k in set(label)}


def test_dirt_ties_repeats_and_empty(spark):
    v = [1.0] * DIM
    rows = [(1, v), (2, v), (2, v), (3, [9.0] * DIM), (4, None), (5, v[1:]), (6, [float("nan")] * DIM), (7, [None] * DIM), (None, v)] + [(10 + i, v) for i in range(50)]
    p = points(spark, rows)
    owner = cluster(p, DIM, 1.0, block=8)
    assert {r.id: r.cluster_id for r in owner.collect()} == {1: 1, 2: 1, 3: 3, **{10 + i: 1 for i in range(50)}}
    t = {r.cluster_id: r for r in typical(p, owner, DIM).collect()}
    assert (t[1].n_members, t[1].typical_members, t[3].typical_members) == (52, [1, 2, 10], [3])
    assert cluster(points(spark, []), DIM, 1.0).count() == 0

"""Dense components give the same clusters whatever the block and the size."""

import numpy as np
from test_clusters import DIM, clustered, one_by_one, recall

from lociflow.llm import clusters


def test_dense_components_as_one_merge_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 100)
    x = np.random.default_rng(1).uniform(0, 2.0, (250, DIM))
    assert recall(one_by_one(x, 1.0), clustered(spark, x, block=180, most_pairs=0)) == (1.0, 1.0)


def test_link_without_the_matrix(monkeypatch):
    x = np.random.default_rng(2).uniform(0, 2.5, (300, DIM))
    want = clusters.link(np.ones(300), x, np.zeros(300), 1.0)
    monkeypatch.setattr(clusters, "FULL_ROWS", 40)
    assert (clusters.link(np.ones(300), x, np.zeros(300), 1.0) == want).all()


def test_one_hot_cluster_takes_few_rounds(monkeypatch):
    x, n = np.random.default_rng(3).normal(0, 0.02, (300, 24)), np.ones(300)
    x[0], n[0] = 0, 10_000  # the nearest of all rows, so a round has one mutual best pair
    want = clusters.link(n, x, np.zeros(300), 0.012)
    assert 1 < len(set(want)) < 50
    monkeypatch.setattr(clusters, "FULL_ROWS", 40)
    rounds, bests = [], clusters._bests
    monkeypatch.setattr(clusters, "_bests", lambda *a: rounds.append(1) or bests(*a))
    assert (clusters.link(n, x, np.zeros(300), 0.012) == want).all() and len(rounds) < 5
    assert set(clusters.link(n, x, np.zeros(300), 1.0)) == {0} and len(rounds) < 5


def test_rows_within_the_threshold_are_one_cluster(monkeypatch):
    monkeypatch.setattr(clusters, "FULL_ROWS", 40)
    monkeypatch.setattr(clusters, "_walk", None)
    x = np.random.default_rng(4).normal(0, 0.13, (300, 24))
    far = ((x[:, None] - x) ** 2).sum(2).max()
    assert not clusters._one(np.ones(300), x, np.zeros(300), far * 1.001)
    assert set(clusters.link(np.ones(300), x, np.zeros(300), far * 1.001)) == {0}


def test_large_balls_and_what_is_beside_them(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 20)
    monkeypatch.setattr(clusters, "_compare", None)
    monkeypatch.setattr(clusters, "_rounds", None)
    rng = np.random.default_rng(5)
    x = np.vstack([0.5 + rng.normal(0, 0.02, (90, DIM)), 0.5 + rng.normal(0, 0.001, (3, DIM)) + 0.7])  # 1.7 beside it
    got = clustered(spark, x, block=30)
    assert got == [0] * 90 + [90] * 3

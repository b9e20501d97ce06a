"""Principal axes without singular values."""

import numpy as np

from lociflow.operators import embeddings as E


def test_axes_need_no_singular_values(spark, monkeypatch):
    """pyspark.ml's PCA failed on some machines: its singular values did not converge."""
    from pyspark.ml.feature import PCA

    def failed(*_):
        raise RuntimeError("breeze.linalg.NotConvergedException")

    monkeypatch.setattr(PCA, "fit", failed)
    x = np.random.default_rng(2).normal(size=(60, 4)) @ np.diag([5.0, 3.0, 1.0, 0.01]) + 2
    a, b = (spark.createDataFrame([(i, x[i, s].tolist()) for i in range(60)], "id long, v array<double>") for s in (slice(2), slice(2, 4)))
    got = {r.id: r.v for r in E.fuse_pca(a, b, share=0.99).collect()}
    y = np.array([got[i] for i in range(60)])
    c = x - x.mean(0)
    _, s, t = np.linalg.svd(c)
    k = int((np.cumsum(s**2) / (s**2).sum() < 0.99).sum()) + 1
    assert y.shape == (60, k) and np.allclose(np.abs(y), np.abs(c @ t[:k].T))

"""The cluster fits see every component, and the search of k and the bootstrap have the reference's extent."""

from oracle import SF

import __spark_entry__ as e
from lociflow.operators import clusterfit as CF
from lociflow.plans import knowledge as K


def test_fits_see_all_components(spark):
    assert len(K._x(spark, SF).first()["features"]) == K.DIM == 64


def test_range_of_k_and_starts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(CF, "choose_k", lambda x, ks, seed=42, restarts=10: seen.update(ks=list(ks), restarts=restarts) or CF.fit(x, "kmeans", 2))
    e.queries()["fit_gmm"](spark, SF)
    assert seen == {"ks": list(range(2, 11)), "restarts": 10}


def test_a_hundred_bootstraps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(CF, "side_by_side", lambda one, runs, most=8: seen.append(runs) or [(0, 1.0, 1.0)])
    e.queries()["stability_bootstrap"](spark, SF)
    assert seen == [100]

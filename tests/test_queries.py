"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest
from oracle import SF, same

import __spark_entry__ as e

CORE_SQL = sorted(e.oracle_sql())


@pytest.mark.parametrize("name", CORE_SQL)
def test_sql(spark, name):
    only_spark, only_sql = same(spark, name)
    assert not only_spark and not only_sql


#: Queries without SQL whose results over the test tables may be empty.
MAY_BE_EMPTY: set[str] = set()
#: Columns whose values have to lie in a range, of queries without SQL.
RANGES = {
    "fit_kmeans": {"label": (0, 3)}, "fit_gmm": {"label": (0, 9), "probability": (0, 1)}, "fit_ward": {"label": (0, 3)}, "fit_spectral": {"label": (0, 3)}, "fit_methods": {"label": (0, 3)},
    "fit_consensus": {"label": (0, 3)}, "stability_records": {"stability": (0, 1)}, "stability_bootstrap": {"ari": (-1, 1), "nmi": (0, 1)}, "stability_best_k": {"mean_ari": (-1, 1)},
    "control_suite": {"p_value": (0, 1), "observed": (-1, 1)}, "conf_report": {"p_value": (0, 1)}, "clu_pvalues": {"p_value": (0, 1), "q_value": (0, 1)}, "gnn_train": {"auc": (0, 1)},
    "p1_neighbors": {"similarity": (-1, 1), "rank": (1, 3)}, "p6_fill": {"fill": (0, 1)}, "p8_segments": {"confidence": (0, 1)}, "p7_items": {"longest_match": (4, 10_000)},
}


@pytest.mark.parametrize("name", sorted(set(e.queries()) - set(e.oracle_sql())))
def test_rows(spark, name):
    """Rows come out and values lie where they may; the operators have tests of their own."""
    df = e.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name in MAY_BE_EMPTY
    for column, (low, high) in RANGES.get(name, {}).items():
        assert all(low - 1e-9 <= r[column] <= high + 1e-9 for r in rows if r[column] is not None), column


def test_entry(spark):
    assert e.entry(spark).count() > 0

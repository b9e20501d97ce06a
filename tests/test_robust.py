"""norm_robust_all has a value for every sample and set, zeros included."""

from oracle import SF

import __spark_entry__ as e
from lociflow.plans import cohort as Q


def test_no_row_is_dropped(spark):
    assert e.queries()["norm_robust_all"](spark, SF).count() == Q.dense_scores(spark, SF).count()

"""Near in time is a distance, not a span of the calendar."""

from datetime import datetime, timedelta

from lociflow.plans import data_quality as D
from lociflow.operators.impute import Numeric, fill_missing


def test_a_day_across_a_border_is_near(spark):
    border = datetime(1970, 1, 1) + timedelta(days=180 * 100)
    rows = [(1, "a", border, None), (2, "a", border - timedelta(days=1), 2.0), (3, "a", border + timedelta(days=900), 9.0), (4, "a", border + timedelta(days=180), 4.0), (5, "a", border + timedelta(days=181), 8.0), (6, "a", None, None)]
    df = spark.createDataFrame(rows, "id int, g string, t timestamp, v double")
    got = {r.id: (r.v_filled, r.v_fill_level, r.v_fill_support) for r in fill_missing(df, [Numeric("v", 0, 10)], D._levels("g", "t", [], 180)).collect()}
    assert got[1] == (3.0, D.NEAR, 2) and got[6] == (6.0, D.OWN, 4)

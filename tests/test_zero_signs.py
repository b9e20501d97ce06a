"""Lists are rounded as their SQL rounds them: a zero keeps its sign."""

import math

from lociflow.plans import modelling as M


def test_rounded_zeros_keep_their_sign(spark):
    v = spark.createDataFrame([(1, [-0.00003, 0.00003, -0.03125, 0.12344, float("nan"), float("inf"), None])], "id long, v array<double>")
    got = M.listed(v).first().v
    assert [math.copysign(1, x) for x in got[:2]] == [-1, 1] and got[:4] == [0, 0, -0.0313, 0.1234] and math.isnan(got[4]) and got[5] == math.inf and got[6] is None



def test_listed_queries_have_the_zeros_of_their_sql(spark):
    from oracle import SF, duck

    for name in ("gnn_typed_messages", "gnn_attention", "gnn_prior_attention", "gnn_hierarchy", "vec_fuse_attention"):
        want = {r[0]: r[1] for r in duck().execute(M.R.sql[name]).fetchall()}
        got = {r.id: r.v for r in M.R.queries[name](spark, SF).collect()}
        assert repr({k: [math.copysign(1, x) for x in v if x == 0] for k, v in sorted(got.items())}) == repr({k: [math.copysign(1, x) for x in v if x == 0] for k, v in sorted(want.items())}), name

"""Means that end in 5 are rounded alike in any order of their values."""

import random
from decimal import ROUND_HALF_UP, Decimal

from lociflow.plans import inference as I


def test_stage_means_do_not_depend_on_order(spark, tmp_path):
    rng = random.Random(1)
    values = {f"g{i}": [rng.randrange(1000) for _ in range(16)] for i in range(400)}
    for v in values.values():
        v[0] += (sum(v) + 1) % 2  # an odd sum: the mean ends in 5 at the seventh place
    rows = [(i * 16 + j, 0, [(g, x / 1000)]) for i, (g, v) in enumerate(values.items()) for j, x in enumerate(v)]
    spark.createDataFrame(rows, "profile_id long, subtype_id long, top_genes array<struct<gene: string, importance: double>>").write.parquet(str(tmp_path / "subtype_profiles.parquet"))
    want = {g: float((Decimal(sum(v)) / 16000).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for g, v in values.items()}
    assert {r.gene: r["mean"] for r in I.expr_stage_mean(spark, str(tmp_path)).collect()} == want

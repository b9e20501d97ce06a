"""The walk by set gives what the walk of every key gives, summed by set."""

import math
import random

from pyspark.sql import functions as F

from lociflow.operators import graph as G


def test_walk_by_set_is_the_walk_summed_by_set(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(30)]
    edges = spark.createDataFrame([(*rng.sample(nodes, 2), "t", rng.uniform(0.1, 3)) for _ in range(40)], "src string, dst string, edge_type string, weight double")
    start = spark.createDataFrame([(f"k{k}", n, rng.uniform(0.1, 2)) for k in range(6) for n in rng.sample([*nodes, "alone"], 3)] + [("none", "n0", 0.0)], "key string, node_id string, score double")
    member = spark.createDataFrame([(f"s`{i}", n) for i in range(4) for n in rng.sample([*nodes, "alone"], 5)], "pathway_id string, node_id string")
    want = G.random_walk(start, edges, 0.4, 3).join(member, "node_id").groupBy("key", "pathway_id").agg(F.sum("score").alias("score")).collect()
    got = {(r.key, r.pathway_id): r.score for r in G.walk_by_set(start, edges, member, 0.4, 3).collect()}
    assert got.keys() == {(r.key, r.pathway_id) for r in want} and all(math.isclose(got[r.key, r.pathway_id], r.score, rel_tol=1e-9) for r in want)

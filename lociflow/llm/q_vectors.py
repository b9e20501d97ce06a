"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.vectors import nearest, unit_vectors
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()
DIM, K, LEAST = 64, 3, 0.9


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return unit_vectors(table(spark, sf, "node_features"), "node_id", "features", DIM, ["loaded_at", "computed_at"])


_SQL = f"""
WITH n AS (
    SELECT node_id, arg_max(features, (loaded_at, computed_at)) AS f FROM node_features WHERE node_id IS NOT NULL GROUP BY 1
), u AS (
    SELECT node_id, CASE WHEN len(f) = {DIM} THEN f::DOUBLE[{DIM}] END AS f FROM n
    WHERE len(f) = {DIM} AND list_bool_and(list_transform(f, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(f, lambda x: x <> 0))
), r AS (
    SELECT a.node_id AS x, b.node_id AS y, array_cosine_similarity(a.f, b.f) AS c, row_number() OVER (PARTITION BY a.node_id ORDER BY array_cosine_similarity(a.f, b.f) DESC, b.node_id) AS r
    FROM u a JOIN u b ON a.node_id <> b.node_id
)
SELECT DISTINCT least(x, y) AS node_a, greatest(x, y) AS node_b FROM r WHERE r <= {K} AND c >= {LEAST}
"""


@R.add("p1_found", _SQL)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of similarity 0.9 or more of which one is among the other's 3 most similar."""
    near = nearest(_units(spark, sf), K, DIM, min_similarity=LEAST)
    return near.select(F.least("id", "other").alias("node_a"), F.greatest("id", "other").alias("node_b")).distinct()


@R.add("p1_neighbors")
def p1_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 most similar of all nodes, at any similarity, for every node whose number is divisible by 100."""
    asks = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long") % 100 == 0
    near = nearest(_units(spark, sf), K, DIM, reach=0.05, asks=F.coalesce(asks, F.lit(False)))
    return near.select(F.col("id").alias("node_id"), F.col("other").alias("neighbor_id"), F.round("sim", 4).alias("similarity"), "rank")

"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.clusters import cluster, typical, usable
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()
DIM, THRESHOLD = 24, 1.0


def assigned_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """assignment_id, sample_id, profile_id: by the hard label where the run has it, else by the largest probability."""
    profiles = table(spark, sf, "subtype_profiles").select("profile_id", "run_id", F.col("subtype_id").cast("long").alias("label")).where("label IS NOT NULL").distinct()
    largest = F.array_position("probabilities", F.array_max(F.filter("probabilities", lambda p: ~F.isnan(p)))) - 1
    rows = table(spark, sf, "cluster_assignments").select("assignment_id", "run_id", "sample_id", F.col("hard_label").cast("long").alias("label"), largest.cast("long").alias("other")).distinct()
    named = rows.join(profiles, ["run_id", "label"], "left")
    second = named.where("profile_id IS NULL").select("assignment_id", "run_id", "sample_id", F.col("other").alias("label")).join(profiles, ["run_id", "label"])
    cols = ["assignment_id", "sample_id", "profile_id"]
    return named.where("profile_id IS NOT NULL").select(cols).unionByName(second.select(cols))


_SQL = f"""
WITH p AS (
    SELECT profile_id, any_value(run_id) AS run_id, any_value(subtype_id) AS subtype_id, max(centroid) AS c FROM subtype_profiles WHERE profile_id IS NOT NULL GROUP BY 1
), u AS (
    SELECT profile_id, CASE WHEN len(c) = {DIM} THEN c::DOUBLE[{DIM}] END AS c FROM p WHERE len(c) = {DIM} AND list_bool_and(list_transform(c, lambda x: x IS NOT NULL AND isfinite(x)))
), g AS (
    SELECT a.profile_id, min(b.profile_id) AS cluster_id FROM u a JOIN u b ON array_distance(a.c, b.c) <= {THRESHOLD} GROUP BY 1 HAVING count(*) > 1
), a AS (
    SELECT DISTINCT assignment_id, run_id, hard_label, list_position(probabilities, list_max(list_filter(probabilities, lambda x: NOT isnan(x)))) - 1 AS other FROM cluster_assignments
), o AS (
    SELECT assignment_id, coalesce(h.profile_id, l.profile_id) AS profile_id FROM a
    LEFT JOIN p h ON h.run_id = a.run_id AND h.subtype_id = a.hard_label LEFT JOIN p l ON l.run_id = a.run_id AND l.subtype_id = a.other
)
SELECT cluster_id, 'profile' AS member_kind, profile_id AS member_id FROM g UNION SELECT cluster_id, 'assignment', assignment_id FROM o JOIN g USING (profile_id)
"""


@R.add("p2_found", _SQL)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles in a group of two or more, and the assignments that belong to them."""
    owner = cluster(usable(table(spark, sf, "subtype_profiles"), "profile_id", "centroid", DIM), DIM, THRESHOLD)
    several = owner.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = owner.join(several, "cluster_id").select("cluster_id", F.col("id").alias("profile_id"))
    of = assigned_profiles(spark, sf).join(members, "profile_id")
    kind = lambda df, name, col: df.select("cluster_id", F.lit(name).alias("member_kind"), F.col(col).alias("member_id"))
    return kind(members, "profile", "profile_id").unionByName(kind(of, "assignment", "assignment_id")).distinct()


@R.add("p2_clusters")
def p2_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its size, its most typical profiles and the samples assigned to it."""
    points = usable(table(spark, sf, "subtype_profiles"), "profile_id", "centroid", DIM)
    owner = cluster(points, DIM, THRESHOLD)
    of = assigned_profiles(spark, sf).join(owner.withColumnRenamed("id", "profile_id"), "profile_id")
    samples = of.groupBy("cluster_id").agg(F.count_distinct("assignment_id").alias("n_assignments"), F.count_distinct("sample_id").alias("n_samples"))
    got = typical(points, owner, DIM).join(samples, "cluster_id", "left")
    return got.select("cluster_id", F.col("n_members").alias("n_profiles"), "typical_members", F.coalesce("n_assignments", F.lit(0)).alias("n_assignments"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"))

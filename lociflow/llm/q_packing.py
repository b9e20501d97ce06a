"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.packing import pack_all
from lociflow.llm.sampling import spread
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()


def _capacities(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r.size_name: r.capacity_tokens for r in table(spark, sf, "context_sizes").distinct().collect()}  # four fixed rows


@R.add("p6_containers")
def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    return pack_all(spread(table(spark, sf, "documents").select("doc_id", "text")), _capacities(spark, sf))


@R.add("p6_fill")
def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and their fill, for each capacity."""
    sizes = table(spark, sf, "context_sizes").distinct()
    packed = p6_containers(spark, sf).where("container IS NOT NULL").groupBy("size_name").agg(F.max("container").alias("last"), F.sum("n_tokens").alias("n_tokens"))
    return packed.join(sizes, "size_name").select("size_name", (F.col("last") + 1).alias("n_containers"), "n_tokens", F.round(F.col("n_tokens") / ((F.col("last") + 1) * F.col("capacity_tokens")), 6).alias("fill"))

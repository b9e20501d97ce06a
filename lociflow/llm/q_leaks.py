"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.leaks import find_leaks, without_leaks
from lociflow.llm.sampling import spread
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"))


@R.add("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


@R.add("p7_items")
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked item with its documents and its longest verbatim match."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("longest_match").alias("longest_match"))


@R.add("p7_clean")
def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without any test item, by source."""
    clean = without_leaks(table(spark, sf, "documents"), _leaks(spark, sf))
    return clean.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))

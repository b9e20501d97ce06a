"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.language import fit, label_sql, segments
from lociflow.llm.sampling import spread
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()
RUN = 9  # words that make a language one of the document's


def _segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    return docs, segments(spread(docs.select("doc_id", "text")), fit(docs))


@R.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of several languages, or of one that the label does not name, with each of their languages."""
    docs, found = _segments(spark, sf)
    held = found.where(F.col("n_words") >= RUN).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))  # at most one per language
    labels = docs.select("doc_id", label_sql("lang").alias("label"))
    named = held.join(labels, "doc_id").where((F.size("langs") > 1) | ~F.col("label").eqNullSafe(F.col("langs")[0]))
    return named.select("doc_id", F.explode("langs").alias("lang")).distinct()


@R.add("p8_segments")
def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment with its language and confidence."""
    return _segments(spark, sf)[1].withColumn("confidence", F.round("confidence", 4))


@R.add("p8_documents")
def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The language of most words of each document, with a confidence weighted by words; null without words."""
    docs, found = _segments(spark, sf)
    by = found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    best = by.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("language"), F.round(F.max_by("c", F.struct("n", "lang")) / F.sum("n"), 4).alias("confidence"))
    return docs.select("doc_id", F.col("lang").alias("label")).join(best, "doc_id", "left")

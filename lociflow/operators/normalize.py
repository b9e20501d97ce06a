"""Normalising long scores (sample_id, pathway_id, score; one row per pair) within sets or samples.

Statistics are aggregated per set and joined back: a set is a small key with as many rows as there are samples, so
no window has to hold or sort a whole set in one task. Only the ranks need the order of a set's distinct values,
and they get it from the counts of those values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-10


def _with_stats(df: DataFrame, key: str, stats: dict[str, Column], of: DataFrame | None = None) -> DataFrame:
    return df.join((of if of is not None else df).groupBy(key).agg(*(c.alias(n) for n, c in stats.items())), key)


def _out(df: DataFrame, c: Column) -> DataFrame:
    return df.select("sample_id", "pathway_id", c.alias("score"))


def zscore(df: DataFrame, key: str = "pathway_id", reference: DataFrame | None = None) -> DataFrame:
    s = _with_stats(df, key, {"m": F.avg("score"), "sd": F.stddev_pop("score")}, reference)
    return _out(s, (F.col("score") - F.col("m")) / F.greatest("sd", F.lit(TINY)))


def robust_zscore(df: DataFrame, key: str = "pathway_id") -> DataFrame:
    s = _with_stats(df, key, {"m": F.median("score")})
    s = s.join(s.groupBy(key).agg(F.median(F.abs(F.col("score") - F.col("m"))).alias("mad")), key)
    return _out(s, (F.col("score") - F.col("m")) / F.greatest(F.col("mad") * 1.4826, F.lit(TINY)))


def minmax(df: DataFrame, key: str = "pathway_id", reference: DataFrame | None = None) -> DataFrame:
    """0 where a set is flat; with a reference, clipped to 0..1."""
    s = _with_stats(df, key, {"lo": F.min("score"), "hi": F.max("score")}, reference)
    v = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return _out(s, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if reference is not None else v)


def _ranks(df: DataFrame, key: str) -> DataFrame:
    """Rows with below (values less), same (equal values) and n of their set."""
    w = Window.partitionBy(key).orderBy("score")
    c = df.groupBy(key, "score").agg(F.count(F.lit(1)).alias("same")).withColumn("upto", F.sum("same").over(w))
    c = c.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key).withColumn("below", F.col("upto") - F.col("same"))
    return df.join(c, [key, "score"])


def rank(df: DataFrame, key: str = "pathway_id") -> DataFrame:
    """(average rank - 1) / (n - 1)."""
    return _out(_ranks(df, key), (F.col("below") + (F.col("same") - 1) / 2) / F.greatest(F.col("n") - 1, F.lit(1)))


def percentile(df: DataFrame, key: str = "pathway_id") -> DataFrame:
    return _out(_ranks(df, key), 100 * F.col("upto") / F.col("n"))


def quantile(df: DataFrame) -> DataFrame:
    """Each value replaced by the mean over the sets of the values of its rank; ties in the order of the samples."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("pathway_id").orderBy("score", "sample_id")))
    return _out(ranked.drop("score").join(ranked.groupBy("r").agg(F.avg("score").alias("v")), "r"), F.col("v"))


def log(df: DataFrame, base: float = 2.0, pseudo: float = 1.0) -> DataFrame:
    """log of the score plus pseudo, moved up as a whole where the least score is negative."""
    low = df.agg(F.least(F.min("score"), F.lit(0.0)).alias("low"))
    return _out(df.crossJoin(F.broadcast(low)), F.log(base, F.col("score") - F.col("low") + pseudo))


def clip(df: DataFrame, k: float = 3.0, key: str = "pathway_id") -> DataFrame:
    s = _with_stats(df, key, {"m": F.avg("score"), "sd": F.stddev_pop("score")})
    return _out(s, F.greatest(F.least(F.col("score"), F.col("m") + k * F.col("sd")), F.col("m") - k * F.col("sd")))


def tail(z: Column) -> Column:
    """1 - Phi(|z|) by the rational approximation of Abramowitz and Stegun, 26.2.17 (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    p = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / 2.5066282746310002 * p


def significance(df: DataFrame) -> DataFrame:
    """-log10 of the two-sided probability of a z score."""
    return _out(df, -F.log10(F.greatest(2 * tail(F.col("score")), F.lit(1e-300))))


def priors(values: DataFrame, how: str = "minmax") -> DataFrame:
    """gene, prior of (gene, value): between least and largest (0.5 where all are equal), in deviations (0 where none), or
    the share of smaller values. Ranks come from the counts of distinct values."""
    if how == "rank":
        counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("k"))
        below = counts.select("value", (F.sum("k").over(Window.orderBy("value")) - F.col("k")).alias("below"))
        n = values.agg(F.count(F.lit(1)).alias("n"))
        return values.join(below, "value").crossJoin(F.broadcast(n)).select("gene", F.coalesce(F.try_divide("below", F.col("n") - 1), F.lit(0.0)).alias("prior"))
    t = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    x = F.col("value")
    prior = {"minmax": F.coalesce(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)), "zscore": F.coalesce(F.try_divide(x - F.col("m"), "s"), F.lit(0.0))}[how]
    return values.crossJoin(F.broadcast(t)).select("gene", prior.alias("prior"))

"""Statistics of given cluster labels, over rows (id, label, v) or label tables; everything is a few aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def square(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(rows: DataFrame, dim: int) -> DataFrame:
    """label, n, centre; labels are a dimension of bounded number."""
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("centre"))


def calinski_harabasz(rows: DataFrame, dim: int) -> DataFrame:
    c = centroids(rows, dim)
    grand = rows.agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("grand"), F.count(F.lit(1)).alias("total"))
    within = rows.join(F.broadcast(c), "label").agg(F.sum(square("v", "centre")).alias("within"))
    between = c.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * square("centre", "grand")).alias("between"), F.first("total").alias("total"), F.count(F.lit(1)).alias("k"))
    return between.crossJoin(within).select(F.col("k").alias("n_clusters"), (F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("total") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame, dim: int) -> DataFrame:
    """Centres are few, so their pairs are; the rows are aggregated first."""
    c = centroids(rows, dim)
    s = rows.join(F.broadcast(c), "label").groupBy("label").agg(F.avg(F.sqrt(square("v", "centre"))).alias("s"), F.first("centre").alias("centre"))
    o = s.select(F.col("label").alias("other"), F.col("s").alias("t"), F.col("centre").alias("far"))
    worst = s.join(F.broadcast(o), F.col("label") != F.col("other")).groupBy("label").agg(F.max((F.col("s") + F.col("t")) / F.sqrt(square("centre", "far"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def simple_silhouette(rows: DataFrame, dim: int) -> DataFrame:
    """Silhouette by distances to centres instead of all pairs: linear in the rows."""
    c = F.broadcast(centroids(rows, dim).select(F.col("label").alias("other"), "centre"))
    d = rows.join(c, how="cross").select("id", "label", "other", F.sqrt(square("v", "centre")).alias("d"))
    ab = d.groupBy("id", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    return ab.groupBy("label").agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def soft_labels(rows: DataFrame, dim: int) -> DataFrame:
    """id, label of the centre, probability in proportion to 1 / distance."""
    c = F.broadcast(centroids(rows, dim).select(F.col("label").alias("cluster"), "centre"))
    d = rows.join(c, how="cross").select("id", "cluster", (1 / (F.sqrt(square("v", "centre")) + 1e-10)).alias("w"))
    return d.join(d.groupBy("id").agg(F.sum("w").alias("t")), "id").select("id", "cluster", (F.col("w") / F.col("t")).alias("probability"))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2


def agreement(two: DataFrame) -> DataFrame:
    """Adjusted Rand index, normalised mutual information and purity of the labels a and b, from their counts."""
    cells = two.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na"), F.max("n").alias("top")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    j = cells.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total))
    x = j.agg(F.sum(_pairs(F.col("n"))).alias("both"), F.first("t").alias("t"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    y = ra.crossJoin(F.broadcast(total)).agg(F.sum(_pairs(F.col("na"))).alias("pa"), h("na").alias("ha"), F.sum(F.col("top") / F.col("t")).alias("purity"))
    z = rb.crossJoin(F.broadcast(total)).agg(F.sum(_pairs(F.col("nb"))).alias("pb"), h("nb").alias("hb"))
    e = F.col("pa") * F.col("pb") / _pairs(F.col("t"))
    ari = F.coalesce(F.try_divide(F.col("both") - e, (F.col("pa") + F.col("pb")) / 2 - e), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0))
    return x.crossJoin(y).crossJoin(z).select(ari.alias("ari"), nmi.alias("nmi"), "purity")


def counts_agreement(table) -> tuple[float, float]:
    """Adjusted Rand index and normalised mutual information of a table of counts, as in agreement."""
    import numpy as np

    t = np.asarray(table, dtype=float)
    a, b, n = t.sum(1), t.sum(0), t.sum()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    h = lambda x: -(x[x > 0] / n * np.log(x[x > 0] / n)).sum()
    chance, half = pairs(a) * pairs(b) / max(pairs(n), 1.0), (pairs(a) + pairs(b)) / 2
    ha, hb = h(a), h(b)
    ari = float((pairs(t) - chance) / (half - chance)) if half != chance else 1.0
    return ari, float((ha + hb - h(t)) / ((ha + hb) / 2)) if ha + hb > 0 else 1.0


def table_agreement(two: DataFrame) -> tuple[float, float]:
    """The same of the labels a and b of rows, by one job: their table has as many cells as there are pairs of labels."""
    cells = two.groupBy("a", "b").count().collect()
    rows, cols = ({v: i for i, v in enumerate(sorted({r[c] for r in cells}))} for c in ("a", "b"))
    table = [[0] * len(cols) for _ in rows]
    for r in cells:
        table[rows[r["a"]]][cols[r["b"]]] = r["count"]
    return counts_agreement(table)


def signatures(long: DataFrame) -> DataFrame:
    """long (label, feature, value): each cluster against the rest by mean, fold change, Welch t and Cohen d."""
    one = long.groupBy("label", "feature").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    all_ = one.groupBy("feature").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    j = one.join(all_, "feature").where("n > 1 AND tn - n > 1")
    m1, m2 = F.col("s") / F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    v1 = F.greatest(F.col("q") / F.col("n") - m1 * m1, F.lit(0.0))
    v2 = F.greatest((F.col("tq") - F.col("q")) / (F.col("tn") - F.col("n")) - m2 * m2, F.lit(0.0))
    t = F.try_divide(m1 - m2, F.sqrt(v1 / (F.col("n") - 1) + v2 / (F.col("tn") - F.col("n") - 1)))
    d = F.try_divide(m1 - m2, F.sqrt((v1 + v2) / 2))
    return j.select("label", "feature", "n", m1.alias("mean_in"), m2.alias("mean_out"), t.alias("welch_t"), d.alias("cohen_d"))


def benjamini_hochberg(p: DataFrame) -> DataFrame:
    """p (key, p_value) -> q_value, monotone in rank order. Keys are tests, so their number is bounded by the design."""
    r = p.withColumn("rank", F.row_number().over(Window.orderBy("p_value", "key"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    q = F.min(F.col("p_value") * F.col("n") / F.col("rank")).over(Window.orderBy(F.desc("rank")))
    return r.select("key", "p_value", F.least(F.lit(1.0), q).alias("q_value"))


def chi_square(two: DataFrame) -> DataFrame:
    """Pearson's chi square of a and b (Yates where there is one degree of freedom) and Cramer's V."""
    cells = two.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    size = lambda r, c: r.agg(F.count(F.lit(1)).alias(c), F.sum("na" if c == "ka" else "nb").alias(f"t{c}"))
    grid = ra.crossJoin(F.broadcast(rb)).join(cells, ["a", "b"], "left").crossJoin(F.broadcast(size(ra, "ka"))).crossJoin(F.broadcast(size(rb, "kb")))
    e = F.col("na") * F.col("nb") / F.col("tka")
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    gap = F.abs(F.coalesce("n", F.lit(0.0)) - e)
    gap = F.when(dof == 1, F.greatest(gap - 0.5, F.lit(0.0))).otherwise(gap)
    x = grid.agg(F.sum(gap * gap / e).alias("chi2"), F.first(dof).alias("dof"), F.first("tka").alias("t"), F.first(F.least("ka", "kb")).alias("k"))
    return x.select("chi2", "dof", F.sqrt(F.try_divide(F.col("chi2"), F.col("t") * (F.col("k") - 1))).alias("cramers_v"))


def kruskal(rows: DataFrame) -> DataFrame:
    """Kruskal-Wallis H of value by label with ties corrected, and eta squared; ranks from the counts of values."""
    r = rows.where("value IS NOT NULL AND NOT isnan(value) AND label IS NOT NULL")
    c = r.groupBy("value").agg(F.count(F.lit(1)).alias("t")).withColumn("rank", F.sum("t").over(Window.orderBy("value")) - (F.col("t") - 1) / 2)
    g = r.groupBy("label", "value").agg(F.count(F.lit(1)).alias("k")).join(c, "value").groupBy("label").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("s"))
    a = g.agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    ties = c.agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    n, k = F.col("n"), F.col("k")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return a.crossJoin(ties).select(h.alias("h"), (k - 1).alias("dof"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (h - k + 1) / (n - k))).alias("eta2"))


def co_clustering(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels (run, id, label), pairs (a, b): share of the common runs in which both have the same label."""
    x = pairs.join(labels.select(F.col("id").alias("a"), "run", F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), "run", F.col("label").alias("lb")), ["b", "run"])
    return x.groupBy("a", "b").agg(F.avg(F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n_runs"))


def permutation_p(null: DataFrame, observed: float) -> DataFrame:
    """null (value): (values >= observed + 1) / (n + 1), and the z score of the observed value."""
    z = F.coalesce(F.try_divide(F.lit(observed) - F.avg("value"), F.stddev_pop("value")), F.lit(0.0))
    return null.agg(((F.count_if(F.col("value") >= observed) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), z.alias("z_score"))


def rating(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.6, "moderate").when(score >= 0.4, "poor").otherwise("unstable")

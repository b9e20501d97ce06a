"""Clusterings side by side: several methods, agreement over runs, stability of records, and negative controls.

Rows are (id, v). A cohort's matrix is a dimension of a study, so runs of it are tasks of their own, as in the gates; what
works on any number of rows (stability, comparison, gene frequency) is plain aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators import clusterfit as CF
from lociflow.operators.clusterstats import chi_square, kruskal


def kmeans(x, k: int, rng, rounds: int = 30):
    """Labels and centres of Lloyd's k-means from far apart rows of a matrix."""
    import numpy as np

    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        near = ((x[:, None] - c) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return ((x[:, None] - c) ** 2).sum(2).argmin(1), c


def silhouette(x, labels) -> float:
    """Mean silhouette by distances to centres; 0 with fewer than two clusters."""
    import numpy as np

    names = np.unique(labels)
    if len(names) < 2:
        return 0.0
    d = np.sqrt(((x[:, None] - np.array([x[labels == j].mean(0) for j in names])) ** 2).sum(2))
    own = np.searchsorted(names, labels)
    a = d[np.arange(len(x)), own]
    d[np.arange(len(x)), own] = np.inf
    b = d.min(1)
    return float(np.divide(b - a, np.maximum(a, b), out=np.zeros(len(x)), where=np.maximum(a, b) > 0).mean())


def ward(x, n, k: int):
    """Labels of k clusters by Ward's linkage of weighted rows: the nearest pair merges, by chains of nearest neighbours."""
    import numpy as np

    m, n = len(x), np.asarray(n, float).copy()
    d = ((x[:, None] - x) ** 2).sum(2) * (n[:, None] * n / (n[:, None] + n)) * 2
    np.fill_diagonal(d, np.inf)
    merges, chain, alive = [], [], np.ones(m, bool)
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            i, j, ab = min(a, b), max(a, b), d[a, b]
            chain[-2:] = []
            new = ((n[i] + n) * d[i] + (n[j] + n) * d[j] - n * ab) / (n[i] + n[j] + n)
            merges.append((ab, i, j))
            alive[j] = False
            n[i] += n[j]
            new[~alive] = np.inf
            d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
            d[i, i] = np.inf
        else:
            chain.append(b)
    label = np.arange(m)
    for _, i, j in sorted(merges, key=lambda t: t[0])[: max(0, m - k)]:
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def fit_ward(rows: DataFrame, dim: int, k: int, micro: int = 500, seed: int = 42) -> DataFrame:
    """id, label by Ward's linkage. More than micro rows are first gathered by k-means into micro weighted centres; what is
    linked is never more than that."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if n > micro:
        x = rows.select("id", array_to_vector("v").alias("features"))
        at = CF.labels(CF.fit(x, "kmeans", micro, seed), x).select("id", F.col("label").alias("part"))
    else:
        at = rows.select("id", F.col("id").alias("part"))
    parts = rows.join(at, "id").groupBy("part").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("c"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    label = ward(np.array([p.c for p in parts]), [p.n for p in parts], k) if len(parts) > 1 else [0] * len(parts)
    named = rows.sparkSession.createDataFrame([(p.part, int(m)) for p, m in zip(parts, label)], at.select("part").schema.add("label", "integer"))
    return at.join(named, "part").select("id", "label")


def fit_spectral(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """id, label of the nodes of a sparse similarity graph (src, dst, weight; whole numbers) by power iteration."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return pic.assignClusters(edges).select("id", F.col("cluster").alias("label"))


def fit_methods(rows: DataFrame, dim: int, k: int, methods: tuple[str, ...] = ("kmeans", "gmm", "bisecting", "ward"), seed: int = 42) -> DataFrame:
    """method, id, label of each method."""
    from lociflow.session import keep

    x, out = keep(CF.features(rows.select("id", "v"), dim)), None
    for m in methods:
        one = fit_ward(rows, dim, k, seed=seed) if m == "ward" else CF.labels(CF.fit(x, m, k, seed), x)
        one = one.select(F.lit(m).alias("method"), "id", F.col("label").cast("int").alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def consensus(labels: DataFrame, k: int, most: int = 4000) -> DataFrame:
    """id, label of k clusters by average linkage over the share of runs in which records are apart; labels (run, id, label).

    Records that are together in all runs are one: linked are the different rows of labels, of which most are allowed.
    """
    import numpy as np

    marks = labels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("m"))  # one entry per run
    marks = marks.select("id", F.transform("m", lambda s: s["label"]).alias("m"))
    kinds = marks.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy("first").limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError(f"more than {most} different rows of labels: use fewer runs or more stable clusters")
    m, n = np.array([r.m for r in kinds]).reshape(len(kinds), -1), np.array([r.n for r in kinds], float)
    d = (m[:, None] != m).mean(2)
    np.fill_diagonal(d, np.inf)
    label, left = np.arange(len(m)), len(m)
    while left > k:
        i, j = sorted(divmod(int(d.argmin()), len(m)))
        d[i] = (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
        d[:, i], d[i, i], d[j], d[:, j] = d[i], np.inf, np.inf, np.inf
        n[i] += n[j]
        label[label == j], left = i, left - 1
    number = np.unique(label, return_inverse=True)[1]
    named = labels.sparkSession.createDataFrame([(r.m, int(c)) for r, c in zip(kinds, number)], marks.select("m").schema.add("label", "integer"))
    return marks.join(named, "m").select("id", "label")


def bootstrap_labels(x: DataFrame, k: int, runs: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """run, id, label of fits on samples by hash (run 0: all rows)."""

    def one(r: int) -> DataFrame:
        part = x if r == 0 else x.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1000)) < 632)
        return CF.labels(CF.fit(part, method, k, seed + r), part).select(F.lit(r).alias("run"), "id", F.col("label").cast("int").alias("label"))

    out = None
    for r in CF.side_by_side(one, runs + 1):
        out = r if out is None else out.unionByName(r)
    return out


def record_stability(labels: DataFrame) -> DataFrame:
    """id, label (of run 0), stability: the mean share of a record's cluster mates that a run puts with it; from counts."""
    base = labels.where("run = 0").select("id", F.col("label").alias("a"))
    j = labels.where("run > 0").join(base, "id").select("run", "id", "a", F.col("label").alias("b"))
    cells = j.groupBy("run", "a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    mates = cells.groupBy("run", "a").agg(F.sum("n_ab").alias("n_a"))
    share = cells.join(mates, ["run", "a"]).select("run", "a", "b", F.coalesce(F.try_divide(F.col("n_ab") - 1, F.col("n_a") - 1), F.lit(1.0)).alias("share"))
    return j.join(share, ["run", "a", "b"]).groupBy("id", F.col("a").alias("label")).agg(F.avg("share").alias("stability"))


def core(stability: DataFrame, least: float = 0.9) -> DataFrame:
    return stability.where(F.col("stability") >= least)


def unstable(stability: DataFrame, below: float = 0.7) -> DataFrame:
    return stability.where(F.col("stability") < below)


def best_k(x: DataFrame, ks: range, runs: int = 20, method: str = "kmeans") -> DataFrame:
    """k, mean_ari, best: the number of clusters whose fits on samples agree most with the fit on all rows."""
    rows = [(k, CF.stability(x, k, runs, method)) for k in ks]
    out = None
    for k, s in rows:
        one = s.agg(F.lit(k).alias("k"), F.avg("ari").alias("mean_ari"))
        out = one if out is None else out.unionByName(one)
    top = out.agg(F.max_by("k", F.struct("mean_ari", (-F.col("k")).alias("o"))).alias("top"))
    return out.crossJoin(F.broadcast(top)).select("k", "mean_ari", (F.col("k") == F.col("top")).alias("best"))


def controls(rows: DataFrame, labels: DataFrame, k: int, runs: int = 100, features: int | None = None, seed: int = 42) -> DataFrame:
    """control, run, value: silhouettes of refits with each row's features shuffled ("permutation"), on random features
    ("random_features") and of the labels in random order ("label_shuffle"); run -1 has the observed one."""
    import numpy as np

    spark, names = rows.sparkSession, ("permutation", "random_features", "label_shuffle")
    plan = spark.createDataFrame([(c, r) for c in names for r in range(-1, runs)], "control string, run int")
    data = plan.crossJoin(rows.join(labels.select("id", "label"), "id"))

    def one(key, f):
        import pandas as pd

        f = f.sort_values("id")
        x, at, rng = np.stack(f["v"].to_numpy()).astype(float), f["label"].to_numpy(), np.random.default_rng([seed, names.index(key[0]), int(key[1]) + 1])
        if key[1] >= 0 and key[0] == "permutation":
            x = rng.permuted(x, axis=1)
            at = kmeans(x, k, rng)[0]
        elif key[1] >= 0 and key[0] == "random_features":
            x = x[:, rng.choice(x.shape[1], min(features or x.shape[1], x.shape[1]), replace=False)]
            at = kmeans(x, k, rng)[0]
        elif key[1] >= 0:
            at = rng.permutation(at)
        return pd.DataFrame({"control": [key[0]], "run": [key[1]], "value": [silhouette(x, at)]}).astype({"run": "int32"})

    return data.groupBy("control", "run").applyInPandas(one, "control string, run int, value double")


def control_report(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """control, observed, mean_null, p_value = (as large + 1) / (runs + 1), z_score, significant."""
    seen = values.where("run < 0").select("control", F.col("value").alias("observed"))
    j = values.where("run >= 0").join(F.broadcast(seen), "control").groupBy("control", "observed")
    t = j.agg(F.avg("value").alias("mean_null"), ((F.count_if(F.col("value") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.stddev_pop("value").alias("s"))
    z = F.coalesce(F.try_divide(F.col("observed") - F.col("mean_null"), "s"), F.lit(0.0))
    return t.select("control", "observed", "mean_null", "p_value", z.alias("z_score"), (F.col("p_value") < alpha).alias("significant"))


def gene_frequency(labels: DataFrame, hits: DataFrame, least: float = 0.1) -> DataFrame:
    """label, gene, share of the cluster's records that the gene hits (hits: id, gene), at least so large."""
    size = labels.groupBy("label").agg(F.count_distinct("id").alias("size"))
    n = labels.join(hits.distinct(), "id").groupBy("label", "gene").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(size), "label").select("label", "gene", (F.col("n") / F.col("size")).alias("share")).where(F.col("share") >= least)


def compare(long: DataFrame, top: int = 20) -> DataFrame:
    """feature, variance, means of the features whose cluster means differ most; long (label, feature, value)."""
    means = long.groupBy("feature", "label").agg(F.avg("value").alias("m"))
    spread = means.groupBy("feature").agg(F.var_pop("m").alias("variance"), F.transform(F.array_sort(F.collect_list(F.struct("label", "m"))), lambda s: s["m"]).alias("means"))
    return spread.orderBy(F.desc(F.round("variance", 9)), "feature").limit(top)


def centre_distances(centres: DataFrame) -> DataFrame:
    """a, b, distance of every two clusters (label, centre), which are few."""
    from lociflow.operators.clusterstats import square

    a = centres.select(F.col("label").alias("a"), F.col("centre").alias("ca"))
    b = centres.select(F.col("label").alias("b"), F.col("centre").alias("cb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(square("ca", "cb")).alias("distance"))


#: Parts of names that tell how a confounder is tested, in the order in which they are tried. Fixed values.
CONFOUND_KINDS = (("categorical", ("batch", "site", "cohort", "sex", "gender", "ancestry", "platform", "center")), ("continuous", ("age", "depth", "quality", "score", "pc")))


def confound_kind(name: str, is_text: bool, share_of_distinct: float) -> str:
    """By the name, else categorical if text or if distinct values are less than a twentieth of all."""
    for kind, parts in CONFOUND_KINDS:
        if any(p in name.lower() for p in parts):
            return kind
    return "categorical" if is_text or share_of_distinct < 0.05 else "continuous"


def confounds(rows: DataFrame, names: list[str], alpha: float = 0.05) -> DataFrame:
    """confound, kind, statistic, dof, effect of each column against label, p by the tails of chi square, Bonferroni."""
    from lociflow.functions.tails import chi2_p

    out = None
    for c in names:
        text = dict(rows.dtypes)[c] == "string"
        share = rows.agg(F.count_distinct(c) / F.greatest(F.count(c), F.lit(1))).first()[0] or 0.0
        kind = confound_kind(c, text, share)
        if kind == "categorical":
            one = chi_square(rows.select(F.col("label").alias("a"), F.col(c).cast("string").alias("b"))).select(F.col("chi2").alias("statistic"), "dof", F.col("cramers_v").alias("effect"))
        else:
            one = kruskal(rows.select("label", F.col(c).cast("double").alias("value"))).select(F.col("h").alias("statistic"), "dof", F.col("eta2").alias("effect"))
        one = one.select(F.lit(c).alias("confound"), F.lit(kind).alias("kind"), "statistic", F.col("dof").cast("long").alias("dof"), "effect")
        out = one if out is None else out.unionByName(one)
    p = out.withColumn("p_value", chi2_p(F.col("statistic"), F.col("dof")))
    return p.withColumn("significant", F.col("p_value") < alpha / len(names))


def risk(report: DataFrame) -> Column | DataFrame:
    """low without a significant confounder, moderate with up to 30 percent, else high."""
    share = F.count_if("significant") / F.count(F.lit(1))
    return report.agg(F.when(share == 0, "low").when(share <= 0.3, "moderate").otherwise("high").alias("risk"))

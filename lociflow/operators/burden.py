"""Gene burdens and gene-set scores in long form: one row per sample and gene, or sample and set, that is not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.variants import lookup

#: Weight of a consequence; the default of its impact elsewhere. Fixed values.
WEIGHTS = {
    "frameshift_variant": 1.0,
    "stop_gained": 1.0,
    "splice_acceptor_variant": 1.0,
    "splice_donor_variant": 1.0,
    "start_lost": 1.0,
    "missense_variant": 0.5,
    "inframe_insertion": 0.3,
    "inframe_deletion": 0.3,
    "protein_altering_variant": 0.5,
    "splice_region_variant": 0.2,
    "synonymous_variant": 0.0,
    "intron_variant": 0.0,
    "5_prime_UTR_variant": 0.1,
    "3_prime_UTR_variant": 0.1,
}


def weight(cadd_scale: float | None = 0.05, revel_cut: float | None = 0.5, af_beta: float | None = None) -> Column:
    """Weight of an annotated row: a missense score replaces the base weight, a high REVEL raises it."""
    w = F.when(F.col("impact") == "HIGH", 1.0).when(F.col("impact") == "MODERATE", 0.5).otherwise(0.1)
    w = F.coalesce(lookup(WEIGHTS, F.col("consequence")), w)
    if cadd_scale is not None:
        w = F.when(F.col("is_missense") & F.col("cadd").isNotNull(), F.col("cadd") * cadd_scale).otherwise(w)
    if revel_cut is not None:
        w = F.when(F.col("is_missense") & (F.col("revel") >= revel_cut), F.greatest(w, "revel")).otherwise(w)
    if af_beta is not None:
        w = w * F.coalesce(F.pow(1 - F.col("af"), F.lit(af_beta)), F.lit(1.0))
    return F.greatest(w, F.lit(0.0))


def counted(annotated: DataFrame, cadd_cut: float = 20.0) -> DataFrame:
    """Rows that carry a burden: a gene, moderate impact or more, and no missense known to be mild."""
    mild = F.col("is_missense") & (F.col("cadd") < cadd_cut)
    return annotated.where("gene IS NOT NULL AND sample_id IS NOT NULL AND impact IN ('HIGH', 'MODERATE')").where(~F.coalesce(mild, F.lit(False)))


def burden(rows: DataFrame, w: Column, how: str = "weighted_sum") -> DataFrame:
    """sample_id, gene, score, n_variants; how: weighted_sum, max or count."""
    score = {"weighted_sum": F.sum(w), "max": F.max(w), "count": F.count(F.lit(1)).cast("double")}[how]
    return rows.groupBy("sample_id", "gene").agg(score.alias("score"), F.count(F.lit(1)).alias("n_variants")).where("score > 0")


def combine(burdens: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of several burdens."""
    out = None
    for df, w in burdens.values():
        one = df.select("sample_id", "gene", (F.col("score") * w).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("sample_id", "gene").agg(F.sum("score").alias("score"))


def times_constraint(burdens: DataFrame, pli: DataFrame) -> DataFrame:
    """score * (1 + pLI) where the gene's pLI is known."""
    return burdens.join(pli.select("gene", "pli"), "gene", "left").select("sample_id", "gene", (F.col("score") * (1 + F.coalesce("pli", F.lit(0.0)))).alias("score"))


def sized(membership: DataFrame, least: int = 5, most: int = 500) -> DataFrame:
    """membership (pathway_id, gene) of the sets of so many genes, with set_size."""
    m = membership.select("pathway_id", "gene").distinct()
    sizes = m.groupBy("pathway_id").agg(F.count(F.lit(1)).alias("set_size")).where(F.col("set_size").between(least, most))
    return m.join(sizes, "pathway_id")


METHODS = ("weighted_sum", "mean", "max", "median", "top_k_mean", "sqrt_sum")


def set_scores(burdens: DataFrame, membership: DataFrame, min_hits: int = 1, top_k: int = 5, methods: tuple[str, ...] = METHODS, least: int = 5, most: int = 500) -> DataFrame:
    """sample_id, pathway_id, set_size, n_hits, genes and one column per method.

    A set has a bounded number of genes (sized), so the lists of one sample and set are bounded too. Sums are
    divided by the root of the set's size; every score is multiplied by the root of the share of genes hit.
    """
    joined = burdens.where("score > 0").join(sized(membership, least, most), "gene")
    s, size, hits = F.col("score"), F.first("set_size"), F.count(F.lit(1))
    cover = F.sqrt(hits / size)
    best = F.slice(F.sort_array(F.collect_list("score"), False), 1, top_k)
    value = {
        "weighted_sum": F.sum(s) / F.sqrt(size), "mean": F.avg(s), "max": F.max(s), "median": F.median(s),
        "top_k_mean": F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best), "sqrt_sum": F.sum(F.sqrt(s)) / F.sqrt(size),
    }
    out = joined.groupBy("sample_id", "pathway_id").agg(size.alias("set_size"), hits.alias("n_hits"), F.sort_array(F.collect_list("gene")).alias("genes"), *((value[m] * cover).alias(m) for m in methods))
    return out.where(F.col("n_hits") >= min_hits)


def dense(scores: DataFrame, samples: DataFrame, pathways: DataFrame, value: str = "score") -> DataFrame:
    """Every sample with every set, 0 where there is no score. pathways is a dimension of bounded size."""
    grid = samples.select("sample_id").distinct().crossJoin(F.broadcast(pathways.select("pathway_id").distinct()))
    return grid.join(scores.select("sample_id", "pathway_id", F.col(value).alias("score")), ["sample_id", "pathway_id"], "left").select("sample_id", "pathway_id", F.coalesce("score", F.lit(0.0)).alias("score"))

"""Variant rows: typed fields, annotation flags, quality control.

A variant frame has the columns chrom, pos, variant_id, ref, alt, sample_id, genotype, quality, filter_status and
info (map<string,string>). Every operator is one projection, one aggregation, or a semi join of the two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consequence terms by impact, in the order in which they are looked for. Fixed values.
IMPACT = {
    "HIGH": ("frameshift_variant", "stop_gained", "splice_acceptor_variant", "splice_donor_variant", "start_lost", "stop_lost"),
    "MODERATE": ("missense_variant", "inframe_insertion", "inframe_deletion", "protein_altering_variant"),
    "LOW": ("splice_region_variant", "synonymous_variant", "start_retained_variant", "stop_retained_variant"),
    "MODIFIER": ("intron_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "upstream_gene_variant", "downstream_gene_variant", "intergenic_variant", "non_coding_transcript_variant", "unknown"),
}
LOSS_OF_FUNCTION = ("frameshift_variant", "stop_gained", "splice_acceptor_variant", "splice_donor_variant", "start_lost")
CODING = (*LOSS_OF_FUNCTION, "stop_lost", "missense_variant", "inframe_insertion", "inframe_deletion", "protein_altering_variant", "synonymous_variant")
#: Info keys, the first that holds a usable value counts. Fixed values.
GENE_KEYS = ("SYMBOL", "Gene", "gene", "Gene.refGene", "GENE")
CONSEQUENCE_KEYS = ("Consequence", "CONSEQUENCE", "consequence", "ANN")
FREQUENCY_KEYS = ("AF", "MAF", "gnomAD_AF", "ExAC_AF")
NOTHING = ("", ".", "NA")


def first_text(info: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(~info[k].isin(*NOTHING), info[k]) for k in keys))


def first_number(info: Column, keys: tuple[str, ...], zero_counts: bool = True) -> Column:
    """The first value that is a number; of a comma list the first entry."""
    number = lambda k: F.split(info[k], ",")[0].try_cast("double")
    return F.coalesce(*(number(k) if zero_counts else F.nullif(number(k), F.lit(0.0)) for k in keys))


def lookup(table: dict, key: Column) -> Column:
    """The value of key in a small fixed table, as one map literal."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def consequence(text: Column) -> Column:
    """The term that the text is or, failing that, contains, without case; else unknown."""
    terms = [t for ts in IMPACT.values() for t in ts if t != "unknown"]
    inside = F.get(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.lower(text).contains(F.lower(t))), F.lit(0))
    return F.coalesce(lookup({t.lower(): t for t in terms}, F.lower(text)), inside, F.lit("unknown"))


def impact(term: Column) -> Column:
    return F.coalesce(lookup({t: level for level, ts in IMPACT.items() for t in ts}, term), F.lit("MODIFIER"))


def impact_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in ("MODIFIER", "LOW", "MODERATE", "HIGH"))), level)


def variant_type(ref: Column, alt: Column) -> Column:
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(a > r, "INS").when(r > a, "DEL").otherwise("COMPLEX")


def typed(variants: DataFrame) -> DataFrame:
    """The distinct variant rows with the info fields as columns; chromosomes in the chr style."""
    info = F.col("info")
    rows = variants.select(
        F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), F.col("chrom"))).alias("chrom"),
        "pos", "variant_id", "ref", "alt", "sample_id", "genotype", F.nanvl("quality", F.lit(None)).alias("quality"), "filter_status", "called_at",
        first_number(info, ("DP",)).alias("depth"), first_number(info, FREQUENCY_KEYS).alias("af"), first_text(info, GENE_KEYS).alias("gene"),
        consequence(first_text(info, CONSEQUENCE_KEYS)).alias("consequence"), first_number(info, ("CADD",), False).alias("cadd"), first_number(info, ("REVEL",), False).alias("revel"),
    ).distinct()
    return rows


def annotate(rows: DataFrame, cadd_cut: float = 20.0, revel_cut: float = 0.5, rare: float = 0.01, ultra_rare: float = 0.0001) -> DataFrame:
    """typed() rows with impact and flags; an unknown frequency counts as rare, an unknown score as not damaging."""
    c = F.col("consequence")
    harmful = F.coalesce((F.col("cadd") >= cadd_cut) | (F.col("revel") >= revel_cut), F.lit(False))
    level = impact(c)
    return rows.withColumns({
        "impact": level, "is_lof": c.isin(*LOSS_OF_FUNCTION), "is_missense": c == "missense_variant", "is_coding": c.isin(*CODING),
        "is_damaging": (level == "HIGH") | ((level == "MODERATE") & harmful), "is_damaging_missense": (c == "missense_variant") & harmful,
        "is_rare": F.coalesce(F.col("af") < rare, F.lit(True)), "is_ultra_rare": F.coalesce(F.col("af") < ultra_rare, F.lit(True)),
    })


@dataclass(frozen=True)
class QcConfig:
    min_quality: float = 20.0
    min_depth: float | None = 10
    pass_only: bool = True
    min_frequency: float = 0.0
    max_frequency: float = 0.01
    excluded_chromosomes: tuple[str, ...] = ("chrM", "M", "MT", "chrMT")
    types: tuple[str, ...] | None = None
    min_variants: int = 0
    max_variants: int | None = None
    extra: dict = field(default_factory=dict)


def qc_reason(c: QcConfig) -> Column:
    """Why a row fails, the first reason only; null for a row that passes. Unknown depth and frequency pass."""
    r = F.when(F.coalesce(F.col("quality"), F.lit(0.0)) < c.min_quality, "low_quality")
    if c.pass_only:
        r = r.when(F.coalesce(F.col("filter_status"), F.lit("")) != "PASS", "non_pass_filter")
    r = r.when(F.col("chrom").isin(*c.excluded_chromosomes), "excluded_chromosome")
    if c.types is not None:
        r = r.when(~variant_type(F.col("ref"), F.col("alt")).isin(*c.types), "excluded_variant_type")
    if c.min_depth is not None:
        r = r.when(F.col("depth") < c.min_depth, "low_depth")
    return r.when(F.col("af") < c.min_frequency, "low_af").when(F.col("af") > c.max_frequency, "high_af")


def qc_filter(rows: DataFrame, c: QcConfig) -> DataFrame:
    return rows.where(qc_reason(c).isNull())


def qc_reasons(rows: DataFrame, c: QcConfig) -> DataFrame:
    return rows.groupBy(F.coalesce(qc_reason(c), F.lit("pass")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def sample_stats(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Number and mean quality of the variants of every sample, also of those without any."""
    stats = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_variants"), F.avg("quality").alias("mean_quality"))
    return samples.select("sample_id").distinct().join(stats, "sample_id", "left").withColumn("n_variants", F.coalesce("n_variants", F.lit(0)))


def passing_samples(stats: DataFrame, c: QcConfig) -> DataFrame:
    ok = F.col("n_variants") >= c.min_variants
    return stats.where(ok & (F.col("n_variants") <= c.max_variants) if c.max_variants is not None else ok)


def call_rate_sites(rows: DataFrame, min_rate: float) -> DataFrame:
    """Sites with at least the share of samples among those that have a variant; rows of one site are pre-aggregated by sample."""
    site = ["chrom", "pos", "ref", "alt"]
    total = rows.agg(F.count_distinct("sample_id").alias("n_samples"))
    return rows.groupBy(*site).agg(F.count_distinct("sample_id").alias("n_carriers")).crossJoin(F.broadcast(total)).where(F.col("n_carriers") >= F.floor(F.col("n_samples") * min_rate))


def order_statistics(rows: DataFrame, column: str, ranks: dict[str, float]) -> DataFrame:
    """Values at the positions floor(n * share) of the sorted column, with least, greatest, mean and count.

    Works on the counts of the distinct values, so the one window that orders them all sees each value once.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda s: F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col("v")))
    return upto.agg(F.min("v").alias("min"), *(at(s).alias(name) for name, s in ranks.items()), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.sum("k").alias("n"))


def by_gene(annotated: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col(c))
    return annotated.where("gene IS NOT NULL").groupBy("gene").agg(
        F.count(F.lit(1)).alias("n_variants"), n("is_lof").alias("n_lof"), n("is_missense").alias("n_missense"), n("is_damaging").alias("n_damaging"),
        F.max("cadd").alias("max_cadd"), F.count_distinct("sample_id").alias("n_samples"),
    )

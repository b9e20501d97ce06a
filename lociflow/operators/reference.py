"""Reference tables: constraint, disease genes, identifiers, gene coordinates, expression by stage and cell type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_constraint(constraints: DataFrame) -> DataFrame:
    """One row per gene: each metric from the latest record that has it (impossible values count as none)."""
    ok = lambda c, lo, hi: F.when(~F.isnan(c) & F.col(c).between(lo, hi), F.col(c))
    order = F.struct("released_at", "row_id")
    last = lambda c, v: F.max_by(v, F.when(v.isNotNull(), order)).alias(c)
    rows = constraints.where("gene IS NOT NULL AND trim(gene) <> ''").distinct()
    return rows.groupBy("gene").agg(last("pli", ok("pli", 0, 1)), last("loeuf", ok("loeuf", 0, 3)), last("mis_z", ok("mis_z", -100, 100)), last("syn_z", ok("syn_z", -100, 100)))


def is_constrained(pli: float = 0.9, loeuf: float | None = None) -> Column:
    c = F.coalesce(F.col("pli") >= pli, F.lit(False))
    return c if loeuf is None else c | F.coalesce(F.col("loeuf") <= loeuf, F.lit(False))


def percentile(df: DataFrame, metric: str, lower_is_stronger: bool = False) -> DataFrame:
    """gene, percentile: share of genes at or below the metric (at or above it where lower is stronger).

    Distinct values are counted first, so the one ordered window sees each value once.
    """
    known = df.where(F.col(metric).isNotNull())
    counts = known.groupBy(metric).agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy(F.col(metric).desc() if lower_is_stronger else F.col(metric))
    pos = counts.withColumn("p", 100 * F.sum("k").over(w) / F.sum("k").over(Window.partitionBy())).drop("k")
    return known.join(pos, metric).select("gene", F.col("p").alias("percentile"))


def disease_genes(df: DataFrame) -> DataFrame:
    """One row per gene: least score 1..3, syndromic if any record says so, all kinds of evidence."""
    score = F.regexp_replace(F.coalesce("gene_score", F.lit("")), "[^0-9]", "").try_cast("int")
    flag = F.lower(F.trim(F.coalesce("syndromic", F.lit("")))).isin("1", "yes", "true", "y")
    kinds = F.filter(F.transform(F.split(F.coalesce("evidence", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.where("gene_symbol IS NOT NULL AND trim(gene_symbol) <> ''").select(F.trim("gene_symbol").alias("gene"), F.when(score.between(1, 3), score).alias("score"), flag.alias("syndromic"), kinds.alias("kinds"))
    return rows.groupBy("gene").agg(F.min("score").alias("score"), F.max("syndromic").alias("syndromic"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("evidence"))


def prior_weights(constraint: DataFrame, disease: DataFrame, cw: float = 0.5, dw: float = 0.5) -> DataFrame:
    """gene, weight: cw * pLI + dw * (1 - (score - 1) / 3) over the genes of either table, at most 1."""
    both = constraint.select("gene", "pli").join(disease.select("gene", "score"), "gene", "full_outer")
    w = cw * F.coalesce("pli", F.lit(0.0)) + dw * F.coalesce(1 - (F.col("score") - 1) / 3, F.lit(0.0))
    return both.where("pli IS NOT NULL OR score IS NOT NULL").select("gene", F.least(F.lit(1.0), w).alias("weight"))


def identifier_table(genes: DataFrame) -> DataFrame:
    """id, symbol: every id under the symbol of highest priority (symbol, Ensembl, Entrez, alias, lower-case symbol)."""
    one = lambda c, p: genes.select(c.alias("id"), "symbol", F.lit(p).alias("p"))
    ids = one(F.col("symbol"), 1).unionByName(one(F.col("ensembl_id"), 2)).unionByName(one(F.col("entrez_id"), 3)).unionByName(one(F.explode("aliases"), 4)).unionByName(one(F.lower("symbol"), 5))
    return ids.where("id IS NOT NULL").groupBy("id").agg(F.min_by("symbol", F.struct("p", "symbol")).alias("symbol"))


def resolve(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with the symbol that the id names, also without case; null where none does."""
    exact = ids.select(F.col("id").alias("_e"), F.col("symbol").alias("_es"))
    lower = ids.select(F.col("id").alias("_l"), F.col("symbol").alias("_ls"))
    j = df.join(exact, F.col(column) == F.col("_e"), "left").join(lower, F.lower(column) == F.col("_l"), "left")
    return j.withColumn("symbol", F.coalesce("_es", "_ls")).drop("_e", "_es", "_l", "_ls")


def in_genes(sites: DataFrame, genes: DataFrame, bin_bp: int = 1 << 17) -> DataFrame:
    """Sites (chrom, pos) with the genes (chromosome, start_bp, end_bp, symbol) they lie in: an equi-join on bins."""
    g = genes.where("start_bp <= end_bp").select(F.col("chromosome").alias("_c"), "start_bp", "end_bp", "symbol", F.explode(F.sequence(F.floor(F.col("start_bp") / bin_bp), F.floor(F.col("end_bp") / bin_bp))).alias("_b"))
    s = sites.withColumn("_b", F.floor(F.col("pos") / bin_bp))
    return s.join(g, (s["_b"] == g["_b"]) & (F.col("chrom") == F.col("_c")) & F.col("pos").between(F.col("start_bp"), F.col("end_bp"))).drop("_b", "_c", "start_bp", "end_bp")


def specific(long: DataFrame, group: str, min_fold: float = 2.0, min_value: float = 0.0) -> DataFrame:
    """long (gene, <group>, value): per gene and group the mean, the mean elsewhere and their ratio, if large enough."""
    cells = long.groupBy("gene", group).agg(F.sum("value").alias("s"), F.count("value").alias("k"))
    total = cells.groupBy("gene").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    j = cells.join(total, "gene").where("k > 0 AND tk > k").withColumn("here", F.try_divide("s", "k")).withColumn("elsewhere", F.try_divide(F.col("ts") - F.col("s"), F.col("tk") - F.col("k")))
    return j.where(F.col("elsewhere") > 0).withColumn("fold", F.try_divide("here", "elsewhere")).where((F.col("fold") >= min_fold) & (F.col("here") >= min_value)).select("gene", group, "here", "elsewhere", "fold")


#: Broad cell types by parts of names, the first that fits. Fixed values.
BROAD_TYPES = (
    ("excitatory_neuron", "excitatory|glutamat|l2|l3|l4|l5|l6|_it|_et|_ct"),
    ("inhibitory_neuron", "inhibitory|gaba|pvalb|sst|vip|lamp5|sncg"),
    ("neuron", "neuron"),
    ("astrocyte", "astro"),
    ("OPC", "opc"),
    ("oligodendrocyte", "oligo"),
    ("microglia", "microglia"),
    ("endothelial", "endo"),
    ("pericyte", "peri"),
)


def broad_type(column: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, parts in BROAD_TYPES:
        out = out.when(F.lower(column).rlike(parts), name)
    return out

"""Queries over variants, burdens, gene-set scores and their normalisation (steps 1 to 6 of the build plan).

Gene sets are the positional ones: the genes of gene_info on one strand of one chromosome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators import burden as B
from lociflow.operators import normalize as N
from lociflow.operators import variants as V
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()
QC = V.QcConfig(max_frequency=0.3)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.typed(table(spark, sf, "variants"))


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return V.annotate(rows(spark, sf), rare=0.01)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "phenotypes").select("sample_id").where("sample_id IS NOT NULL").distinct()


def membership(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gene_info").where("chromosome IS NOT NULL AND strand IS NOT NULL").select(F.concat("chromosome", "strand").alias("pathway_id"), F.col("symbol").alias("gene")).distinct()


def burdens(spark: SparkSession, sf: str) -> DataFrame:
    return B.burden(B.counted(V.qc_filter(annotated(spark, sf), QC)), B.weight())


def _case(terms_value: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in terms_value) + f" ELSE {default} END"


_TERMS = [t for ts in V.IMPACT.values() for t in ts if t != "unknown"]
_text = lambda keys: "coalesce(" + ", ".join(f"CASE WHEN info['{k}'] NOT IN ('', '.', 'NA') THEN info['{k}'] END" for k in keys) + ")"
_num = lambda keys: "coalesce(" + ", ".join(f"try_cast(split_part(info['{k}'], ',', 1) AS DOUBLE)" for k in keys) + ")"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
SQL_ROWS = f"""
t AS (
    SELECT DISTINCT CASE WHEN chrom LIKE 'chr%' THEN chrom ELSE 'chr' || chrom END AS chrom, pos, variant_id, ref, alt, sample_id, genotype,
           CASE WHEN NOT isnan(quality) THEN quality END AS quality, filter_status, called_at,
           {_num(["DP"])} AS depth, {_num(V.FREQUENCY_KEYS)} AS af, {_text(V.GENE_KEYS)} AS gene,
           nullif({_num(["CADD"])}, 0) AS cadd, nullif({_num(["REVEL"])}, 0) AS revel,
           {_case([(f"lower({_text(V.CONSEQUENCE_KEYS)}) LIKE '%{x.lower()}%'", f"'{x}'") for x in _TERMS], "'unknown'")} AS consequence
    FROM variants
)"""
SQL_ANNOTATED = f"""{SQL_ROWS}, a0 AS (
    SELECT *, {_case([(f"consequence IN {_IN(V.IMPACT[k])}", f"'{k}'") for k in ("HIGH", "MODERATE", "LOW")], "'MODIFIER'")} AS impact,
           coalesce(cadd >= 20 OR revel >= 0.5, false) AS harmful FROM t
), a AS (
    SELECT *, consequence IN {_IN(V.LOSS_OF_FUNCTION)} AS is_lof, consequence = 'missense_variant' AS is_missense, consequence IN {_IN(V.CODING)} AS is_coding,
           impact = 'HIGH' OR (impact = 'MODERATE' AND harmful) AS is_damaging, consequence = 'missense_variant' AND harmful AS is_damaging_missense,
           coalesce(af < 0.01, true) AS is_rare, coalesce(af < 0.0001, true) AS is_ultra_rare FROM a0
)"""
SQL_REASON = "CASE WHEN coalesce(quality, 0) < 20 THEN 'low_quality' WHEN coalesce(filter_status, '') <> 'PASS' THEN 'non_pass_filter' WHEN chrom IN ('chrM', 'M', 'MT', 'chrMT') THEN 'excluded_chromosome' WHEN depth < 10 THEN 'low_depth' WHEN af < 0 THEN 'low_af' WHEN af > 0.3 THEN 'high_af' END"
SQL_SAMPLES = "s AS (SELECT DISTINCT sample_id FROM phenotypes WHERE sample_id IS NOT NULL)"
SQL_WEIGHT = f"CASE WHEN is_missense AND revel >= 0.5 THEN greatest(coalesce(cadd * 0.05, 0.5), revel) WHEN is_missense AND cadd IS NOT NULL THEN cadd * 0.05 ELSE {_case([(f"consequence = '{k}'", str(v)) for k, v in B.WEIGHTS.items()], "CASE impact WHEN 'HIGH' THEN 1.0 WHEN 'MODERATE' THEN 0.5 ELSE 0.1 END")} END"
SQL_COUNTED = f"c AS (SELECT *, ({SQL_WEIGHT})::DOUBLE AS w FROM a WHERE ({SQL_REASON}) IS NULL AND gene IS NOT NULL AND sample_id IS NOT NULL AND impact IN ('HIGH', 'MODERATE') AND NOT coalesce(is_missense AND cadd < 20, false))"
SQL_BURDEN = f"{SQL_ANNOTATED}, {SQL_COUNTED}, b AS (SELECT sample_id, gene, sum(w) AS score, count(*) AS n_variants FROM c GROUP BY ALL HAVING sum(w) > 0)"
SQL_SETS = """m AS (
    SELECT DISTINCT chromosome || strand AS pathway_id, symbol AS gene FROM gene_info WHERE chromosome IS NOT NULL AND strand IS NOT NULL
), z AS (SELECT pathway_id, count(*) AS set_size FROM m GROUP BY 1 HAVING count(*) BETWEEN 5 AND 500), ms AS (SELECT m.*, set_size FROM m JOIN z USING (pathway_id))"""
SQL_SCORES = f"""{SQL_BURDEN}, {SQL_SETS}, p AS (
    SELECT sample_id, pathway_id, any_value(set_size) AS set_size, count(*) AS n_hits, list_sort(list(gene)) AS genes, sqrt(count(*) / any_value(set_size)) AS cover,
           sum(score) / sqrt(any_value(set_size)) AS s_sum, avg(score) AS s_mean, max(score) AS s_max, median(score) AS s_median,
           list_avg(list_reverse_sort(list(score))[1:5]) AS s_top, sum(sqrt(score)) / sqrt(any_value(set_size)) AS s_sqrt
    FROM b JOIN ms USING (gene) GROUP BY 1, 2
)"""
SQL_DENSE = f"""{SQL_SCORES}, {SQL_SAMPLES}, d AS (
    SELECT s.sample_id, z.pathway_id, coalesce(p.s_sum * p.cover, 0) AS score FROM s CROSS JOIN z LEFT JOIN p ON p.sample_id = s.sample_id AND p.pathway_id = z.pathway_id
)"""


# quality control ------------------------------------------------------------------------------------------


@R.add("qc_reason_counts", f"WITH {SQL_ROWS} SELECT coalesce({SQL_REASON}, 'pass') AS reason, count(*) AS n FROM t GROUP BY 1")
def qc_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.qc_reasons(rows(spark, sf), QC)


@R.add("qc_pass_rows", f"WITH {SQL_ROWS} SELECT chrom, pos, ref, alt, sample_id, genotype, quality, depth, af FROM t WHERE ({SQL_REASON}) IS NULL")
def qc_pass_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.qc_filter(rows(spark, sf), QC).select("chrom", "pos", "ref", "alt", "sample_id", "genotype", "quality", "depth", "af")


@R.add("qc_sample_filter", f"WITH {SQL_ROWS}, {SQL_SAMPLES} SELECT s.sample_id, count(t.pos) AS n_variants, round(avg(t.quality), 6) AS mean_quality FROM s LEFT JOIN t USING (sample_id) GROUP BY 1 HAVING count(t.pos) BETWEEN 2 AND 100")
def qc_sample_filter(spark: SparkSession, sf: str) -> DataFrame:
    good = V.passing_samples(V.sample_stats(rows(spark, sf), samples(spark, sf)), V.QcConfig(min_variants=2, max_variants=100))
    return good.withColumn("mean_quality", F.round("mean_quality", 6))


@R.add("qc_site_call_rate", f"WITH {SQL_ROWS}, n AS (SELECT count(DISTINCT sample_id) AS n_samples FROM t) SELECT chrom, pos, ref, alt, count(DISTINCT sample_id) AS n_carriers, any_value(n_samples) AS n_samples FROM t, n GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT sample_id) >= floor(any_value(n_samples) * 0.005)")
def qc_site_call_rate(spark: SparkSession, sf: str) -> DataFrame:
    return V.call_rate_sites(rows(spark, sf), 0.005)


_AT = lambda c, s: f"list_sort(list({c}))[floor(count({c}) * {s})::BIGINT + 1]"


@R.add("qc_distribution", f"WITH {SQL_ROWS} SELECT 'quality' AS metric, min(quality) AS min, {_AT('quality', 0.25)} AS q25, {_AT('quality', 0.5)} AS median, {_AT('quality', 0.75)} AS q75, max(quality) AS max, round(avg(quality), 6) AS mean, count(quality) AS n FROM t UNION ALL SELECT 'af', min(af), {_AT('af', 0.25)}, {_AT('af', 0.5)}, {_AT('af', 0.75)}, max(af), round(avg(af), 6), count(af) FROM t")
def qc_distribution(spark: SparkSession, sf: str) -> DataFrame:
    at = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    one = lambda c: V.order_statistics(rows(spark, sf), c, at).select(F.lit(c).alias("metric"), "*").withColumn("mean", F.round("mean", 6))
    return one("quality").unionByName(one("af"))


@R.add("qc_retention", f"WITH {SQL_ROWS} SELECT count(*) AS rows_in, count(*) FILTER (({SQL_REASON}) IS NULL) AS rows_out, round(count(*) FILTER (({SQL_REASON}) IS NULL) / count(*), 6) AS row_rate, count(DISTINCT sample_id) AS samples_in, count(DISTINCT CASE WHEN ({SQL_REASON}) IS NULL THEN sample_id END) AS samples_out FROM t")
def qc_retention(spark: SparkSession, sf: str) -> DataFrame:
    ok = V.qc_reason(QC).isNull()
    return rows(spark, sf).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("rows_out"), F.round(F.coalesce(F.try_divide(F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)), 6).alias("row_rate"), F.count_distinct("sample_id").alias("samples_in"), F.count_distinct(F.when(ok, F.col("sample_id"))).alias("samples_out"))


@R.add("variant_profile", f"WITH {SQL_ROWS} SELECT chrom, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(alt) > length(ref) THEN 'INS' WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'COMPLEX' END AS type, count(*) AS n, count(DISTINCT sample_id) AS n_samples, min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (quality IS NULL) AS n_no_quality FROM t GROUP BY 1, 2")
def variant_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).groupBy("chrom", V.variant_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("n_samples"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_if(F.col("quality").isNull()).alias("n_no_quality"))


@R.add("variant_region", f"WITH {SQL_ROWS} SELECT chrom, pos, ref, alt, sample_id, gene FROM t WHERE chrom = 'chr7' AND pos BETWEEN 20000000 AND 90000000")
def variant_region(spark: SparkSession, sf: str) -> DataFrame:
    near = table(spark, sf, "variants").where("chrom IN ('chr7', '7') AND pos BETWEEN 20000000 AND 90000000")  # both styles, pushed to the scan
    return V.typed(near).select("chrom", "pos", "ref", "alt", "sample_id", "gene")


@R.add("info_parse", f"WITH {SQL_ROWS} SELECT chrom, pos, ref, alt, sample_id, depth, af, gene, consequence, cadd FROM t WHERE depth IS NOT NULL OR af IS NOT NULL")
def info_parse(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).where("depth IS NOT NULL OR af IS NOT NULL").select("chrom", "pos", "ref", "alt", "sample_id", "depth", "af", "gene", "consequence", "cadd")


# annotation -----------------------------------------------------------------------------------------------

_FLAGS = ["impact", "is_lof", "is_missense", "is_coding", "is_damaging", "is_damaging_missense", "is_rare", "is_ultra_rare"]


@R.add("annot_flags", f"WITH {SQL_ANNOTATED} SELECT {', '.join(_FLAGS)}, count(*) AS n, count(DISTINCT gene) AS n_genes FROM a GROUP BY {', '.join(_FLAGS)}")
def annot_flags(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(spark, sf).groupBy(*_FLAGS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene").alias("n_genes"))


@R.add("annot_impact_filter", f"WITH {SQL_ANNOTATED} SELECT chrom, pos, ref, alt, sample_id, gene, consequence, impact FROM a WHERE impact IN ('MODERATE', 'HIGH')")
def annot_impact_filter(spark: SparkSession, sf: str) -> DataFrame:
    keep = V.impact_rank(F.col("impact")) >= V.impact_rank(F.lit("MODERATE"))
    return annotated(spark, sf).where(keep).select("chrom", "pos", "ref", "alt", "sample_id", "gene", "consequence", "impact")


@R.add("annot_gene_summary", f"WITH {SQL_ANNOTATED} SELECT gene, count(*) AS n_variants, count_if(is_lof) AS n_lof, count_if(is_missense) AS n_missense, count_if(is_damaging) AS n_damaging, max(cadd) AS max_cadd, count(DISTINCT sample_id) AS n_samples FROM a WHERE gene IS NOT NULL GROUP BY 1")
def annot_gene_summary(spark: SparkSession, sf: str) -> DataFrame:
    return V.by_gene(annotated(spark, sf))


# burden ---------------------------------------------------------------------------------------------------


def _burden(name: str, how: str, sql: str) -> None:
    @R.add(f"burden_{name}", f"WITH {SQL_ANNOTATED}, {SQL_COUNTED} SELECT sample_id, gene, round({sql}, 6) AS score, count(*) AS n_variants FROM c GROUP BY 1, 2 HAVING {sql} > 0")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return B.burden(B.counted(V.qc_filter(annotated(spark, sf), QC)), B.weight(), how).withColumn("score", F.round("score", 6))


for _n, _h, _s in (("weighted", "weighted_sum", "sum(w)"), ("max", "max", "max(w)"), ("count", "count", "count(*)")):
    _burden(_n, _h, _s)


@R.add("burden_lof", f"WITH {SQL_ANNOTATED} SELECT sample_id, gene, count(*) AS score FROM a WHERE is_lof AND gene IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2")
def burden_lof(spark: SparkSession, sf: str) -> DataFrame:
    return B.burden(annotated(spark, sf).where("is_lof AND gene IS NOT NULL AND sample_id IS NOT NULL"), F.lit(1.0), "count").select("sample_id", "gene", F.col("score").cast("long").alias("score"))


@R.add("burden_missense", f"WITH {SQL_ANNOTATED} SELECT sample_id, gene, round(sum({SQL_WEIGHT}), 6) AS score FROM a WHERE is_damaging_missense AND gene IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2 HAVING sum({SQL_WEIGHT}) > 0")
def burden_missense(spark: SparkSession, sf: str) -> DataFrame:
    return B.burden(annotated(spark, sf).where("is_damaging_missense AND gene IS NOT NULL AND sample_id IS NOT NULL"), B.weight()).select("sample_id", "gene", F.round("score", 6).alias("score"))


_SQL_BOTH = f"l AS (SELECT sample_id, gene, count(*)::DOUBLE AS score FROM a WHERE is_lof AND gene IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2), x AS (SELECT sample_id, gene, sum({SQL_WEIGHT}) AS score FROM a WHERE is_damaging_missense AND gene IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2)"


@R.add("burden_combine", f"WITH {SQL_ANNOTATED}, {_SQL_BOTH} SELECT sample_id, gene, round(sum(score), 6) AS score FROM (SELECT sample_id, gene, score * 2.0 AS score FROM l UNION ALL SELECT sample_id, gene, score * 0.5 FROM x) GROUP BY 1, 2")
def burden_combine(spark: SparkSession, sf: str) -> DataFrame:
    a = annotated(spark, sf).where("gene IS NOT NULL AND sample_id IS NOT NULL")
    both = {"lof": (B.burden(a.where("is_lof"), F.lit(1.0), "count"), 2.0), "missense": (B.burden(a.where("is_damaging_missense"), B.weight()), 0.5)}
    return B.combine(both).withColumn("score", F.round("score", 6))


SQL_PLI = "k AS (SELECT gene, max(pli) AS pli FROM gene_constraints WHERE gene IS NOT NULL AND pli IS NOT NULL AND NOT isnan(pli) GROUP BY 1)"


def gene_pli(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gene_constraints").where("gene IS NOT NULL AND pli IS NOT NULL AND NOT isnan(pli)").groupBy("gene").agg(F.max("pli").alias("pli"))


@R.add("burden_constraint", f"WITH {SQL_BURDEN}, {SQL_PLI} SELECT sample_id, gene, round(score * (1 + coalesce(pli, 0)), 10) AS score FROM b LEFT JOIN k USING (gene)")
def burden_constraint(spark: SparkSession, sf: str) -> DataFrame:
    return B.times_constraint(burdens(spark, sf), gene_pli(spark, sf)).withColumn("score", F.round("score", 10))


@R.add("burden_gene_zscore", f"WITH {SQL_BURDEN}, {SQL_SAMPLES}, n AS (SELECT count(*) AS n FROM s), g AS (SELECT gene, sum(score) / any_value(n) AS m, sum(score * score) / any_value(n) AS q FROM b SEMI JOIN s USING (sample_id), n GROUP BY 1) SELECT sample_id, gene, round((score - m) / CASE WHEN q - m * m > 0 THEN sqrt(q - m * m) ELSE 1 END, 6) AS z FROM b SEMI JOIN s USING (sample_id) JOIN g USING (gene)")
def burden_gene_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """z of each non-zero burden among all samples; the zeros enter by their number, without being written out."""
    b = burdens(spark, sf).join(samples(spark, sf), "sample_id", "left_semi")
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    g = b.groupBy("gene").agg(F.sum("score").alias("t"), F.sum(F.col("score") * F.col("score")).alias("q")).crossJoin(F.broadcast(n))
    var = F.col("q") / F.col("n") - F.pow(F.col("t") / F.col("n"), 2)
    g = g.select("gene", (F.col("t") / F.col("n")).alias("m"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd"))
    return b.join(g, "gene").select("sample_id", "gene", F.round((F.col("score") - F.col("m")) / F.col("sd"), 6).alias("z"))


# gene-set scores ------------------------------------------------------------------------------------------


def scores(spark: SparkSession, sf: str, methods: tuple[str, ...] = B.METHODS) -> DataFrame:
    return B.set_scores(burdens(spark, sf), membership(spark, sf), methods=methods)


def dense_scores(spark: SparkSession, sf: str) -> DataFrame:
    sets = B.sized(membership(spark, sf))
    return B.dense(scores(spark, sf, ("weighted_sum",)), samples(spark, sf), sets, "weighted_sum")


@R.add("pathway_sizes", f"WITH {SQL_SETS} SELECT pathway_id, set_size FROM z")
def pathway_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return B.sized(membership(spark, sf)).select("pathway_id", F.col("set_size")).distinct()


for _m, _c in zip(B.METHODS, ("s_sum", "s_mean", "s_max", "s_median", "s_top", "s_sqrt")):

    def _scored(spark: SparkSession, sf: str, m: str = _m) -> DataFrame:
        return scores(spark, sf, (m,)).select("sample_id", "pathway_id", "set_size", "n_hits", F.round(m, 6).alias("score"))

    R.add(f"pathway_{_m}", f"WITH {SQL_SCORES} SELECT sample_id, pathway_id, set_size, n_hits, round({_c} * cover, 6) AS score FROM p")(_scored)


@R.add("pathway_contributors", f"WITH {SQL_SCORES} SELECT sample_id, pathway_id, genes FROM p WHERE n_hits >= 2")
def pathway_contributors(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf, ("max",)).where("n_hits >= 2").select("sample_id", "pathway_id", "genes")


@R.add("pathway_by_type", f"WITH {SQL_ANNOTATED}, {_SQL_BOTH}, {SQL_SETS}, u AS (SELECT sample_id, pathway_id, sum(score) / sqrt(any_value(set_size)) * sqrt(count(*) / any_value(set_size)) * 1.5 AS score FROM l JOIN ms USING (gene) GROUP BY 1, 2 UNION ALL SELECT sample_id, pathway_id, sum(score) / sqrt(any_value(set_size)) * sqrt(count(*) / any_value(set_size)) FROM x JOIN ms USING (gene) WHERE score > 0 GROUP BY 1, 2) SELECT sample_id, pathway_id, round(sum(score), 6) AS score FROM u GROUP BY 1, 2")
def pathway_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Scores per kind of burden, combined with a weight of 1.5 for loss of function."""
    a, m = annotated(spark, sf).where("gene IS NOT NULL AND sample_id IS NOT NULL"), membership(spark, sf)
    one = lambda b, w: B.set_scores(b, m, methods=("weighted_sum",)).select("sample_id", "pathway_id", (F.col("weighted_sum") * w).alias("score"))
    both = one(B.burden(a.where("is_lof"), F.lit(1.0), "count"), 1.5).unionByName(one(B.burden(a.where("is_damaging_missense"), B.weight()), 1.0))
    return both.groupBy("sample_id", "pathway_id").agg(F.round(F.sum("score"), 6).alias("score"))


@R.add("pathway_filter", f"WITH {SQL_SCORES} SELECT pathway_id, round(max(s_sum * cover), 6) AS max_score, count(*) AS n_samples FROM p GROUP BY 1 HAVING max(s_sum * cover) >= 0.01 AND count(*) >= 3")
def pathway_filter(spark: SparkSession, sf: str) -> DataFrame:
    g = scores(spark, sf, ("weighted_sum",)).groupBy("pathway_id").agg(F.max("weighted_sum").alias("max_score"), F.count(F.lit(1)).alias("n_samples"))
    return g.where("max_score >= 0.01 AND n_samples >= 3").withColumn("max_score", F.round("max_score", 6))


@R.add("gene_to_pathways", f"WITH {SQL_SETS} SELECT gene, list_sort(list(pathway_id)) AS pathways FROM m GROUP BY 1")
def gene_to_pathways(spark: SparkSession, sf: str) -> DataFrame:
    return membership(spark, sf).groupBy("gene").agg(F.sort_array(F.collect_set("pathway_id")).alias("pathways"))


@R.add("pathway_merge", f"WITH {SQL_SETS}, u AS (SELECT 'positional:' || pathway_id AS pathway_id, gene FROM m UNION SELECT 'biotype:' || biotype, symbol FROM gene_info WHERE biotype IS NOT NULL) SELECT pathway_id, count(*) AS n_genes FROM u SEMI JOIN (SELECT gene_symbol AS gene FROM disease_genes) d USING (gene) GROUP BY 1")
def pathway_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two collections under prefixed ids, cut to the genes of the disease table."""
    pos = membership(spark, sf).select(F.concat(F.lit("positional:"), "pathway_id").alias("pathway_id"), "gene")
    kind = table(spark, sf, "gene_info").where("biotype IS NOT NULL").select(F.concat(F.lit("biotype:"), "biotype").alias("pathway_id"), F.col("symbol").alias("gene"))
    listed = table(spark, sf, "disease_genes").select(F.col("gene_symbol").alias("gene")).distinct()
    return pos.unionByName(kind).distinct().join(listed, "gene", "left_semi").groupBy("pathway_id").agg(F.count(F.lit(1)).alias("n_genes"))


@R.add("pathway_topk", f"WITH {SQL_DENSE}, q AS (SELECT sample_id, pathway_id, (score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-10) AS zs FROM d WINDOW w AS (PARTITION BY pathway_id)) SELECT sample_id, pathway_id, round(zs, 6) AS zscore, row_number() OVER (PARTITION BY sample_id ORDER BY round(zs, 6) DESC, pathway_id) AS rank FROM q QUALIFY rank <= 3")
def pathway_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three sets of each sample that stand out most: the flagship query."""
    z = N.zscore(dense_scores(spark, sf)).withColumn("zscore", F.round("score", 6))
    w = Window.partitionBy("sample_id").orderBy(F.desc("zscore"), "pathway_id")
    return z.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("sample_id", "pathway_id", "zscore", "rank")


# normalisation --------------------------------------------------------------------------------------------


def _norm(name: str, f, sql: str) -> None:
    @R.add(f"norm_{name}", f"WITH {SQL_DENSE} {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(dense_scores(spark, sf)).withColumn("score", F.round(F.col("score") + 0.0, 5))


_SEL = "SELECT sample_id, pathway_id, round({}, 5) AS score FROM d"
_W = " WINDOW w AS (PARTITION BY pathway_id)"
_norm("zscore", N.zscore, _SEL.format("(score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-10)") + _W)
_norm("sample_z", lambda d: N.zscore(d, "sample_id"), _SEL.format("(score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-10)") + " WINDOW w AS (PARTITION BY sample_id)")
_norm("minmax", N.minmax, _SEL.format("CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END") + _W)
_norm("rank", N.rank, _SEL.format("(rank() OVER (PARTITION BY pathway_id ORDER BY score) - 1 + (count(*) OVER (PARTITION BY pathway_id, score) - 1) / 2) / greatest(count(*) OVER w - 1, 1)") + _W)
_norm("percentile", N.percentile, _SEL.format("100 * cume_dist() OVER (PARTITION BY pathway_id ORDER BY score)"))
_norm("log", N.log, ", lo AS (SELECT least(min(score), 0) AS lo FROM d) SELECT sample_id, pathway_id, round(log2(score - lo + 1), 5) AS score FROM d, lo")
_norm("clip", N.clip, _SEL.format("greatest(least(score, avg(score) OVER w + 3 * stddev_pop(score) OVER w), avg(score) OVER w - 3 * stddev_pop(score) OVER w)") + _W)
_norm("robust", lambda d: N.robust_zscore(d.where("score > 0")), ", d1 AS (SELECT *, median(score) OVER (PARTITION BY pathway_id) AS m FROM d WHERE score > 0), d2 AS (SELECT *, median(abs(score - m)) OVER (PARTITION BY pathway_id) AS mad FROM d1) SELECT sample_id, pathway_id, round((score - m) / greatest(mad * 1.4826, 1e-10), 5) AS score FROM d2")
# The same over all rows; nine decimals, so that a set of MAD 0, divided by 1e-10, doesn't show the last bits of a sum.
_norm("robust_all", lambda d: N.robust_zscore(d.withColumn("score", F.round("score", 9))), ", d0 AS (SELECT sample_id, pathway_id, round(score, 9) AS score FROM d), d1 AS (SELECT *, median(score) OVER (PARTITION BY pathway_id) AS m FROM d0), d2 AS (SELECT *, median(abs(score - m)) OVER (PARTITION BY pathway_id) AS mad FROM d1) SELECT sample_id, pathway_id, round((score - m) / greatest(mad * 1.4826, 1e-10), 5) AS score FROM d2")
_norm("quantile", N.quantile, ", d1 AS (SELECT *, row_number() OVER (PARTITION BY pathway_id ORDER BY score, sample_id) AS r FROM d), d2 AS (SELECT r, avg(score) AS v FROM d1 GROUP BY 1) SELECT sample_id, pathway_id, round(v, 5) AS score FROM d1 JOIN d2 USING (r)")


@R.add("norm_reference", f"WITH {SQL_DENSE}, ref AS (SELECT d.* FROM d SEMI JOIN (SELECT sample_id FROM phenotypes WHERE diagnosis = 'CONTROL') c USING (sample_id)), st AS (SELECT pathway_id, avg(score) AS m, stddev_pop(score) AS sd FROM ref GROUP BY 1) SELECT sample_id, pathway_id, round((score - m) / greatest(sd, 1e-10), 5) AS score FROM d JOIN st USING (pathway_id) WHERE sd > 0")
def norm_reference(spark: SparkSession, sf: str) -> DataFrame:
    """z against the controls; sets in which the controls do not vary are left out."""
    d = dense_scores(spark, sf)
    controls = table(spark, sf, "phenotypes").where("diagnosis = 'CONTROL'").select("sample_id").distinct()
    ref = d.join(controls, "sample_id", "left_semi")
    varied = ref.groupBy("pathway_id").agg(F.stddev_pop("score").alias("sd")).where("sd > 0").select("pathway_id")
    return N.zscore(d.join(varied, "pathway_id", "left_semi"), reference=ref).withColumn("score", F.round("score", 5))


_TAIL = "exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@R.add("norm_significance", f"WITH {SQL_DENSE}, q AS (SELECT sample_id, pathway_id, abs((score - avg(score) OVER w) / greatest(stddev_pop(score) OVER w, 1e-10)) AS x FROM d WINDOW w AS (PARTITION BY pathway_id)), q2 AS (SELECT *, 1 / (1 + 0.2316419 * x) AS t FROM q) SELECT sample_id, pathway_id, round(-log10(greatest(2 * {_TAIL}, 1e-300)), 5) AS score FROM q2")
def norm_significance(spark: SparkSession, sf: str) -> DataFrame:
    return N.significance(N.zscore(dense_scores(spark, sf))).withColumn("score", F.round("score", 5))

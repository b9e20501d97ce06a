"""Queries over expression tables, causal scenarios, evidence, rules over gene sets and score networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import causal as C
from lociflow.operators import expression as X
from lociflow.operators import graph as G
from lociflow.operators import normalize as N
from lociflow.operators import ranking as K
from lociflow.operators import rules as RU
from lociflow.plans import cohort as Q
from lociflow.plans import knowledge as KN
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()
r6 = KN.r6

# expression: the importance of a gene in a profile stands for its level, the profile's number for stage and region --

PRENATAL, CORTEX = ["S0", "S1", "S2"], ["R0", "R1"]
SQL_X = "x AS (SELECT g.gene AS gene, 'S' || (subtype_id % 6) AS stage, 'R' || (profile_id % 4) AS region, CASE subtype_id % 4 WHEN 0 THEN 'Excitatory L2' WHEN 1 THEN 'GABA Sst' WHEN 2 THEN 'Astro' ELSE 'Microglia' END AS cell_type, CASE WHEN NOT isnan(g.importance) THEN g.importance END AS value FROM (SELECT DISTINCT profile_id, subtype_id, unnest(top_genes) AS g FROM (SELECT DISTINCT profile_id, subtype_id, top_genes FROM subtype_profiles)) WHERE g.gene IS NOT NULL AND subtype_id IS NOT NULL)"


def levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "subtype_profiles").select("profile_id", "subtype_id", "top_genes").distinct().where("subtype_id IS NOT NULL").select("profile_id", "subtype_id", F.inline("top_genes")).distinct().where("gene IS NOT NULL")
    kind = F.col("subtype_id") % 4
    cell = F.when(kind == 0, "Excitatory L2").when(kind == 1, "GABA Sst").when(kind == 2, "Astro").otherwise("Microglia")
    return rows.select("gene", F.concat(F.lit("S"), F.col("subtype_id") % 6).alias("stage"), F.concat(F.lit("R"), F.col("profile_id") % 4).alias("region"), cell.alias("cell_type"), F.col("importance").alias("value"))


@R.add("expr_stage_mean", f"WITH {SQL_X} SELECT gene, stage, round(avg(value), 6) AS mean FROM x GROUP BY 1, 2")
def expr_stage_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded twice: a mean that ends in 5 does not depend on the order in which its values were added."""
    return r6(X.stage_mean(levels(spark, sf)).withColumn("mean", F.round("mean", 12)), "mean")


@R.add("expr_slice", f"WITH {SQL_X} SELECT gene, region, round(avg(value), 6) AS mean FROM x WHERE stage = 'S1' GROUP BY 1, 2")
def expr_slice(spark: SparkSession, sf: str) -> DataFrame:
    return r6(X.part(levels(spark, sf), stage="S1").groupBy("gene", "region").agg(F.avg(X.valid()).alias("mean")), "mean")


@R.add("expr_prenatal_genes", f"WITH {SQL_X} SELECT gene FROM x WHERE stage IN ('S0', 'S1', 'S2') GROUP BY 1 HAVING max(value) >= 0.5")
def expr_prenatal_genes(spark: SparkSession, sf: str) -> DataFrame:
    return X.expressed(levels(spark, sf), PRENATAL, 0.5)


@R.add("expr_prenatal_flags", f"WITH {SQL_X}, h AS (SELECT gene FROM x WHERE stage IN ('S0', 'S1', 'S2') GROUP BY 1 HAVING max(value) >= 0.5) SELECT symbol AS gene, symbol IN (SELECT gene FROM h) AS prenatal FROM gene_info")
def expr_prenatal_flags(spark: SparkSession, sf: str) -> DataFrame:
    genes = table(spark, sf, "gene_info").select(F.col("symbol").alias("gene"))
    return X.flags(genes, expr_prenatal_genes(spark, sf), "prenatal")


@R.add("expr_cortical", f"WITH {SQL_X} SELECT gene, stage, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS mean FROM x WHERE region IN ('R0', 'R1') GROUP BY 1, 2")
def expr_cortical(spark: SparkSession, sf: str) -> DataFrame:
    return r6(X.region_mean(levels(spark, sf), CORTEX), "mean")


@R.add("expr_gene_mean", f"WITH {SQL_X} SELECT gene, round(avg(value), 6) AS mean FROM x GROUP BY 1")
def expr_gene_mean(spark: SparkSession, sf: str) -> DataFrame:
    return r6(X.gene_mean(levels(spark, sf)), "mean")


@R.add("expr_peak_stage", f"WITH {SQL_X} SELECT gene, region, stage, value FROM x WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gene, region ORDER BY value DESC, stage) = 1")
def expr_peak_stage(spark: SparkSession, sf: str) -> DataFrame:
    return X.peak(levels(spark, sf))


@R.add("expr_cell_profile", f"WITH {SQL_X} SELECT gene, list([cell_type, round(value, 6)::VARCHAR] ORDER BY cell_type) AS cells FROM (SELECT gene, cell_type, avg(value) AS value FROM x GROUP BY 1, 2) GROUP BY 1")
def expr_cell_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = X.profile(levels(spark, sf))
    return p.select("gene", F.transform(F.map_entries("values"), lambda e: F.array(e["key"], F.round(e["value"] + 0.0, 6).cast("string"))).alias("cells"))


_SQL_FOLD = f"{SQL_X}, ce AS (SELECT gene, cell_type, sum(value) AS s, count(value) AS k FROM x GROUP BY 1, 2), ct AS (SELECT gene, sum(s) AS ts, sum(k) AS tk FROM ce GROUP BY 1), fo AS (SELECT gene, cell_type, round(s / k / ((ts - s) / (tk - k)), 9) AS fold FROM ce JOIN ct USING (gene) WHERE k > 0 AND tk > k AND (ts - s) / (tk - k) > 0)"


@R.add("expr_markers", f"WITH {_SQL_FOLD} SELECT cell_type, gene, round(fold, 6) AS fold, row_number() OVER (PARTITION BY cell_type ORDER BY fold DESC, gene) AS rank FROM fo WHERE fold >= 1.1 QUALIFY rank <= 50")
def expr_markers(spark: SparkSession, sf: str) -> DataFrame:
    return r6(X.markers(levels(spark, sf), 50, 1.1), "fold")


@R.add("expr_neuronal_genes", f"WITH {_SQL_FOLD} SELECT DISTINCT gene FROM fo WHERE fold >= 1.1 AND cell_type IN ('Excitatory L2', 'GABA Sst')")
def expr_neuronal_genes(spark: SparkSession, sf: str) -> DataFrame:
    return X.enriched_in(levels(spark, sf), ["excitatory_neuron", "inhibitory_neuron", "neuron"], 1.1)


# causal scenarios: the SQL writes each value out as arithmetic over the model's edges --------------------------------

T, Y, M = "SHANK3_variant", "asd_phenotype", "synaptic_pathway"
FACTS = {T: 1.0, Y: 0.9}


def sql_value(node: str, change: dict[str, float]) -> str:
    """The value of a node in one scenario as a SQL expression."""
    ps = [(s, k, w) for s, t, k, w in C.EXAMPLE if t == node]
    if node in change:
        return f"{change[node]}::DOUBLE"
    if not ps:
        return f"{C.ROOT}::DOUBLE"
    return "((" + " + ".join(f"{w} * {C.FACTOR.get(k, C.OTHER_FACTOR)} * {sql_value(s, change)}" for s, k, w in ps) + ") / (" + " + ".join(str(w) for _, _, w in ps) + "))"


def sql_effect(t: str = T, y: str = Y, given: dict[str, float] | None = None) -> str:
    g = given or {}
    return f"({sql_value(y, g | {t: 1.0})} - {sql_value(y, g | {t: 0.0})})"


def sql_would_be(change: dict[str, float], query: str = Y, facts: dict[str, float] = FACTS) -> str:
    """What the query would have been under the change: residuals of the facts against plain weighted means are kept."""

    def mean(n: str, of) -> str:
        ps = [(s, w) for s, t, _, w in C.EXAMPLE if t == n]
        return "((" + " + ".join(f"{w} * {of(s)}" for s, w in ps) + ") / (" + " + ".join(str(w) for _, w in ps) + "))" if ps else f"{C.ROOT}::DOUBLE"

    def known(n: str) -> str:
        return f"{facts[n]}::DOUBLE" if n in facts else mean(n, known)

    def new(n: str) -> str:
        if n in change:
            return f"{change[n]}::DOUBLE"
        residual = f" + ({facts[n]} - {mean(n, known)})" if n in facts else ""
        return f"least(1, greatest(0, {mean(n, new)}{residual}))"

    return new(query)


@R.add("scm_statistics", f"WITH {KN.SQL_DAG}, n AS (SELECT kind, source, target, unnest([source, target]) AS node FROM e) SELECT kind, count(DISTINCT (source, target)) AS n_edges, count(DISTINCT node) AS n_nodes FROM n GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT (source, target)), count(DISTINCT node) FROM n")
def scm_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return C.statistics(C.example(spark))


@R.add("scm_neighbours", f"WITH {KN.SQL_DAG}, n AS (SELECT source AS node_id FROM e UNION SELECT target FROM e) SELECT node_id, coalesce((SELECT list(DISTINCT source ORDER BY source) FROM e WHERE target = node_id), []) AS parents, coalesce((SELECT list(DISTINCT target ORDER BY target) FROM e WHERE source = node_id), []) AS children FROM n")
def scm_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return C.neighbours(C.example(spark))


@R.add("scm_without_edge", f"WITH RECURSIVE e0(source, target) AS (SELECT source, target FROM (WITH {KN.SQL_DAG} SELECT * FROM e) WHERE NOT (source = 'ancestry' AND target = '{T}')), c(ancestor, descendant) AS (SELECT source, target FROM e0 UNION SELECT ancestor, e0.target FROM c JOIN e0 ON descendant = e0.source) SELECT ancestor FROM c WHERE descendant = '{T}' OR descendant = '{Y}' GROUP BY 1")
def scm_without_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors of treatment or outcome once the confounder's edge is cut."""
    c = C.closure(C.without_edge(C.example(spark), "ancestry", T))
    return c.where(F.col("descendant").isin(T, Y)).select("ancestor").distinct()


@R.add("scm_variance", f"WITH RECURSIVE {KN.SQL_DAG}, p(first, last, strength) AS (SELECT source, target, strength FROM e UNION ALL SELECT first, e.target, p.strength * e.strength FROM p JOIN e ON last = e.source) SELECT round(least(0.25, 0.01 + sum((1 - strength) * 0.01)), 6) AS variance FROM p WHERE last = '{Y}'")
def scm_variance(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.variance(C.example(spark), Y), "variance")


@R.add("scm_cate", f"SELECT round({sql_effect(given={'CHD8_function': 0.9})}, 6) AS effect")
def scm_cate(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.effect(C.example(spark), T, Y, {"CHD8_function": 0.9}), "effect")


_WAY = [T, "SHANK3_function", M, "cortical_circuit", Y]


@R.add("scm_on_paths", " UNION ALL ".join(f"SELECT '{n}' AS node_id, round({sql_value(n, {T: 1.0})}, 6) AS value" for n in _WAY))
def scm_on_paths(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.on_paths(C.example(spark), T, Y, 1.0), "value")


@R.add("scm_identify", f"SELECT 'sum over ancestry of P({Y} | {T}, ancestry) P(ancestry)' AS formula")
def scm_identify(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(C.identify(C.example(spark), T, Y),)], "formula string")


@R.add("scm_sensitivity", f"SELECT s AS strength, round({sql_effect()} * (1 - s), 6) AS effect FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS s)")
def scm_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.sensitivity(C.example(spark), T, Y), "effect")


@R.add("scm_probabilities", f"SELECT round(least(1, greatest(0, 1 - {sql_would_be({T: 0.0})})), 6) AS necessity, round(least(1, greatest(0, {sql_would_be({T: 1.0})})), 6) AS sufficiency, round({sql_would_be({T: 1.0})} - {sql_would_be({T: 0.0})}, 6) AS individual_effect, round(least(1, greatest(0, {sql_effect()})), 6) AS both")
def scm_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.probabilities(C.example(spark), T, Y, FACTS), "necessity", "sufficiency", "individual_effect", "both")


_CHANGES = [{T: 0.0}, {M: 0.2}, {"CHD8_function": 1.0, T: 0.0}]
_WHAT = " UNION ALL ".join(f"SELECT {i} AS i, '{', '.join(f'{k}={v}' for k, v in sorted(c.items()))}' AS change, {FACTS[Y]}::DOUBLE AS factual, {sql_would_be(c)} AS counterfactual" for i, c in enumerate(_CHANGES))


@R.add("scm_what_if", f"SELECT change, factual, round(counterfactual, 6) AS counterfactual, round(counterfactual - factual, 6) AS difference, row_number() OVER (ORDER BY abs(counterfactual - factual) DESC, i) AS rank FROM ({_WHAT})")
def scm_what_if(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.what_if(C.example(spark), FACTS, _CHANGES, Y), "counterfactual", "difference")


@R.add("scm_controlled_direct", f"SELECT round({sql_effect(given={M: 0.4})}, 6) AS effect")
def scm_controlled_direct(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.controlled_effect(C.example(spark), T, Y, M, 0.4), "effect")


@R.add("scm_heterogeneity", " UNION ALL ".join(f"SELECT '{m}' AS modifier, {x}::DOUBLE AS level, round({sql_effect(given={m: x})}, 6) AS effect" for m in ("CHD8_function", "ancestry") for x in (0.0, 0.5, 1.0)))
def scm_heterogeneity(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.heterogeneity(C.example(spark), T, Y, ["CHD8_function", "ancestry"]), "effect")


def _mediation_sql(m: str) -> str:
    direct = f"({sql_value(Y, {T: 1.0}).replace(sql_value(m, {T: 1.0}), sql_value(m, {T: 0.0}))} - {sql_value(Y, {T: 0.0})})"
    return f"SELECT '{m}' AS mediator, {sql_effect()} AS total, {direct} AS direct"


@R.add("scm_mediators", "SELECT mediator, round(total, 6) AS total, round(direct, 6) AS direct, round(total - direct, 6) AS indirect, round(least(1, abs(coalesce((total - direct) / nullif(total, 0), 0))), 6) AS share FROM (" + " UNION ALL ".join(map(_mediation_sql, [M, "cortical_circuit", "SHANK3_function"])) + ")")
def scm_mediators(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.mediators(C.example(spark), T, Y, [M, "cortical_circuit", "SHANK3_function"]), "total", "direct", "indirect", "share")


_NODES = sorted({s for s, _, _, _ in C.EXAMPLE})


@R.add("scm_drivers", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS node_id, round({sql_effect(n)}, 6) AS effect" for n in _NODES) + ") WHERE abs(effect) >= 0.05")
def scm_drivers(spark: SparkSession, sf: str) -> DataFrame:
    """What moves the outcome: the candidates for an intervention."""
    return r6(C.drivers(C.example(spark), Y), "effect")


@R.add("scm_equation", f"SELECT round(greatest({sql_value(M, {T: 1.0})}, {sql_value('chromatin_pathway', {T: 1.0})}, {sql_value('ion_channel_pathway', {T: 1.0})}), 6) AS value")
def scm_equation(spark: SparkSession, sf: str) -> DataFrame:
    """A node with an equation of its own: the strongest of its parents."""
    v = C.propagate(C.example(spark), {"do": {T: 1.0}}, equations={"cortical_circuit": lambda p: F.greatest(*p.values())})
    return r6(v.where("node_id = 'cortical_circuit'").select("value"), "value")


@R.add("scm_query", f"SELECT '{Y}' AS node_id, round({sql_value(Y, {T: 1.0, 'ancestry': 0.2})}, 6) AS value")
def scm_query(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.Query().do(T, 1.0).on(Y).given(ancestry=0.2).build(C.example(spark)), "value").select("node_id", "value")


# evidence: curators stand for candidates, their kinds of evidence for mechanisms ---------------------------------------

SQL_CAND = "cd AS (SELECT curator AS candidate_id, min(coalesce(evidence, '')) AS mechanism, min(coalesce(gene_score, '')) AS status, round(count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM disease_genes) WHERE curator IS NOT NULL GROUP BY curator)), 6) AS relevance FROM (SELECT DISTINCT * FROM disease_genes) WHERE curator IS NOT NULL GROUP BY 1)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "disease_genes").distinct().where("curator IS NOT NULL").groupBy(F.col("curator").alias("candidate_id")).agg(F.min(F.coalesce("evidence", F.lit(""))).alias("mechanism"), F.min(F.coalesce("gene_score", F.lit(""))).alias("status"), F.count(F.lit(1)).alias("n"))
    top = by.agg(F.max("n").alias("m"))
    return by.crossJoin(F.broadcast(top)).select("candidate_id", "mechanism", "status", F.round(F.col("n") / F.col("m"), 6).alias("relevance"))


MECHANISMS = [("d1", "GABA receptor agonist", "GABA signalling"), ("d2", "mTOR inhibitor, immunosuppressant", "mTOR pathway"), ("d3", "SSRI serotonin transporter inhibitor", "serotonin synaptic"), ("d4", None, "chromatin"), ("d5", "HDAC inhibitor", "chromatin remodelling"), ("d6", "glutamate antagonist modulator", "synaptic glutamate")]
SQL_MECH = "mc(candidate_id, mechanism, set_name) AS (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, '{c}')" for a, b, c in MECHANISMS) + ")"
_HAS = lambda words, c: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words) + ")"
SQL_ALIGN = "CASE WHEN coalesce(mechanism, '') = '' THEN 0.3 ELSE least(1, 0.4 + " + " + ".join(f"CASE WHEN contains(lower(set_name), '{k}') AND {_HAS(w, 'mechanism')} THEN 0.3 ELSE 0 END" for k, w in K.HELPS.items()) + f" + CASE WHEN {_HAS(('receptor', 'transporter'), 'mechanism')} THEN 0.1 ELSE 0 END) END"
SQL_FLAGS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_HAS(w, 'mechanism')} THEN '{f}' END" for f, w in K.WORD_FLAGS) + "], lambda z: z IS NOT NULL))"


def mechanisms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MECHANISMS, "candidate_id string, mechanism string, set_name string")


@R.add("evidence_alignment", f"WITH {SQL_MECH} SELECT candidate_id, round({SQL_ALIGN}, 6) AS alignment, {SQL_FLAGS} AS flags, false AS critical FROM mc")
def evidence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    m = mechanisms(spark).withColumn("flags", K.safety_flags(F.lit(None).cast("array<string>"), F.col("mechanism")))
    return r6(m.select("candidate_id", K.alignment(F.col("mechanism"), F.col("set_name")).alias("alignment"), "flags", K.critical(F.col("flags")).alias("critical")), "alignment")


@R.add("evidence_search", f"WITH {SQL_CAND} SELECT candidate_id, relevance FROM cd WHERE relevance >= 0.2 AND contains(lower(candidate_id), 'a') AND status <> ''")
def evidence_search(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).withColumn("name", F.col("candidate_id"))
    return K.allowed(K.search(c, name="A", least=0.2), 0.2, ("",)).select("candidate_id", "relevance")


_SQL_HYP = f"WITH {KN.SQL_MAP}, {SQL_CAND}, h AS (SELECT candidate_id, pathway_id, plaus, mapping, relevance, CASE WHEN overlap >= 3 THEN 0.6 ELSE 0.3 END AS lit, CASE WHEN hit >= 1 THEN 0.4 ELSE 0.0 END AS clin, n_disrupted::DOUBLE AS z, overlap % 2 = 0 AS flagged FROM ms2 JOIN cd USING (candidate_id)), s AS (SELECT *, (plaus + 0.3 + lit) / 3 AS m FROM h), c AS (SELECT *, greatest(0.1, least(1, 0.1 + CASE WHEN plaus > 0.6 THEN 0.15 ELSE 0 END + CASE WHEN lit > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN clin > 0.3 THEN 0.3 ELSE 0 END + CASE WHEN sqrt(((plaus - m) ** 2 + (0.3 - m) ** 2 + (lit - m) ** 2) / 3) < 0.2 THEN 0.1 ELSE 0 END - CASE WHEN flagged THEN 0.1 ELSE 0 END)) AS conf FROM s)"


@R.add("rank_hypotheses", f"{_SQL_HYP} SELECT candidate_id, pathway_id, round(least(1, 0.4 * plaus + 0.3 * least(z / 4, 1) + 0.2 * relevance + 0.1 * mapping), 6) AS score, round(greatest(0.1, least(1, conf + CASE WHEN z > 2.5 THEN 0.1 ELSE 0 END - CASE WHEN flagged THEN 0.15 ELSE 0 END)), 6) AS confidence FROM c")
def rank_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Combined score and confidence of every candidate and set, with evidence from the counts of shared genes."""
    m = KN.mapped(spark, sf).join(candidates(spark, sf), "candidate_id")
    lit, clin, flagged, z = F.when(F.col("overlap") >= 3, 0.6).otherwise(0.3), F.when(F.col("hit") >= 1, 0.4).otherwise(0.0), F.col("overlap") % 2 == 0, F.col("n_disrupted").cast("double")
    conf = K.evidence_confidence(F.col("plaus"), F.lit(0.3), lit, clin, flagged)
    out = m.select("candidate_id", "pathway_id", K.hypothesis_score(F.col("plaus"), z, F.col("relevance"), F.col("mapping")).alias("score"), K.hypothesis_confidence(conf, z, F.lit(0.0), flagged).alias("confidence"))
    return r6(out, "score", "confidence")


@R.add("rank_statistics", f"{_SQL_HYP}, l AS (SELECT *, round(least(1, 0.4 * plaus + 0.3 * least(z / 4, 1) + 0.2 * relevance + 0.1 * mapping), 6) AS score FROM c) SELECT count(*) AS n_hypotheses, count_if(score >= 0.7) AS n_high, count(DISTINCT pathway_id) AS n_pathways, count(DISTINCT candidate_id) AS n_candidates FROM l")
def rank_statistics(spark: SparkSession, sf: str) -> DataFrame:
    h = rank_hypotheses(spark, sf)
    return h.agg(F.count(F.lit(1)).alias("n_hypotheses"), F.count_if(K.level(F.col("score")) == "high").alias("n_high"), F.count_distinct("pathway_id").alias("n_pathways"), F.count_distinct("candidate_id").alias("n_candidates"))


@R.add("evidence_upsert", f"WITH {SQL_CAND} SELECT candidate_id, CASE WHEN relevance > 0.5 THEN 0.9 WHEN status <> '' THEN 0.5 ELSE 0.3 END::DOUBLE AS score FROM cd")
def evidence_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Literature scores: a first table, better ones written over it, a default for the rest."""
    c = candidates(spark, sf)
    first = c.where("status <> ''").select("candidate_id", F.lit(0.5).alias("score"))
    better = c.where("relevance > 0.5").select("candidate_id", F.lit(0.9).alias("score"))
    return K.lookup(c, K.upsert(first, better, "candidate_id"), "candidate_id", "score", 0.3).select("candidate_id", "score")


# rules over gene sets ----------------------------------------------------------------------------------------

NAMES = ["focus", "target", "synaptic", "excitatory", "inhibitory", "expressed"]
SET_RULES = [
    RU.Rule("R1", "gene_effect", 0.9, ("lof", "constrained", "in_expressed")),
    RU.Rule("R3", "gene_effect", 0.92, ("damaging", "in_focus")),
    RU.Rule("R3b", "gene_effect", 0.6, ("damaging", "in_target")),
    RU.Rule("R4", "subtype", 0.82, ("damaging", "in_synaptic", "in_excitatory")),
    RU.Rule("R4b", "subtype", 0.8, ("damaging", "in_synaptic", "in_inhibitory")),
]
SQL_GENE_SETS = f"{KN.SQL_FACTS}, {_SQL_FOLD}, fo1 AS (SELECT DISTINCT gene, cell_type FROM fo WHERE fold >= 1.1), sets AS (SELECT 'focus' AS s, min(gene) AS gene FROM dg WHERE score = 1 UNION ALL SELECT 'target', symbol FROM gene_info WHERE strand = '+' AND chromosome IS NOT NULL UNION ALL SELECT 'synaptic', symbol FROM gene_info WHERE length(symbol) % 2 = 0 UNION ALL SELECT 'excitatory', gene FROM fo1 WHERE cell_type = 'Excitatory L2' UNION ALL SELECT 'inhibitory', gene FROM fo1 WHERE cell_type = 'GABA Sst' UNION ALL SELECT 'expressed', gene FROM x WHERE stage IN ('S0', 'S1', 'S2') GROUP BY gene HAVING max(value) >= 0.5), fs AS (SELECT fa.*, " + ", ".join(f"gene IN (SELECT gene FROM sets WHERE s = '{n}' AND gene IS NOT NULL) AS in_{n}" for n in NAMES) + " FROM fa), hs AS (" + " UNION ALL ".join(f"SELECT sample_id, gene, '{r.rule_id}' AS rule_id, '{r.kind}' AS kind, {r.confidence}::DOUBLE AS confidence FROM fs WHERE {' AND '.join(r.needs)}" for r in SET_RULES) + "), fz AS (SELECT sample_id, rule_id, kind, confidence, min(gene) AS gene, count(*) AS n_genes FROM hs GROUP BY 1, 2, 3, 4)"


def gene_sets(spark: SparkSession, sf: str) -> DataFrame:
    """set_name, gene: what rules ask about a gene, as data."""
    info, x = table(spark, sf, "gene_info"), levels(spark, sf)
    named = lambda df, name: df.select(F.lit(name).alias("set_name"), "gene")
    parts = [
        named(KN.disease(spark, sf).where("score = 1").agg(F.min("gene").alias("gene")), "focus"), named(info.where("strand = '+' AND chromosome IS NOT NULL").select(F.col("symbol").alias("gene")), "target"),
        named(info.where("length(symbol) % 2 = 0").select(F.col("symbol").alias("gene")), "synaptic"), named(X.enriched_in(x, ["excitatory_neuron"], 1.1), "excitatory"),
        named(X.enriched_in(x, ["inhibitory_neuron"], 1.1), "inhibitory"), named(X.expressed(x, PRENATAL, 0.5), "expressed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("gene IS NOT NULL")


def set_fired(spark: SparkSession, sf: str) -> DataFrame:
    return RU.fire_sets(RU.set_flags(KN.facts(spark, sf), gene_sets(spark, sf), NAMES), SET_RULES)


@R.add("rules_gene_sets", f"WITH {SQL_GENE_SETS} SELECT * FROM fz")
def rules_gene_sets(spark: SparkSession, sf: str) -> DataFrame:
    return set_fired(spark, sf)


@R.add("rules_steps", f"WITH {SQL_GENE_SETS}, ft AS (SELECT *, max(confidence) OVER (PARTITION BY sample_id, gene) AS top FROM fz) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY top DESC, gene, confidence DESC, rule_id) AS step, rule_id, gene FROM ft")
def rules_steps(spark: SparkSession, sf: str) -> DataFrame:
    return RU.steps(set_fired(spark, sf))


@R.add("rules_report", f"WITH {SQL_GENE_SETS} SELECT sample_id, kind, row_number() OVER (PARTITION BY sample_id, kind ORDER BY confidence DESC, rule_id, gene) AS rank, rule_id || ': ' || gene || ' (' || printf('%.2f', confidence) || ')' AS line FROM fz QUALIFY rank <= 5")
def rules_report(spark: SparkSession, sf: str) -> DataFrame:
    return RU.report_lines(set_fired(spark, sf))


@R.add("rules_independent", f"WITH {KN.SQL_FACTS} SELECT sample_id, count(DISTINCT gene) AS n_hits FROM fv WHERE damaging GROUP BY 1 HAVING count(DISTINCT gene) >= 2")
def rules_independent(spark: SparkSession, sf: str) -> DataFrame:
    return RU.independent_hits(KN.facts(spark, sf))


@R.add("rules_drug", f"WITH {KN.SQL_FACTS}, {Q.SQL_SETS}, hi AS (SELECT sample_id, pathway_id FROM fv JOIN m USING (gene) WHERE damaging GROUP BY 1, 2 HAVING count(DISTINCT gene) >= 2), ab AS (SELECT DISTINCT curator AS candidate_id, pathway_id FROM disease_genes JOIN m ON trim(gene_symbol, ' ') = gene WHERE curator IS NOT NULL AND lower(curator)[1] < 'm') SELECT sample_id, pathway_id, candidate_id FROM hi JOIN ab USING (pathway_id)")
def rules_drug(spark: SparkSession, sf: str) -> DataFrame:
    """Disrupted sets that a candidate reaches, where the words of mechanism and set agree."""
    typed = table(spark, sf, "disease_genes").where("curator IS NOT NULL")
    word = F.when(F.substring(F.lower("curator"), 1, 1) < "m", "Shared channel").otherwise("other")
    m = Q.membership(spark, sf)
    functions = m.select("pathway_id").distinct().withColumn("function", F.lit("channel of SHARED kind"))
    return RU.drug_rule(KN.facts(spark, sf), m, typed.select(F.col("curator").alias("candidate_id"), F.trim("gene_symbol").alias("gene")), typed.select(F.col("curator").alias("candidate_id"), word.alias("mechanism")).distinct(), functions)


# networks over two scores -----------------------------------------------------------------------------------

_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
WEIGHTS = {"gate": {"gate": (1.5, -0.5, 0.2)}, "mlp": {"a": (1.0, 0.5, -0.2), "b": (-0.7, 0.9, 0.1), "out": (0.8, 0.6, -0.3)}, "attention": {"neural": (1.0, 0.1, 0.0), "symbolic": (0.2, 0.8, 0.1)}, "rules": {"gate": (0.5, 0.5, 0.0), "rule": (0.3,)}}
_SQL_NET = {
    "gate": f"{_SIG('1.5 * n - 0.5 * s + 0.2')} * n + (1 - {_SIG('1.5 * n - 0.5 * s + 0.2')}) * s",
    "mlp": _SIG("0.8 * greatest(0, n + 0.5 * s - 0.2) + 0.6 * greatest(0, -0.7 * n + 0.9 * s + 0.1) - 0.3"),
    "attention": "(exp(n + 0.1 * s) * n + exp(0.2 * n + 0.8 * s + 0.1) * s) / (exp(n + 0.1 * s) + exp(0.2 * n + 0.8 * s + 0.1))",
    "rules": f"{_SIG('0.5 * n + 0.5 * s')} * n + (1 - {_SIG('0.5 * n + 0.5 * s')}) * s * (1 + 0.3 * s)",
}


def two_scores(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    neural = KN.constraint(spark, sf).where("pli IS NOT NULL").select("gene", F.col("pli").alias("score"))
    return neural, KN.rules_fired(spark, sf).groupBy("gene").agg(F.sum("confidence").alias("score"))


for _how, _sql in _SQL_NET.items():

    def _net(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return r6(RU.gated_scores(*two_scores(spark, sf), how, WEIGHTS[how]), "score")

    R.add(f"combine_net_{_how}", f"WITH {KN.SQL_TWO} SELECT gene, round({_sql}, 6) AS score FROM bo")(_net)


@R.add("combine_integrated", f"WITH {KN.SQL_TWO}, w AS (SELECT gene, 0.6 * n + 0.4 * s AS x FROM bo) SELECT gene, round(coalesce(x / nullif(max(x) OVER (), 0), 0), 6) AS score FROM w")
def combine_integrated(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RU.integrate(*two_scores(spark, sf)), "score")


@R.add("combine_learned")
def combine_learned(spark: SparkSession, sf: str) -> DataFrame:
    """The gate fitted to the genes of score 1 among the listed ones."""
    neural, symbolic = two_scores(spark, sf)
    labels = KN.disease(spark, sf).where("score IS NOT NULL").select("gene", (F.col("score") == 1).cast("int").alias("label"))
    return r6(RU.gated_scores(neural, symbolic, "gate", {"gate": RU.fit_gate(neural, symbolic, labels)}), "score")


# graph of several kinds, priors, propagated burdens -------------------------------------------------------------

SQL_TYPED = f"{KN.SQL_LONG}, {KN.SQL_EDGES}, {Q.SQL_SETS}, te AS (SELECT src, dst, edge_type FROM e UNION ALL SELECT DISTINCT gene, pathway_id, 'member_of' FROM m UNION ALL SELECT DISTINCT pathway_id, left(pathway_id, length(pathway_id) - 1), 'is_a' FROM m), tn AS (SELECT symbol AS node_id, 'gene' AS node_type FROM gene_info UNION SELECT pathway_id, 'pathway' FROM m UNION SELECT left(pathway_id, length(pathway_id) - 1), 'term' FROM m)"


def typed_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Genes, their sets and the terms above the sets: interactions, membership and hierarchy in one graph."""
    nodes, edges = KN.graph(spark, sf)
    m = Q.membership(spark, sf)
    sets = m.select("pathway_id").distinct().withColumn("term", F.expr("left(pathway_id, length(pathway_id) - 1)"))
    return G.assemble([(nodes, edges), G.membership_part(m), G.hierarchy_part(sets.select(F.col("pathway_id").alias("child"), F.col("term").alias("parent")), "pathway", "term")])


@R.add("kg_typed_edges", f"WITH {SQL_TYPED} SELECT edge_type, count(*) AS n FROM te GROUP BY 1")
def kg_typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return typed_graph(spark, sf)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("kg_typed_nodes", f"WITH {SQL_TYPED} SELECT node_type, count(*) AS n FROM tn GROUP BY 1")
def kg_typed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return typed_graph(spark, sf)[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("kg_interactions", "SELECT DISTINCT least(gene, 'P' || (row_id % 7)) AS src, greatest(gene, 'P' || (row_id % 7)) AS dst, round(mis_z / 1000, 6) AS weight FROM gene_constraints WHERE gene IS NOT NULL AND mis_z > 2 AND NOT isnan(mis_z)")
def kg_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions of a frame with a least score, whatever its columns are called; scores above 1 are per mille."""
    rows = table(spark, sf, "gene_constraints").where("gene IS NOT NULL AND NOT isnan(mis_z)").select("gene", F.concat(F.lit("P"), F.col("row_id") % 7).alias("partner"), "mis_z")
    return r6(G.interactions(rows, "gene", "partner", "mis_z", 2.0).drop("edge_type").distinct(), "weight")


for _how, _sql in (("minmax", "CASE WHEN max(pli) OVER () > min(pli) OVER () THEN (pli - min(pli) OVER ()) / (max(pli) OVER () - min(pli) OVER ()) ELSE 0.5 END"), ("zscore", "coalesce((pli - avg(pli) OVER ()) / nullif(stddev_pop(pli) OVER (), 0), 0)"), ("rank", "(rank() OVER (ORDER BY pli) - 1) / (count(*) OVER () - 1)")):

    def _prior(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return r6(N.priors(KN.constraint(spark, sf).where("pli IS NOT NULL").select("gene", F.col("pli").alias("value")), how), "prior")

    R.add(f"priors_{_how}", f"WITH {KN.SQL_CONSTRAINT}, p AS (SELECT gene, pli FROM lc WHERE pli IS NOT NULL) SELECT gene, round({_sql}, 6) AS prior FROM p")(_prior)


@R.add("norm_several", f"WITH {KN.SQL_CONSTRAINT}, p AS (SELECT gene, pli FROM lc WHERE pli IS NOT NULL) SELECT gene, round(coalesce((pli - avg(pli) OVER ()) / nullif(stddev_pop(pli) OVER (), 0), 0), 6) AS zscore, round((pli - min(pli) OVER ()) / (max(pli) OVER () - min(pli) OVER ()), 6) AS minmax FROM p")
def norm_several(spark: SparkSession, sf: str) -> DataFrame:
    v = KN.constraint(spark, sf).where("pli IS NOT NULL").select("gene", F.col("pli").alias("value"))
    return r6(N.priors(v, "zscore").withColumnRenamed("prior", "zscore").join(N.priors(v, "minmax").withColumnRenamed("prior", "minmax"), "gene"), "zscore", "minmax")


@R.add("prop_burdens")
def prop_burdens(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample's burdens spread over the network by three steps of a walk, then scored by set."""
    b = Q.burdens(spark, sf).select(F.col("sample_id").alias("key"), F.col("gene").alias("node_id"), "score")
    scored = G.walk_by_set(b, KN.graph(spark, sf)[1], Q.membership(spark, sf).withColumnRenamed("gene", "node_id"), 0.5, 3)
    return r6(scored.withColumnRenamed("key", "sample_id"), "score")

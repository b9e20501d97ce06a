"""Queries of clusterings side by side, vectors and graph networks, and of the composed analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import hashed as H
from lociflow.operators import burden as B
from lociflow.operators import causal as C
from lociflow.operators import clusterfit as CF
from lociflow.operators import clusterstats as CS
from lociflow.operators import consensus as S
from lociflow.operators import embeddings as E
from lociflow.operators import gnn as N
from lociflow.operators import graph as G
from lociflow.operators import verify as V
from lociflow.plans import cohort as Q
from lociflow.plans import inference as I
from lociflow.plans import knowledge as KN
from lociflow.plans.base import Registry
from lociflow.session import keep, table

R = Registry()
r6 = KN.r6
DIM = KN.DIM
SQL_U = f"{KN.SQL_VEC}, u AS (SELECT id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v)"
r4 = lambda c: F.transform(c, lambda x: F.when(F.round(x, 4) == 0, x * 0.0).otherwise(F.round(x, 4)))  # noqa: E731  # a zero keeps its sign, as in SQL

# clusterings ---------------------------------------------------------------------------------------------------


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return KN.vectors(spark, sf).select("id", "v")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """run, id, label of ten fits on samples and one on all rows."""
    return keep(S.bootstrap_labels(KN._x(spark, sf), 4, 10))


@R.add("fit_ward")
def fit_ward(spark: SparkSession, sf: str) -> DataFrame:
    return S.fit_ward(rows(spark, sf), DIM, 4)


@R.add("fit_spectral")
def fit_spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Genes by the network that lists them together."""
    nodes, edges = KN.graph(spark, sf)
    index = keep(G.node_index(nodes.select("node_id")))
    e = G.both_ways(edges).where("src < dst").join(index.select(F.col("node_id").alias("src"), F.col("idx").alias("a")), "src").join(index.select(F.col("node_id").alias("dst"), F.col("idx").alias("b")), "dst")
    return S.fit_spectral(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), 4)


@R.add("fit_methods")
def fit_methods(spark: SparkSession, sf: str) -> DataFrame:
    return S.fit_methods(rows(spark, sf), DIM, 4)


@R.add("fit_consensus")
def fit_consensus(spark: SparkSession, sf: str) -> DataFrame:
    x = KN._x(spark, sf)
    one = lambda r: CF.labels(CF.fit(x, "kmeans", 4, 42 + r), x).select(F.lit(r).alias("run"), "id", F.col("label").cast("int").alias("label"))
    out = None
    for f in CF.side_by_side(one, 10):
        out = f if out is None else out.unionByName(f)
    return S.consensus(out, 4)


@R.add("stability_records")
def stability_records(spark: SparkSession, sf: str) -> DataFrame:
    s = S.record_stability(runs(spark, sf))
    return r6(s.withColumn("core", F.col("stability") >= 0.9).withColumn("unstable", F.col("stability") < 0.7), "stability")


@R.add("stability_from_runs", "WITH l AS (SELECT assignment_id AS id, hard_label AS a, hard_label % 3 AS b, run_id AS run FROM (SELECT DISTINCT assignment_id, run_id, hard_label FROM cluster_assignments) WHERE hard_label IS NOT NULL AND run_id IS NOT NULL), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT a, sum(n) AS t FROM c GROUP BY 1) SELECT a AS label, round(sum(n * coalesce((n - 1) / nullif(t - 1, 0), 1)) / sum(n), 6) AS stability FROM c JOIN t USING (a) GROUP BY 1")
def stability_from_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean stability of the given labels against a coarser labelling of the same assignments."""
    a = table(spark, sf, "cluster_assignments").where("hard_label IS NOT NULL AND run_id IS NOT NULL").select(F.col("assignment_id").alias("id"), "run_id", F.col("hard_label").cast("int").alias("label")).distinct().withColumn("id", F.concat_ws(":", "id", "run_id", "label")).select("id", "label")
    two = a.select(F.lit(0).alias("run"), "id", "label").unionByName(a.select(F.lit(1).alias("run"), "id", (F.col("label") % 3).alias("label")))
    return r6(S.record_stability(two).groupBy("label").agg(F.avg("stability").alias("stability")), "stability")


@R.add("stability_best_k")
def stability_best_k(spark: SparkSession, sf: str) -> DataFrame:
    return r6(S.best_k(KN._x(spark, sf), range(2, 7), 10), "mean_ari")


@R.add("stability_methods")
def stability_methods(spark: SparkSession, sf: str) -> DataFrame:
    x, out = KN._x(spark, sf), None
    for m in ("kmeans", "bisecting"):
        one = CF.stability(x, 4, 10, m).agg(F.lit(m).alias("method"), F.avg("ari").alias("mean_ari"), F.avg("nmi").alias("mean_nmi"))
        out = one if out is None else out.unionByName(one)
    return r6(out.withColumn("rating", CS.rating(F.col("mean_ari"))), "mean_ari", "mean_nmi")


def cohort_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """id, v: standardised set scores of every sample, a cohort's matrix."""
    from lociflow.operators import normalize
    from lociflow.sources.tables import wide

    sets = sorted(r.pathway_id for r in B.sized(Q.membership(spark, sf)).select("pathway_id").distinct().collect())
    z = wide(normalize.zscore(Q.dense_scores(spark, sf)), sets)
    return keep(z.select(F.col("sample_id").alias("id"), F.array(*(F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) for p in sets)).alias("v")))


@R.add("control_suite")
def control_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Permuted features, random features and shuffled labels against the observed silhouette: 100 runs each."""
    x = cohort_matrix(spark, sf)
    f = keep(CF.features(x, len(x.first()["v"])))
    return r6(S.control_report(S.controls(x, CF.labels(CF.fit(f, "kmeans", 3), f), 3, 100)), "observed", "mean_null", "p_value", "z_score")


_CONTROL = "c AS (SELECT CASE vec_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS control, CASE WHEN vec_id < 3 THEN -1 ELSE vec_id END AS run, embedding[1]::DOUBLE AS value FROM embeddings)"


@R.add("control_report", f"WITH {_CONTROL}, o AS (SELECT control, value AS observed FROM c WHERE run < 0) SELECT control, round(observed, 6) AS observed, round(avg(value), 6) AS mean_null, round((count_if(value >= observed) + 1) / (count(*) + 1), 6) AS p_value, round(coalesce((observed - avg(value)) / nullif(stddev_pop(value), 0), 0), 6) AS z_score, (count_if(value >= observed) + 1) / (count(*) + 1) < 0.05 AS significant FROM c JOIN o USING (control) WHERE run >= 0 GROUP BY control, observed")
def control_report(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "embeddings"), F.col("vec_id") % 3
    c = e.select(F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("control"), F.when(F.col("vec_id") < 3, F.lit(-1)).otherwise(F.col("vec_id")).alias("run"), F.col("embedding")[0].cast("double").alias("value"))
    return r6(S.control_report(c), "observed", "mean_null", "p_value", "z_score")


@R.add("clu_gene_frequency", f"WITH {KN.SQL_FACTS}, p AS (SELECT sample_id, min(planted_subtype) AS label FROM phenotypes WHERE planted_subtype IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1), z AS (SELECT label, count(*) AS size FROM p GROUP BY 1) SELECT label, gene, round(count(DISTINCT p.sample_id) / any_value(size), 6) AS share FROM p JOIN fv USING (sample_id) JOIN z USING (label) WHERE damaging GROUP BY 1, 2 HAVING count(DISTINCT p.sample_id) / any_value(size) >= 0.02")
def clu_gene_frequency(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "phenotypes").where("planted_subtype IS NOT NULL AND sample_id IS NOT NULL").groupBy(F.col("sample_id").alias("id")).agg(F.min("planted_subtype").alias("label"))
    hits = KN.facts(spark, sf).where("has_damaging").select(F.col("sample_id").alias("id"), "gene")
    return r6(S.gene_frequency(labels, hits, 0.02), "share")


@R.add("clu_compare", f"WITH {SQL_U}, m AS (SELECT i, label, avg(x) AS m FROM u GROUP BY 1, 2), s AS (SELECT 'f' || i AS feature, var_pop(m) AS variance, list(round(m, 4) ORDER BY label) AS means FROM m GROUP BY i) SELECT feature, round(variance, 6) AS variance, means FROM s ORDER BY round(variance, 9) DESC, feature LIMIT 20")
def clu_compare(spark: SparkSession, sf: str) -> DataFrame:
    long = KN.vectors(spark, sf).select("label", F.posexplode("v").alias("p", "value")).select("label", F.concat(F.lit("f"), F.col("p") + 1).alias("feature"), "value")
    return r6(S.compare(long).withColumn("means", r4("means")), "variance")


@R.add("clu_centre_distances", f"WITH {SQL_U}, m AS (SELECT i, label, avg(x) AS m FROM u GROUP BY 1, 2) SELECT p.label AS a, q.label AS b, round(sqrt(sum((p.m - q.m) ** 2)), 6) AS distance FROM m p JOIN m q ON p.i = q.i AND p.label < q.label GROUP BY 1, 2")
def clu_centre_distances(spark: SparkSession, sf: str) -> DataFrame:
    return r6(S.centre_distances(CS.centroids(KN.vectors(spark, sf), DIM)), "distance")


@R.add("conf_report")
def conf_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each possible confounder of the subtypes, tested by its kind, Bonferroni-corrected."""
    p = KN.people(spark, sf).where("planted_subtype IS NOT NULL").select(F.col("planted_subtype").alias("label"), "cohort", "diagnosis", F.col("age").alias("age_at_diagnosis"), F.col("iq").alias("iq_score"))
    return r6(S.confounds(keep(p), ["cohort", "diagnosis", "age_at_diagnosis", "iq_score"]), "statistic", "effect", "p_value")


# vectors and graph networks: rows of embeddings, in groups of five that point to their first row -----------------------

SQL_G = f"{SQL_U}, ed AS (SELECT id AS src, id - id % 5 AS dst, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS edge_type, 1.0 + id % 3 AS weight FROM v WHERE id % 5 <> 0)"
_LISTED = "SELECT id, list(round(x, 4) ORDER BY i) AS v FROM o GROUP BY 1"


def star(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = KN.vectors(spark, sf)
    return v.select("id", "v"), v.where("id % 5 <> 0").select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 5).alias("dst"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("edge_type"), (1.0 + F.col("id") % 3).alias("weight"))


def listed(df: DataFrame) -> DataFrame:
    return df.select("id", r4("v").alias("v"))


@R.add("gnn_typed_messages", f"WITH {SQL_G}, o AS (SELECT dst AS id, i, sum(weight * x * CASE edge_type WHEN 'even' THEN 2.0 ELSE -0.5 END) / sum(weight) AS x FROM ed JOIN u ON u.id = src GROUP BY 1, 2) {_LISTED}")
def gnn_typed_messages(spark: SparkSession, sf: str) -> DataFrame:
    return listed(N.typed_messages(*star(spark, sf), {"even": 2.0, "odd": -0.5}, DIM))


_ATT = "sc AS (SELECT src, dst, any_value(weight) AS weight, sum(a.x * b.x) / 8 AS s FROM ed JOIN u a ON a.id = src JOIN u b ON b.id = dst AND a.i = b.i GROUP BY 1, 2)"


@R.add("gnn_attention", f"WITH {SQL_G}, {_ATT}, w AS (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) AS w FROM sc), o AS (SELECT dst AS id, i, sum(w * x) AS x FROM w JOIN u ON u.id = src GROUP BY 1, 2) {_LISTED}")
def gnn_attention(spark: SparkSession, sf: str) -> DataFrame:
    return listed(N.attention(*star(spark, sf), DIM))


@R.add("gnn_prior_attention", f"WITH {SQL_G}, {_ATT}, w AS (SELECT src, dst, weight * exp(s) / sum(weight * exp(s)) OVER (PARTITION BY dst) AS w FROM sc), o AS (SELECT dst AS id, i, sum(w * x) AS x FROM w JOIN u ON u.id = src GROUP BY 1, 2) {_LISTED}")
def gnn_prior_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Attention that a prior on each edge weighs."""
    return listed(N.attention(*star(spark, sf), DIM, F.col("weight")))


@R.add("gnn_term_similarity", f"WITH {Q.SQL_SETS}, a AS (SELECT pathway_id AS term, gene FROM m UNION SELECT left(pathway_id, length(pathway_id) - 1), gene FROM m), n AS (SELECT term, count(DISTINCT gene) AS n FROM a GROUP BY 1), k AS (SELECT x.term AS src, y.term AS dst, count(*) AS k FROM a x JOIN a y ON x.gene = y.gene AND x.term <> y.term GROUP BY 1, 2) SELECT src, dst, round(k / (p.n + q.n - k), 6) AS weight FROM k JOIN n p ON p.term = src JOIN n q ON q.term = dst")
def gnn_term_similarity(spark: SparkSession, sf: str) -> DataFrame:
    m = Q.membership(spark, sf)
    return r6(N.term_similarity(m.select(F.col("pathway_id").alias("term"), "gene").unionByName(m.select(F.expr("left(pathway_id, length(pathway_id) - 1)").alias("term"), "gene"))), "weight")


@R.add("gnn_co_attention")
def gnn_co_attention(spark: SparkSession, sf: str) -> DataFrame:
    m = Q.membership(spark, sf)
    genes, sets = (m.select(F.col(c).alias("id")).distinct().select("id", H.hash_vector(F.col("id"), 16).alias("v")) for c in ("gene", "pathway_id"))
    a, b = N.co_attention(genes, sets, m.select("gene", F.col("pathway_id").alias("set")), 16)
    return a.unionByName(b)


@R.add("gnn_hierarchy", f"WITH {SQL_G}, me AS (SELECT dst AS id, i, avg(x) AS m FROM ed JOIN u ON u.id = src GROUP BY 1, 2), o AS (SELECT u.id, i, CASE WHEN m IS NULL THEN x ELSE 0.5 * x + 0.5 * m END AS x FROM u LEFT JOIN me USING (id, i)) {_LISTED}")
def gnn_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    v, e = star(spark, sf)
    return listed(E.propagate_up(v, e.select(F.col("src").alias("child"), F.col("dst").alias("parent")), DIM, 1))


@R.add("gnn_forward")
def gnn_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The whole network over genes, sets and terms, from hashed vectors."""
    nodes, edges = I.typed_graph(spark, sf)
    vectors = nodes.select(F.col("node_id").alias("id")).distinct().select("id", H.hash_vector(F.col("id"), 16).alias("v"))
    parents = edges.where("edge_type = 'is_a'").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    return N.forward(vectors, nodes.select(F.col("node_id").alias("id"), "node_type"), edges, parents, (16, 8))


@R.add("gnn_train")
def gnn_train(spark: SparkSession, sf: str) -> DataFrame:
    """Genes of score 1 told from the other listed ones by their node vectors: the area under the curve on the genes it was fit to."""
    vectors = keep(gnn_forward(spark, sf))
    labels = KN.disease(spark, sf).where("score IS NOT NULL").select(F.col("gene").alias("id"), (F.col("score") == 1).cast("int").alias("label"))
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = N.train_readout(vectors, labels)
    scored = model.transform(vectors.join(labels, "id").select("id", array_to_vector("v").alias("features"), (F.col("label") == 1).alias("hit")))
    return r6(E.auc(scored.select(vector_to_array("probability")[1].alias("score"), F.col("hit").alias("label"))), "auc")


@R.add("vec_fuse_attention", f"WITH {SQL_U}, p AS (SELECT a.id, a.i, a.x AS p, b.x AS q FROM u a JOIN u b ON b.id = a.id + 1 AND a.i = b.i), s AS (SELECT id, sum(p * p) / 8 AS pp, sum(p * q) / 8 AS pq, sum(q * q) / 8 AS qq FROM p GROUP BY 1), w AS (SELECT id, (exp(pp) / (exp(pp) + exp(pq)) + exp(pq) / (exp(pq) + exp(qq))) / 2 AS wp FROM s), o AS (SELECT id, i, wp * p + (1 - wp) * q AS x FROM p JOIN w USING (id)) {_LISTED}")
def vec_fuse_attention(spark: SparkSession, sf: str) -> DataFrame:
    v = rows(spark, sf)
    return listed(E.fuse_attention([v, KN._next(v)]))


@R.add("vec_fuse_pca")
def vec_fuse_pca(spark: SparkSession, sf: str) -> DataFrame:
    v = rows(spark, sf)
    return E.fuse_pca(v, KN._next(v))


@R.add("vec_fuse_learned")
def vec_fuse_learned(spark: SparkSession, sf: str) -> DataFrame:
    v = rows(spark, sf)
    return E.fuse_learned(v, KN._next(v), N.draw(2 * DIM, 32, 1), N.draw(32, 16, 2))


@R.add("link_predict_tails", f"WITH {SQL_U}, q AS (SELECT id, i, x + 0.01 AS x FROM u WHERE id % 100 = 0), d AS (SELECT q.id AS head, u.id AS tail, sqrt(sum((q.x - u.x) ** 2)) AS d FROM q JOIN u USING (i) WHERE q.id <> u.id AND u.id <> q.id + 1 GROUP BY 1, 2) SELECT head, tail, round(d, 5) AS distance, row_number() OVER (PARTITION BY head ORDER BY round(d, 9), tail::VARCHAR) AS rank FROM d QUALIFY rank <= 10")
def link_predict_tails(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest tails of every hundredth head; the next row is known and filtered out."""
    v = rows(spark, sf)
    heads = v.where("id % 100 = 0").select(F.col("id").alias("head"), F.lit("next").alias("relation"))
    relations = spark.createDataFrame([("next", [0.01] * DIM)], "id string, v array<double>")
    known = heads.select("head", "relation", (F.col("head") + 1).alias("tail"))
    return E.predict_tails(heads, v, relations, 10, known).select("head", "tail", F.round("distance", 5).alias("distance"), "rank")


@R.add("link_distance", f"WITH {SQL_U} SELECT a.id AS head, b.id AS tail, round(sqrt(sum((a.x + 0.01 - b.x) ** 2)), 6) AS distance FROM u a JOIN u b ON b.id = a.id + 2 AND a.i = b.i GROUP BY 1, 2")
def link_distance(spark: SparkSession, sf: str) -> DataFrame:
    v = rows(spark, sf)
    t = v.select(F.col("id").alias("head"), F.lit("next").alias("relation"), (F.col("id") + 2).alias("tail"))
    return r6(E.link_distance(t, v, spark.createDataFrame([("next", [0.01] * DIM)], "id string, v array<double>")).select("head", "tail", "distance"), "distance")


@R.add("link_adversarial_loss", f"WITH {KN.SQL_VEC}, d AS (SELECT id, abs(v[1]) AS p, [abs(v[2]), abs(v[3]) + 5, abs(v[4]) + 7] AS n FROM v), s AS (SELECT id, p, unnest(n) AS x FROM d), w AS (SELECT id, p, x, exp(x) / sum(exp(x)) OVER (PARTITION BY id) AS w FROM s) SELECT id, round(ln(1 + exp(-(6 - any_value(p)))) + sum(w * ln(1 + exp(-(x - 6)))), 6) AS loss FROM w GROUP BY 1")
def link_adversarial_loss(spark: SparkSession, sf: str) -> DataFrame:
    v, a = rows(spark, sf), lambda i: F.abs(F.col("v")[i])
    return r6(v.select("id", E.adversarial_loss(a(0), F.array(a(1), a(2) + 5, a(3) + 7)).alias("loss")), "loss")


@R.add("train_rotation")
def train_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with the vector that training ends with, and the best epoch of its history."""
    t = Q.membership(spark, sf).select(F.col("gene").alias("head"), F.lit("member_of").alias("relation"), F.col("pathway_id").alias("tail"))
    vectors, history = E.train_rotation(t)
    return vectors.crossJoin(F.broadcast(E.best_epoch(history).select("epoch")))


@R.add("vec_subset", f"WITH {KN.SQL_VEC} SELECT id, round(v[1], 6) AS first FROM v WHERE id IN (SELECT id + 1 FROM v WHERE label = 0)")
def vec_subset(spark: SparkSession, sf: str) -> DataFrame:
    v = KN.vectors(spark, sf)
    return r6(E.subset(v.select("id", "v"), v.where("label = 0").select((F.col("id") + 1).alias("id"))).select("id", F.col("v")[0].alias("first")), "first")


@R.add("vec_batches", "SELECT count(*) AS n, least(100, count(*)) AS largest FROM embeddings")
def vec_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = E.batches(rows(spark, sf).select("id"), 100).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return b.agg(F.sum("n").alias("n"), F.max("n").alias("largest"))


@R.add("gene_normal_id", "SELECT DISTINCT gene AS value, CASE WHEN regexp_matches(trim(gene, ' '), '^ENS[GP]') THEN trim(gene, ' ') ELSE upper(trim(gene, ' ')) END AS id FROM gene_constraints WHERE gene IS NOT NULL")
def gene_normal_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gene_constraints").where("gene IS NOT NULL").select(F.col("gene").alias("value"), H.normal_id(F.col("gene")).alias("id")).distinct()


@R.add("vec_context_genes")
def vec_context_genes(spark: SparkSession, sf: str) -> DataFrame:
    types = spark.createDataFrame([("excitatory",), ("microglia",)], "cell_type string")
    return table(spark, sf, "gene_info").select("symbol").crossJoin(F.broadcast(types)).select("symbol", "cell_type", H.context_vector(F.col("symbol"), F.col("cell_type"), 32).alias("v"))


_SEQ = "rpad(regexp_replace(upper(symbol), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'), 8, 'MKDE')"
_GRP = lambda c: f"CASE WHEN {c} IN ('A', 'I', 'L', 'M', 'F', 'W', 'V') THEN 1 WHEN {c} IN ('S', 'T', 'N', 'Q') THEN 2 WHEN {c} IN ('K', 'R', 'H') THEN 3 WHEN {c} IN ('D', 'E') THEN 4 WHEN {c} IN ('C', 'G', 'P') THEN 5 ELSE 6 END"


@R.add("variant_effects", f"WITH s AS (SELECT symbol, {_SEQ} AS q FROM gene_info), e AS (SELECT symbol, p AS position, substr(q, p, 1) AS ref, a AS alt FROM s, (SELECT unnest([1, 3, 8]) AS p), (SELECT unnest(['K', 'D', 'A']) AS a)) SELECT symbol, position, ref, alt, CASE WHEN ref = alt THEN 0 WHEN {_GRP('ref')} = {_GRP('alt')} THEN 0.3 WHEN {_GRP('ref')} IN (3, 4) AND {_GRP('alt')} IN (3, 4) THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM e")
def variant_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions at three places of a made-up sequence for every gene; ones whose residue is not there are left out."""
    q = F.rpad(F.regexp_replace(F.upper("symbol"), "[^ACDEFGHIKLMNPQRSTVWY]", ""), 8, "MKDE")
    s = table(spark, sf, "gene_info").select("symbol", q.alias("q"))
    one = lambda p, ref, a: F.struct(F.lit(p).alias("position"), ref.alias("ref"), F.lit(a).alias("alt"))
    right = [one(p, F.substring("q", p, 1), a) for p in (1, 3, 8) for a in "KDA"]
    wrong = [one(2, F.lit("*"), "A"), one(99, F.lit("A"), "K")]
    return s.select("symbol", F.inline(H.variant_effects(F.col("q"), F.array(*right, *wrong)))).withColumn("score", F.col("score").cast("double"))


# composed analyses, and runs held against each other ------------------------------------------------------------------


@R.add("pipe_hypotheses", f"{I._SQL_HYP}, l AS (SELECT candidate_id, pathway_id, round(least(1, 0.4 * plaus + 0.3 * least(z / 4, 1) + 0.2 * relevance + 0.1 * mapping), 6) AS score FROM c), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, pathway_id) = 1) SELECT pathway_id, count(*) AS n_candidates, max(score) AS best, arg_max(candidate_id, (score, candidate_id)) AS leader FROM b GROUP BY 1")
def pipe_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates scored against disrupted sets, each with its best set, grouped by set."""
    from lociflow.operators.ranking import first_set

    best = first_set(I.rank_hypotheses(spark, sf).withColumn("set_score", F.col("score")))
    return best.groupBy("pathway_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("score").alias("best"), F.max_by("candidate_id", F.struct("score", "candidate_id")).alias("leader"))


@R.add("pipe_validated")
def pipe_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses with the causal effect of their set's part of the model on the outcome, and whether it supports them."""
    effects, parts = C.drivers(C.example(spark), I.Y, 0.0), ("synaptic_pathway", "chromatin_pathway", "ion_channel_pathway")
    node = F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.hash("pathway_id"), F.lit(len(parts))) + 1).cast("int"))
    h = I.rank_hypotheses(spark, sf).withColumn("node_id", node).join(F.broadcast(effects), "node_id", "left")
    return h.select("candidate_id", "pathway_id", "score", F.coalesce("effect", F.lit(0.0)).alias("effect"), (F.coalesce("effect", F.lit(0.0)) >= 0.1).alias("supported"))


@R.add("pipe_individual_model", f"WITH {KN.SQL_FACTS} SELECT sample_id, count(*) AS n_genes, round(least(1, sum(CASE WHEN lof THEN 0.9 WHEN damaging THEN 0.6 ELSE 0 END) / count(*)), 6) AS load FROM fv GROUP BY 1")
def pipe_individual_model(spark: SparkSession, sf: str) -> DataFrame:
    """For every sample the evidence its variants give to a causal model: one node a gene, its function lost by severity."""
    f = KN.facts(spark, sf)
    lost = F.when(F.col("has_lof"), 0.9).when(F.col("has_damaging"), 0.6).otherwise(0.0)
    return r6(f.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_genes"), F.least(F.lit(1.0), F.sum(lost) / F.count(F.lit(1))).alias("load")), "load")


@R.add("verify_runs", f"WITH {KN.SQL_CONSTRAINT} SELECT count(*) AS rows, count_if(loeuf IS NULL) AS only_a, 0::BIGINT AS only_b, count_if(loeuf IS NOT NULL AND pli > 0.5) AS differ, round(coalesce(max(CASE WHEN loeuf IS NOT NULL THEN CASE WHEN pli > 0.5 THEN 0.25 ELSE 0 END END), 0), 6) AS largest FROM lc WHERE pli IS NOT NULL")
def verify_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A table against a second run of it that lacks some rows and has other values in some."""
    a = KN.constraint(spark, sf).where("pli IS NOT NULL")
    b = a.where("loeuf IS NOT NULL").withColumn("pli", F.col("pli") + F.when(F.col("pli") > 0.5, 0.25).otherwise(0.0))
    return r6(V.compare_tables(a, b, ["gene"], "pli"), "largest")


@R.add("verify_metrics", "WITH v AS (SELECT (SELECT count(*) FROM gene_info)::DOUBLE AS genes, (SELECT count(DISTINCT vec_id) FROM embeddings)::DOUBLE AS vectors) SELECT 'genes' AS metric, genes AS value, 1500.0::DOUBLE AS expected, 0.0::DOUBLE AS tolerance, genes = 1500 AS passed FROM v UNION ALL SELECT 'vectors', vectors, 10.0, 1.0, abs(vectors - 10) <= 1 FROM v UNION ALL SELECT 'absent', NULL, 1.0, 1.0, false")
def verify_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "gene_info").agg(F.lit("genes").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    m = table(spark, sf, "embeddings").agg(F.lit("vectors").alias("metric"), F.count_distinct("vec_id").cast("double").alias("value"))
    expected = spark.createDataFrame([("genes", 1500.0, 0.0), ("vectors", 10.0, 1.0), ("absent", 1.0, 1.0)], "metric string, expected double, tolerance double")
    return V.check_metrics(n.unionByName(m), expected)

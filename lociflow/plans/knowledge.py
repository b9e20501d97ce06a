"""Queries over reference tables, graphs, vectors, cluster labels, rules, rankings and causal models (steps 7 to 16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators import burden as B
from lociflow.operators import causal as C
from lociflow.operators import clusterfit as CF
from lociflow.operators import clusterstats as CS
from lociflow.operators import embeddings as E
from lociflow.operators import graph as G
from lociflow.operators import normalize as N
from lociflow.operators import ranking as K
from lociflow.operators import reference as T
from lociflow.operators import rules as RU
from lociflow.operators.gates import run_all, search
from lociflow.plans import cohort as Q
from lociflow.plans.base import Registry
from lociflow.session import keep, table
from lociflow.sources.tables import wide

R = Registry()
#: Ten decimals where values are short decimals that six would cut in the middle of a tie.
r10 = lambda df, *cols: df.withColumns({c: F.round(F.col(c) + 0.0, 10) for c in cols})
r6 = lambda df, *cols: df.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in cols})

# reference tables -----------------------------------------------------------------------------------------

_ok = lambda c, lo, hi: f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN {lo} AND {hi} THEN {c} END"
_last = lambda c, lo, hi: f"arg_max({_ok(c, lo, hi)}, (released_at, row_id)) FILTER ({_ok(c, lo, hi)} IS NOT NULL) AS {c}"
SQL_CONSTRAINT = f"lc AS (SELECT gene, {_last('pli', 0, 1)}, {_last('loeuf', 0, 3)}, {_last('mis_z', -100, 100)}, {_last('syn_z', -100, 100)} FROM (SELECT DISTINCT * FROM gene_constraints) WHERE gene IS NOT NULL AND trim(gene, ' ') <> '' GROUP BY 1)"
SQL_DISEASE = """dg AS (SELECT gene, min(score) AS score, bool_or(syn) AS syndromic, list_sort(list_distinct(flatten(list(kinds)))) AS evidence FROM (
    SELECT trim(gene_symbol, ' ') AS gene, CASE WHEN try_cast(regexp_replace(coalesce(gene_score, ''), '[^0-9]', '', 'g') AS INT) BETWEEN 1 AND 3 THEN try_cast(regexp_replace(coalesce(gene_score, ''), '[^0-9]', '', 'g') AS INT) END AS score,
           lower(trim(coalesce(syndromic, ''), ' ')) IN ('1', 'yes', 'true', 'y') AS syn, list_filter(list_transform(string_split(coalesce(evidence, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS kinds
    FROM disease_genes WHERE gene_symbol IS NOT NULL AND trim(gene_symbol, ' ') <> '') GROUP BY 1)"""


def constraint(spark: SparkSession, sf: str) -> DataFrame:
    return T.latest_constraint(table(spark, sf, "gene_constraints"))


def disease(spark: SparkSession, sf: str) -> DataFrame:
    return T.disease_genes(table(spark, sf, "disease_genes"))


@R.add("constraint_latest", f"WITH {SQL_CONSTRAINT} SELECT gene, pli, loeuf, mis_z, syn_z FROM lc")
def constraint_latest(spark: SparkSession, sf: str) -> DataFrame:
    return constraint(spark, sf)


@R.add("constrained_genes", f"WITH {SQL_CONSTRAINT} SELECT gene FROM lc WHERE coalesce(pli >= 0.9, false) OR coalesce(loeuf <= 0.35, false)")
def constrained_genes(spark: SparkSession, sf: str) -> DataFrame:
    return constraint(spark, sf).where(T.is_constrained(0.9, 0.35)).select("gene")


@R.add("constraint_percentile", f"WITH {SQL_CONSTRAINT} SELECT gene, round(100 * cume_dist() OVER (ORDER BY loeuf DESC), 6) AS percentile FROM lc WHERE loeuf IS NOT NULL")
def constraint_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.percentile(constraint(spark, sf), "loeuf", True), "percentile")


@R.add("disease_gene_table", f"WITH {SQL_DISEASE} SELECT gene, score, syndromic, evidence FROM dg")
def disease_gene_table(spark: SparkSession, sf: str) -> DataFrame:
    return disease(spark, sf)


@R.add("constrained_disease_genes", f"WITH {SQL_CONSTRAINT}, {SQL_DISEASE} SELECT gene FROM lc WHERE pli >= 0.9 INTERSECT SELECT gene FROM dg WHERE score <= 2")
def constrained_disease_genes(spark: SparkSession, sf: str) -> DataFrame:
    return constraint(spark, sf).where(T.is_constrained()).select("gene").intersect(disease(spark, sf).where("score <= 2").select("gene"))


@R.add("prior_weights", f"WITH {SQL_CONSTRAINT}, {SQL_DISEASE} SELECT gene, round(least(1, 0.5 * coalesce(pli, 0) + 0.5 * coalesce(1 - (score - 1) / 3, 0)), 6) AS weight FROM lc FULL JOIN dg USING (gene) WHERE pli IS NOT NULL OR score IS NOT NULL")
def prior_weights(spark: SparkSession, sf: str) -> DataFrame:
    return r6(T.prior_weights(constraint(spark, sf), disease(spark, sf)), "weight")


SQL_IDS = """i0 AS (SELECT symbol AS id, symbol, 1 AS p FROM gene_info UNION ALL SELECT ensembl_id, symbol, 2 FROM gene_info UNION ALL SELECT entrez_id, symbol, 3 FROM gene_info
    UNION ALL SELECT unnest(aliases), symbol, 4 FROM gene_info UNION ALL SELECT lower(symbol), symbol, 5 FROM gene_info), ids AS (SELECT id, arg_min(symbol, (p, symbol)) AS symbol FROM i0 WHERE id IS NOT NULL GROUP BY 1)"""


@R.add("id_resolve", f"WITH {SQL_IDS} SELECT value, coalesce(e.symbol, l.symbol) AS symbol FROM (SELECT DISTINCT gene AS value FROM gene_constraints WHERE gene IS NOT NULL) v LEFT JOIN ids e ON e.id = value LEFT JOIN ids l ON l.id = lower(value)")
def id_resolve(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "gene_constraints").where("gene IS NOT NULL").select(F.col("gene").alias("value")).distinct()
    return T.resolve(values, "value", T.identifier_table(table(spark, sf, "gene_info"))).select("value", "symbol")


@R.add("interval_overlap", f"WITH {Q.SQL_ROWS}, st AS (SELECT DISTINCT chrom, pos FROM t) SELECT symbol, count(*) AS n_sites FROM st JOIN gene_info ON chrom = 'chr' || chromosome AND pos BETWEEN start_bp AND end_bp GROUP BY 1")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    sites = Q.rows(spark, sf).select("chrom", "pos").distinct()
    genes = table(spark, sf, "gene_info").withColumn("chromosome", F.concat(F.lit("chr"), "chromosome"))
    return T.in_genes(sites, genes).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_sites"))


SQL_LONG = "e0 AS (SELECT profile_id, run_id, subtype_id, unnest(top_genes) AS g FROM (SELECT DISTINCT profile_id, run_id, subtype_id, top_genes FROM subtype_profiles)), el AS (SELECT g.gene AS gene, subtype_id, g.importance AS value FROM e0 WHERE g.gene IS NOT NULL)"


def top_genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "subtype_profiles").select("profile_id", "subtype_id", "top_genes").distinct().select("profile_id", "subtype_id", F.inline("top_genes")).where("gene IS NOT NULL").select("profile_id", "gene", "subtype_id", F.col("importance").alias("value"))


@R.add("group_specific_genes", f"WITH {SQL_LONG}, ce AS (SELECT gene, subtype_id, sum(value) AS s, count(value) AS k FROM el GROUP BY 1, 2), ct AS (SELECT gene, sum(s) AS ts, sum(k) AS tk FROM ce GROUP BY 1) SELECT gene, subtype_id, round(s / k, 10) AS here, round((ts - s) / (tk - k), 10) AS elsewhere, round(s / k / ((ts - s) / (tk - k)), 10) AS fold FROM ce JOIN ct USING (gene) WHERE k > 0 AND tk > k AND (ts - s) / (tk - k) > 0 AND s / k / ((ts - s) / (tk - k)) >= 1.2")
def group_specific_genes(spark: SparkSession, sf: str) -> DataFrame:
    return r10(T.specific(top_genes(spark, sf).drop("profile_id"), "subtype_id", 1.2), "here", "elsewhere", "fold")


# graph ----------------------------------------------------------------------------------------------------

SQL_EDGES = "pg AS (SELECT DISTINCT profile_id, g.gene AS gene FROM e0 WHERE g.gene IS NOT NULL), ed AS (SELECT a.gene AS src, b.gene AS dst, 'co_listed' AS edge_type, count(*)::DOUBLE AS weight FROM pg a JOIN pg b ON a.profile_id = b.profile_id AND a.gene < b.gene GROUP BY 1, 2), e AS (SELECT src, dst, edge_type, CASE WHEN weight > 1 THEN weight / 1000 ELSE weight END AS weight FROM ed WHERE src IN (SELECT symbol FROM gene_info) AND dst IN (SELECT symbol FROM gene_info))"
SQL_BOTH = "e2 AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2)"
SQL_GRAPH = f"WITH {SQL_LONG}, {SQL_EDGES}, {SQL_BOTH}"


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Genes, linked where a profile lists both; a list is short, so its pairs are made inside the row."""
    lists = top_genes(spark, sf).groupBy("profile_id").agg(F.sort_array(F.collect_set("gene")).alias("g"))
    pairs = lists.select(F.explode(F.transform("g", lambda x, i: F.struct(x.alias("src"), F.slice(F.col("g"), i + 2, F.size("g")).alias("rest")))).alias("p")).select("p.src", F.explode("p.rest").alias("dst"))
    edges = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("edge_type", F.lit("co_listed"))
    nodes = table(spark, sf, "gene_info").select(F.col("symbol").alias("node_id"), F.lit("gene").alias("node_type"))
    return G.build(nodes, edges)


@R.add("kg_edges", f"{SQL_GRAPH} SELECT src, dst, edge_type, round(weight, 6) AS weight FROM e")
def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    return r6(graph(spark, sf)[1], "weight").select("src", "dst", "edge_type", "weight")


@R.add("kg_degrees", f"{SQL_GRAPH} SELECT src AS node_id, count(*) AS degree, round(sum(weight), 6) AS strength FROM e2 GROUP BY 1")
def kg_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return r6(G.degrees(graph(spark, sf)[1]), "strength")


@R.add("kg_stats", f"{SQL_GRAPH}, n AS (SELECT count(*) AS n FROM gene_info) SELECT n AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round((SELECT count(*) FROM e) / (n * (n - 1)), 9) AS density FROM n")
def kg_stats(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = graph(spark, sf)
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    return n.withColumn("density", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9))


@R.add("kg_neighbors", f"{SQL_GRAPH} SELECT src AS node_id, dst AS neighbor FROM e2")
def kg_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbors(graph(spark, sf)[1])


@R.add("kg_subgraph", f"{SQL_GRAPH}, {SQL_DISEASE} SELECT src, dst, edge_type, round(weight, 6) AS weight FROM e WHERE src IN (SELECT gene FROM dg) AND dst IN (SELECT gene FROM dg)")
def kg_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    keep = disease(spark, sf).select(F.col("gene").alias("node_id"))
    return r6(G.subgraph(graph(spark, sf)[1], keep), "weight").select("src", "dst", "edge_type", "weight")


@R.add("kg_invalid_edges", "SELECT node_id AS src, node_type AS src_type FROM (SELECT DISTINCT node_id, node_type FROM node_features) WHERE coalesce(node_type, '') NOT IN ('gene', 'pathway')")
def kg_invalid_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every node linked to a gene node under a schema that knows genes and pathways only: what breaks the schema."""
    nodes = table(spark, sf, "node_features").select("node_id", "node_type").distinct()
    edges = nodes.select(F.col("node_id").alias("src"), F.lit("hub").alias("dst"), F.lit("member_of").alias("edge_type"), F.lit(1.0).alias("weight"))
    hub = spark.createDataFrame([("hub", "gene")], "node_id string, node_type string")
    schema = spark.createDataFrame([("gene", "member_of", "gene"), ("pathway", "member_of", "gene")], "src_type string, edge_type string, dst_type string")
    return G.invalid_edges(nodes.unionByName(hub), edges, schema).select("src", "src_type")


@R.add("kg_components")
def kg_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(*graph(spark, sf))


@R.add("kg_node_index")
def kg_node_index(spark: SparkSession, sf: str) -> DataFrame:
    return G.node_index(table(spark, sf, "node_features").select("node_id"))


@R.add("kg_negatives")
def kg_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return G.negatives(*graph(spark, sf))


@R.add("kg_split")
def kg_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.split(graph(spark, sf)[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# propagation ----------------------------------------------------------------------------------------------

SQL_START = "p0 AS (SELECT gene AS node_id, 1.0 / score AS score FROM dg WHERE score IS NOT NULL AND gene IN (SELECT symbol FROM gene_info))"


def start(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "gene_info").select(F.col("symbol").alias("gene"))
    return disease(spark, sf).where("score IS NOT NULL").join(known, "gene", "left_semi").select(F.lit("disease").alias("key"), F.col("gene").alias("node_id"), (1.0 / F.col("score")).alias("score"))


def _walk_sql(k: int) -> str:
    s = "q0 AS (SELECT node_id, score / (SELECT sum(score) FROM p0) AS score FROM p0), wm AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e2)"
    for i in range(1, k + 1):
        s += f", q{i} AS (SELECT node_id, sum(score) AS score FROM (SELECT dst AS node_id, 0.5 * score * w AS score FROM q{i - 1} JOIN wm ON node_id = src UNION ALL SELECT node_id, 0.5 * score FROM q0) GROUP BY 1)"
    return s


@R.add("prop_walk", f"{SQL_GRAPH}, {SQL_DISEASE}, {SQL_START}, {_walk_sql(3)} SELECT node_id, round(score, 6) AS score FROM q3")
def prop_walk(spark: SparkSession, sf: str) -> DataFrame:
    return r6(G.random_walk(start(spark, sf), graph(spark, sf)[1], 0.5, 3).drop("key"), "score")


def _heat_sql(matrix: str, k: int, t: float) -> str:
    s = f"lm AS ({matrix}), h0 AS (SELECT node_id, score FROM p0)"
    for i in range(1, k + 1):
        s += f", h{i} AS (SELECT dst AS node_id, {-t / i} * sum(score * w) AS score FROM h{i - 1} JOIN lm ON node_id = src GROUP BY 1)"
    return s + " SELECT node_id, round(sum(score), 10) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(k + 1)) + ") GROUP BY 1"


_D = ", dd AS (SELECT src, sum(weight) AS t FROM e2 GROUP BY 1), "


@R.add("prop_heat", f"{SQL_GRAPH}, {SQL_DISEASE}, {SQL_START}{_D}{_heat_sql('SELECT src, dst, -weight AS w FROM e2 UNION ALL SELECT src, src, t FROM dd', 3, 0.1)}")
def prop_heat(spark: SparkSession, sf: str) -> DataFrame:
    return r10(G.diffusion(start(spark, sf), graph(spark, sf)[1]).drop("key"), "score")


@R.add("prop_insulated", f"{SQL_GRAPH}, {SQL_DISEASE}, {SQL_START}{_D}{_heat_sql('SELECT e2.src, e2.dst, -weight / sqrt(a.t * b.t) AS w FROM e2 JOIN dd a ON a.src = e2.src JOIN dd b ON b.src = e2.dst UNION ALL SELECT src, src, 1.0 FROM dd', 3, 0.1)}")
def prop_insulated(spark: SparkSession, sf: str) -> DataFrame:
    return r10(G.diffusion(start(spark, sf), graph(spark, sf)[1], normalised=True).drop("key"), "score")


@R.add("prop_converged")
def prop_converged(spark: SparkSession, sf: str) -> DataFrame:
    return G.scaled(G.random_walk(start(spark, sf), graph(spark, sf)[1]))


# vectors --------------------------------------------------------------------------------------------------

SQL_VEC = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _next(v: DataFrame) -> DataFrame:
    return v.select((F.col("id") - 1).alias("id"), "v")


@R.add("vec_most_similar", f"WITH {SQL_VEC}, q AS (SELECT id AS query_id, v AS qv FROM v WHERE id = 0) SELECT query_id, id, round({_DOT('v', 'qv')} / sqrt({_DOT('v', 'v')} * {_DOT('qv', 'qv')}), 6) AS similarity FROM v, q WHERE id <> query_id ORDER BY similarity DESC, id LIMIT 10")
def vec_most_similar(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return E.most_similar(v, v.where("id = 0"), 10)


@R.add("vec_cosine_topk", f"WITH {SQL_VEC}, q AS (SELECT id AS query_id, v AS qv FROM v WHERE id % 100 = 0), s AS (SELECT query_id, id, round({_DOT('v', 'qv')} / sqrt({_DOT('v', 'v')} * {_DOT('qv', 'qv')}), 6) AS similarity FROM v, q WHERE id <> query_id) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10")
def vec_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    v = vectors(spark, sf)
    return E.most_similar(v, v.where("id % 100 = 0"), 10)


@R.add("vec_neighbor_cosine", f"WITH {SQL_VEC} SELECT a.id, round({_DOT('a.v', 'b.v')} / sqrt({_DOT('a.v', 'a.v')} * {_DOT('b.v', 'b.v')}), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def vec_neighbor_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return v.join(_next(v).withColumnRenamed("v", "u"), "id").select("id", F.round(E.cosine("v", "u"), 6).alias("cosine"))


@R.add("vec_fuse_concat", f"WITH {SQL_VEC} SELECT a.id, list_concat(a.v, b.v) AS v FROM v a JOIN v b ON b.id = a.id + 1")
def vec_fuse_concat(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).drop("label")
    return E.fuse_concat(v, _next(v))


@R.add("vec_fuse_weighted", f"WITH {SQL_VEC} SELECT a.id, list_transform(list_zip(a.v, b.v), lambda z: round((z[1] * 0.7 + z[2] * 0.3) / (0.7 + 0.3), 6)) AS v FROM v a JOIN v b ON b.id = a.id + 1")
def vec_fuse_weighted(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).drop("label")
    return E.fuse_weighted(v, _next(v), 0.7, 0.3).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@R.add("vec_translate", f"WITH {SQL_VEC} SELECT a.id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] + 0.01 - z[2]) ** 2))), 6) AS distance FROM v a JOIN v b ON b.id = a.id + 1")
def vec_translate(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    j = v.join(_next(v).withColumnRenamed("v", "u"), "id").withColumn("r", F.array_repeat(F.lit(0.01), F.size("v")))
    return j.select("id", F.round(E.translate_distance("v", "r", "u"), 6).alias("distance"))


@R.add("vec_rotate")
def vec_rotate(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    j = v.join(_next(v).withColumnRenamed("v", "u"), "id").withColumn("r", F.array_repeat(F.lit(0.1), (F.size("v") / 2).cast("int")))
    return j.select("id", F.round(E.rotate_distance("v", "r", "u"), 6).alias("distance"))


@R.add("link_metrics", f"WITH {SQL_VEC}, d AS (SELECT a.id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS d, a.label = b.label AS same FROM v a JOIN v b ON b.id = a.id + 1), k AS (SELECT *, rank() OVER (PARTITION BY same ORDER BY round(d, 9)) AS rank FROM d) SELECT round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits_1, round(avg((rank <= 3)::INT), 6) AS hits_3, round(avg((rank <= 10)::INT), 6) AS hits_10, count(*) AS n FROM k")
def link_metrics(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    n = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("u"), F.col("label").alias("l2"))
    d = v.join(n, "id").select("id", F.round(F.sqrt(CS.square("v", "u")), 9).alias("d"), (F.col("label") == F.col("l2")).alias("same"))
    return r6(E.ranking_metrics(d.withColumn("rank", F.rank().over(Window.partitionBy("same").orderBy("d")))), "mean_rank", "mrr", "hits_1", "hits_3", "hits_10")


@R.add("clf_metrics", f"WITH {Q.SQL_ANNOTATED}, x AS (SELECT is_lof AS l, coalesce(cadd >= 25, false) AS p FROM a), c AS (SELECT count(*) AS n, count_if(l AND p) AS tp, count_if(NOT l AND p) AS fp, count_if(l AND NOT p) AS fn FROM x) SELECT n, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((n - fp - fn) / n, 6) AS accuracy FROM c")
def clf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    x = Q.annotated(spark, sf).select(F.col("is_lof").alias("l"), F.coalesce(F.col("cadd") >= 25, F.lit(False)).alias("p"))
    return r6(E.classification_metrics(x, "l", "p"), "precision", "recall", "f1", "accuracy")


# cluster statistics ---------------------------------------------------------------------------------------

DIM = 64
SQL_CENTRES = f"{SQL_VEC}, u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x, id FROM v), ce AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM u GROUP BY 1, 2)"


@R.add("clu_centroids", f"WITH {SQL_CENTRES} SELECT label, any_value(n) AS n, list(round(m, 6) ORDER BY i) AS centre FROM ce GROUP BY 1")
def clu_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return CS.centroids(vectors(spark, sf), DIM).select("label", "n", F.transform("centre", lambda x: F.round(x, 6)).alias("centre"))


@R.add("clu_calinski_harabasz", f"WITH {SQL_CENTRES}, g AS (SELECT i, avg(x) AS gm, count(*) AS t FROM u GROUP BY 1), w AS (SELECT sum((x - m) ** 2) AS within FROM u JOIN ce USING (label, i)), b AS (SELECT sum(n * (m - gm) ** 2) AS between, any_value(t) AS t, count(DISTINCT label) AS k FROM ce JOIN g USING (i)) SELECT k AS n_clusters, round(between / (k - 1) / (within / (t - k)), 6) AS calinski_harabasz FROM w, b")
def clu_calinski_harabasz(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.calinski_harabasz(vectors(spark, sf), DIM), "calinski_harabasz")


@R.add("clu_davies_bouldin", f"WITH {SQL_CENTRES}, f AS (SELECT label, id, sqrt(sum((x - m) ** 2)) AS d FROM u JOIN ce USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM f GROUP BY 1), cc AS (SELECT a.label, b.label AS other, sqrt(sum((a.m - b.m) ** 2)) AS d FROM ce a JOIN ce b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT cc.label, max((s.s + o.s) / d) AS r FROM cc JOIN s USING (label) JOIN s o ON o.label = other GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def clu_davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.davies_bouldin(vectors(spark, sf), DIM), "davies_bouldin")


_SQL_FAR = "fr AS (SELECT u.id, u.label, ce.label AS other, sqrt(sum((x - m) ** 2)) AS d FROM u JOIN ce USING (i) GROUP BY 1, 2, 3)"


@R.add("clu_silhouette", f"WITH {SQL_CENTRES}, {_SQL_FAR}, ab AS (SELECT id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM fr GROUP BY 1, 2) SELECT label, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette, count(*) AS n FROM ab GROUP BY 1")
def clu_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.simple_silhouette(vectors(spark, sf), DIM), "silhouette")


@R.add("clu_soft", f"WITH {SQL_CENTRES}, {_SQL_FAR}, w AS (SELECT id, other AS cluster, 1 / (d + 1e-10) AS w FROM fr) SELECT id, cluster, round(w / sum(w) OVER (PARTITION BY id), 6) AS probability FROM w")
def clu_soft(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.soft_labels(vectors(spark, sf), DIM), "probability")


SQL_PEOPLE = "pe AS (SELECT DISTINCT visit_id, diagnosis, planted_subtype, cohort, CASE WHEN iq_score BETWEEN 30 AND 170 THEN iq_score::DOUBLE END AS iq, CASE WHEN NOT isnan(age_at_diagnosis) AND age_at_diagnosis BETWEEN 0 AND 60 THEN age_at_diagnosis END AS age FROM phenotypes)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    age = F.col("age_at_diagnosis")
    return table(spark, sf, "phenotypes").select("visit_id", "diagnosis", "planted_subtype", "cohort", F.when(F.col("iq_score").between(30, 170), F.col("iq_score").cast("double")).alias("iq"), F.when(~F.isnan(age) & age.between(0, 60), age).alias("age")).distinct()


def _ab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("a"), F.col(b).alias("b"))


_P2 = lambda x: f"({x} * ({x} - 1) / 2)"


@R.add("clu_agreement", f"WITH {SQL_PEOPLE}, c AS (SELECT planted_subtype AS a, diagnosis AS b, count(*)::DOUBLE AS n FROM pe WHERE planted_subtype IS NOT NULL AND diagnosis IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na, max(n) AS top FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), x AS (SELECT sum({_P2('n')}) AS pboth, sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), t), y AS (SELECT sum({_P2('na')}) AS pa, -sum(na / t * ln(na / t)) AS ha, sum(top / t) AS purity FROM ra, t), z AS (SELECT sum({_P2('nb')}) AS pb, -sum(nb / t * ln(nb / t)) AS hb FROM rb, t) SELECT round((pboth - pa * pb / {_P2('t')}) / ((pa + pb) / 2 - pa * pb / {_P2('t')}), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(purity, 6) AS purity FROM x, y, z, t")
def clu_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.agreement(_ab(people(spark, sf).where("planted_subtype IS NOT NULL AND diagnosis IS NOT NULL"), "planted_subtype", "diagnosis")), "ari", "nmi", "purity")


_SQL_SIG = f"{SQL_PEOPLE}, lo AS (SELECT planted_subtype AS label, 'iq' AS feature, iq AS value FROM pe WHERE planted_subtype IS NOT NULL AND iq IS NOT NULL UNION ALL SELECT planted_subtype, 'age', age FROM pe WHERE planted_subtype IS NOT NULL AND age IS NOT NULL), o AS (SELECT DISTINCT label FROM lo), g AS (SELECT o.label, feature, count(*) FILTER (lo.label = o.label) AS n, avg(value) FILTER (lo.label = o.label) AS m1, avg(value) FILTER (lo.label <> o.label) AS m2, var_pop(value) FILTER (lo.label = o.label) AS v1, var_pop(value) FILTER (lo.label <> o.label) AS v2, count(*) FILTER (lo.label <> o.label) AS n2 FROM lo, o GROUP BY 1, 2)"


@R.add("clu_signatures", f"WITH {_SQL_SIG} SELECT label, feature, n, round(m1, 4) AS mean_in, round(m2, 4) AS mean_out, round((m1 - m2) / sqrt(v1 / (n - 1) + v2 / (n2 - 1)), 4) AS welch_t, round((m1 - m2) / sqrt((v1 + v2) / 2), 4) AS cohen_d FROM g WHERE n > 1 AND n2 > 1")
def clu_signatures(spark: SparkSession, sf: str) -> DataFrame:
    long = people(spark, sf).where("planted_subtype IS NOT NULL").select(F.col("planted_subtype").alias("label"), F.inline(F.array(F.struct(F.lit("iq").alias("feature"), F.col("iq").alias("value")), F.struct(F.lit("age").alias("feature"), F.col("age").alias("value"))))).where("value IS NOT NULL")
    return CS.signatures(long).withColumns({c: F.round(c, 4) for c in ("mean_in", "mean_out", "welch_t", "cohen_d")})


@R.add("clu_fdr", f"WITH {SQL_CONSTRAINT}, p AS (SELECT gene AS key, 1 - pli AS p_value FROM lc WHERE pli IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY p_value, key) AS r, count(*) OVER () AS n FROM p) SELECT key, round(p_value, 6) AS p_value, round(least(1, min(p_value * n / r) OVER (ORDER BY r DESC)), 6) AS q_value FROM k")
def clu_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.benjamini_hochberg(constraint(spark, sf).where("pli IS NOT NULL").select(F.col("gene").alias("key"), (1 - F.col("pli")).alias("p_value"))), "p_value", "q_value")


@R.add("conf_chi2", f"WITH {SQL_PEOPLE}, c AS (SELECT planted_subtype AS a, cohort AS b, count(*)::DOUBLE AS n FROM pe WHERE planted_subtype IS NOT NULL AND cohort IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS t, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb FROM c), x AS (SELECT sum((coalesce(n, 0) - na * nb / t) ** 2 / (na * nb / t)) AS chi2, any_value((ka - 1) * (kb - 1)) AS dof, any_value(t) AS t, any_value(least(ka, kb)) AS k FROM ra CROSS JOIN rb LEFT JOIN c USING (a, b), t) SELECT round(chi2, 6) AS chi2, dof, round(sqrt(chi2 / (t * (k - 1))), 6) AS cramers_v FROM x")
def conf_chi2(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.chi_square(_ab(people(spark, sf), "planted_subtype", "cohort")), "chi2", "cramers_v")


@R.add("conf_kruskal", f"WITH {SQL_PEOPLE}, r AS (SELECT cohort AS label, iq AS value FROM pe WHERE iq IS NOT NULL AND cohort IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM r), g AS (SELECT label, count(*) AS n, sum(rk) AS s FROM k GROUP BY 1), a AS (SELECT sum(n)::DOUBLE AS n, count(*) AS k, sum(s * s / n) AS q FROM g), ti AS (SELECT sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM r GROUP BY value)), h AS (SELECT n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM a, ti) SELECT round(h, 4) AS h, k - 1 AS dof, round(least(1, greatest(0, (h - k + 1) / (n - k))), 6) AS eta2 FROM h")
def conf_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.kruskal(people(spark, sf).select(F.col("cohort").alias("label"), F.col("iq").alias("value"))).withColumn("h", F.round("h", 4)), "eta2")


@R.add("perm_pvalue", f"WITH {SQL_PEOPLE} SELECT round((count_if(iq >= 120) + 1) / (count(iq) + 1), 6) AS p_value, round((120 - avg(iq)) / stddev_pop(iq), 6) AS z_score FROM pe WHERE iq IS NOT NULL")
def perm_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return r6(CS.permutation_p(people(spark, sf).where("iq IS NOT NULL").select(F.col("iq").alias("value")), 120.0), "p_value", "z_score")


def _x(spark: SparkSession, sf: str) -> DataFrame:
    return keep(CF.features(vectors(spark, sf).select("id", "v"), DIM))


@R.add("fit_kmeans")
def fit_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    x = _x(spark, sf)
    return CF.labels(CF.fit(x, "kmeans", 4), x)


@R.add("fit_gmm")
def fit_gmm(spark: SparkSession, sf: str) -> DataFrame:
    x = _x(spark, sf)
    return CF.labels(CF.choose_k(x, range(2, 11)), x)  # k from 2 to 10, 10 starts: the reference's defaults


@R.add("stability_bootstrap")
def stability_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return CF.stability(_x(spark, sf), 4).withColumn("rating", CS.rating(F.col("ari")))


@R.add("gates")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    """The three validation gates of the cohort's clusters, with the reference's 100, 100 and 50 runs and k from 2 to 8."""
    b, m = keep(Q.burdens(spark, sf)), Q.membership(spark, sf)
    sizes = {r.pathway_id: r.set_size for r in B.sized(m).select("pathway_id", "set_size").distinct().collect()}  # a dimension
    sets = sorted(sizes)
    z = wide(N.zscore(Q.dense_scores(spark, sf)), sets)
    x = keep(CF.features(keep(z.select(F.col("sample_id").alias("id"), F.array(*(F.col(f"`{p}`") for p in sets)).alias("v"))), len(sets)))
    labels, k = search(x, range(2, 9))
    return spark.createDataFrame(run_all(x, keep(labels), k, b, sizes), "gate string, ari double, runs int, bound double, passed boolean")


# rules, combination, ranking ------------------------------------------------------------------------------

RULES = [
    RU.Rule("R1", "gene_effect", 0.9, ("lof", "constrained")),
    RU.Rule("S1", "gene_effect", 0.92, ("damaging", "syndromic")),
    RU.Rule("S2", "modifier", 0.49, ("lof",), ("high_confidence",)),
    RU.Rule("R7", "known_gene", 0.88, ("damaging", "high_confidence")),
]
SQL_FACTS = f"{Q.SQL_ANNOTATED}, {SQL_CONSTRAINT}, {SQL_DISEASE}, fv AS (SELECT sample_id, gene, bool_or(is_lof) AS lof, bool_or(is_damaging) AS damaging FROM a WHERE gene IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1, 2), fa AS (SELECT fv.*, coalesce(pli >= 0.9, false) AS constrained, coalesce(score = 1, false) AS hc, coalesce(syndromic, false) AS syn FROM fv LEFT JOIN lc USING (gene) LEFT JOIN dg USING (gene)), h AS (SELECT sample_id, gene, 'R1' AS rule_id, 'gene_effect' AS kind, 0.9::DOUBLE AS confidence FROM fa WHERE lof AND constrained UNION ALL SELECT sample_id, gene, 'S1', 'gene_effect', 0.92 FROM fa WHERE damaging AND syn UNION ALL SELECT sample_id, gene, 'S2', 'modifier', 0.49 FROM fa WHERE lof AND NOT hc UNION ALL SELECT sample_id, gene, 'R7', 'known_gene', 0.88 FROM fa WHERE damaging AND hc), fi AS (SELECT sample_id, rule_id, kind, confidence, min(gene) AS gene, count(*) AS n_genes FROM h GROUP BY 1, 2, 3, 4)"


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return RU.facts(Q.annotated(spark, sf), constraint(spark, sf), disease(spark, sf))


@R.add("rules_fired", f"WITH {SQL_FACTS} SELECT * FROM fi")
def rules_fired(spark: SparkSession, sf: str) -> DataFrame:
    return RU.fire(facts(spark, sf), RULES)


@R.add("rules_summary", f"WITH {SQL_FACTS} SELECT rule_id, kind, count(DISTINCT sample_id) AS n_samples, sum(n_genes) AS n_genes, round(avg(confidence), 6) AS mean_confidence FROM fi GROUP BY 1, 2")
def rules_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RU.summary(rules_fired(spark, sf)), "mean_confidence")


@R.add("reasoning_rollup", f"WITH {SQL_FACTS} SELECT sample_id, list(rule_id ORDER BY confidence DESC, rule_id) AS rules, round(avg(confidence), 6) AS mean_confidence, list_sort(list(DISTINCT gene)) AS genes FROM fi GROUP BY 1")
def reasoning_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RU.chains(rules_fired(spark, sf)), "mean_confidence")


@R.add("rule_several_hits", f"WITH {SQL_FACTS}, {Q.SQL_SETS} SELECT sample_id, pathway_id, count(DISTINCT gene) AS n_genes FROM fv JOIN m USING (gene) WHERE damaging GROUP BY 1, 2 HAVING count(DISTINCT gene) >= 2")
def rule_several_hits(spark: SparkSession, sf: str) -> DataFrame:
    return RU.several_hits(facts(spark, sf), Q.membership(spark, sf))


_STEM = "regexp_replace({}, '[0-9]+.*$', '')"


@R.add("rule_paralog", f"WITH {SQL_FACTS}, pa AS (SELECT x.symbol AS gene, y.symbol AS paralog FROM gene_info x JOIN gene_info y ON {_STEM.format('x.symbol')} = {_STEM.format('y.symbol')} AND x.symbol <> y.symbol) SELECT fv.sample_id, fv.gene, pa.paralog FROM fv JOIN pa USING (gene) WHERE lof AND NOT EXISTS (SELECT 1 FROM fv f2 WHERE f2.sample_id = fv.sample_id AND f2.gene = pa.paralog AND f2.damaging)")
def rule_paralog(spark: SparkSession, sf: str) -> DataFrame:
    """Paralogs: symbols that share what stands before the first digit."""
    g = table(spark, sf, "gene_info").select("symbol", F.regexp_replace("symbol", "[0-9]+.*$", "").alias("stem"))
    pairs = g.join(g.select(F.col("symbol").alias("paralog"), "stem"), "stem").where("symbol <> paralog").select(F.col("symbol").alias("gene"), "paralog")
    return RU.paralog_intact(facts(spark, sf), pairs)


@R.add("cohort_recurrence", f"WITH {SQL_FACTS} SELECT gene, count(DISTINCT sample_id) AS n_samples FROM fi GROUP BY 1 HAVING count(DISTINCT sample_id) > 1")
def cohort_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    return rules_fired(spark, sf).groupBy("gene").agg(F.count_distinct("sample_id").alias("n_samples")).where("n_samples > 1")


SQL_TWO = f"{SQL_FACTS}, ne AS (SELECT gene, pli AS n FROM lc WHERE pli IS NOT NULL), sy AS (SELECT gene, sum(confidence) AS s FROM fi GROUP BY 1), bo AS (SELECT gene, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM ne FULL JOIN sy USING (gene))"
for _how, _sql in (("weighted_sum", "0.6 * n + 0.4 * s"), ("max", "greatest(n, s)"), ("product", "sqrt((n + 0.01) * (s + 0.01))"), ("magnitude", "(n * avg(abs(n)) OVER () + s * avg(abs(s)) OVER ()) / (avg(abs(n)) OVER () + avg(abs(s)) OVER ())")):

    def _combined(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        neural = constraint(spark, sf).where("pli IS NOT NULL").select("gene", F.col("pli").alias("score"))
        symbolic = rules_fired(spark, sf).groupBy("gene").agg(F.sum("confidence").alias("score"))
        return r6(RU.combine_scores(neural, symbolic, how), "score")

    R.add(f"combine_{_how}", f"WITH {SQL_TWO} SELECT gene, round({_sql}, 6) AS score FROM bo")(_combined)

SQL_MAP = f"{SQL_DISEASE}, {Q.SQL_SETS}, ta AS (SELECT DISTINCT curator AS candidate_id, trim(gene_symbol, ' ') AS gene FROM disease_genes WHERE curator IS NOT NULL AND gene_symbol IS NOT NULL), di AS (SELECT gene, 1 AS d FROM dg WHERE score = 1), mm AS (SELECT m.*, d FROM m LEFT JOIN di USING (gene)), zz AS (SELECT pathway_id, count(*) AS set_size, count(d) AS n_disrupted FROM mm GROUP BY 1), ov AS (SELECT candidate_id, pathway_id, count(*) AS overlap, count(d) AS hit FROM ta JOIN mm USING (gene) GROUP BY 1, 2), mp AS (SELECT * FROM ov JOIN zz USING (pathway_id)), ms2 AS (SELECT *, least(1, 0.3 * 0.5 + 0.3 * overlap / set_size + 0.2 * coalesce(hit / nullif(n_disrupted, 0), 0)) AS mapping, 0.3 + 0.3 * least(5 * overlap / set_size, 1) + 0.4 * coalesce(hit / nullif(n_disrupted, 0), 0) AS plaus FROM mp)"


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Curators stand for candidates, the genes they entered for their targets, genes of score 1 for disrupted ones."""
    targets = table(spark, sf, "disease_genes").where("curator IS NOT NULL AND gene_symbol IS NOT NULL").select(F.col("curator").alias("candidate_id"), F.trim("gene_symbol").alias("gene"))
    m = K.map_to_sets(targets, Q.membership(spark, sf), disease(spark, sf).where("score = 1"))
    return m.withColumns({"mapping": K.mapping_score(F.lit(0.5)), "plaus": K.plausibility()})


@R.add("rank_map", f"WITH {SQL_MAP} SELECT candidate_id, pathway_id, overlap, set_size, hit, n_disrupted, round(mapping, 6) AS mapping FROM ms2")
def rank_map(spark: SparkSession, sf: str) -> DataFrame:
    return r6(mapped(spark, sf), "mapping").select("candidate_id", "pathway_id", "overlap", "set_size", "hit", "n_disrupted", "mapping")


_EV = "least(1, greatest(0, 0.6 * plaus + 0.4 * mapping - least(0.05 * (overlap % 3), 0.3)))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = K.evidence({"p": F.col("plaus"), "m": F.col("mapping")}, {"p": 0.6, "m": 0.4}, F.col("overlap") % 3)
    return mapped(spark, sf).withColumn("score", F.round(e, 6)).withColumn("level", K.level(F.col("score"))).withColumn("kind", F.substring("pathway_id", -1, 1))


@R.add("rank_evidence", f"WITH {SQL_MAP}, s AS (SELECT candidate_id, pathway_id, round({_EV}, 6) AS score FROM ms2) SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM s")
def rank_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("candidate_id", "pathway_id", "score", "level")


@R.add("rank_first_set", f"WITH {SQL_MAP}, s AS (SELECT candidate_id, pathway_id, round({_EV}, 6) AS score, round(plaus, 6) AS set_score FROM ms2) SELECT candidate_id, pathway_id, score FROM s QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY set_score DESC, pathway_id) = 1")
def rank_first_set(spark: SparkSession, sf: str) -> DataFrame:
    return K.first_set(scored(spark, sf).withColumn("set_score", F.round("plaus", 6))).select("candidate_id", "pathway_id", "score")


@R.add("rank_diverse")
def rank_diverse(spark: SparkSession, sf: str) -> DataFrame:
    return K.diverse(scored(spark, sf))


# causal models --------------------------------------------------------------------------------------------

SQL_DAG = "e(source, target, kind, strength) AS (VALUES " + ", ".join(f"('{s}', '{t}', '{k}', {w}::DOUBLE)" for s, t, k, w in C.EXAMPLE) + ")"


def _order() -> list[str]:
    left, out = {x for e in C.EXAMPLE for x in e[:2]}, []
    while left:
        free = sorted(n for n in left if all(s in out for s, t, _, _ in C.EXAMPLE if t == n))
        out += free
        left -= set(free)
    return out


def _do_sql(change: dict[str, float]) -> dict[str, float]:
    """The values of one scenario, worked out here as plain numbers."""
    v: dict[str, float] = {}
    for n in _order():
        ps = [(s, k, w) for s, t, k, w in C.EXAMPLE if t == n]
        v[n] = change[n] if n in change else (sum(v[s] * w * C.FACTOR.get(k, C.OTHER_FACTOR) for s, k, w in ps) / sum(w for _, _, w in ps) if ps else C.ROOT)
    return v


@R.add("scm_closure", f"WITH RECURSIVE {SQL_DAG}, c(ancestor, descendant, depth) AS (SELECT source, target, 1 FROM e UNION ALL SELECT ancestor, e.target, depth + 1 FROM c JOIN e ON descendant = e.source) SELECT ancestor, descendant, max(depth) AS depth FROM c GROUP BY 1, 2")
def scm_closure(spark: SparkSession, sf: str) -> DataFrame:
    return C.closure(C.example(spark))


@R.add("scm_paths", f"WITH RECURSIVE {SQL_DAG}, p(path, last, strength) AS (SELECT [source, target], target, strength FROM e WHERE source = 'CHD8_variant' UNION ALL SELECT list_append(path, e.target), e.target, p.strength * e.strength FROM p JOIN e ON last = e.source WHERE last <> 'asd_phenotype') SELECT path, round(strength, 6) AS strength FROM p WHERE last = 'asd_phenotype'")
def scm_paths(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.paths(C.example(spark), "CHD8_variant", "asd_phenotype"), "strength")


@R.add("scm_do", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n}', {round(v, 6)}::DOUBLE)" for s, x in (("off", 0.0), ("on", 1.0)) for n, v in _do_sql({"SHANK3_variant": x}).items()) + ") t(scenario, node_id, value)")
def scm_do(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.propagate(C.example(spark), {"off": {"SHANK3_variant": 0.0}, "on": {"SHANK3_variant": 1.0}}), "value")


@R.add("scm_ate", f"SELECT {round(_do_sql({'CHD8_variant': 1.0})['asd_phenotype'] - _do_sql({'CHD8_variant': 0.0})['asd_phenotype'], 6)}::DOUBLE AS effect")
def scm_ate(spark: SparkSession, sf: str) -> DataFrame:
    return r6(C.effect(C.example(spark), "CHD8_variant", "asd_phenotype"), "effect")


@R.add("scm_counterfactual")
def scm_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    return C.counterfactual(C.example(spark), {"SHANK3_variant": 1.0, "asd_phenotype": 0.9}, {"SHANK3_variant": 0.0}, "asd_phenotype")


@R.add("scm_mediation")
def scm_mediation(spark: SparkSession, sf: str) -> DataFrame:
    return C.mediation(C.example(spark), "SHANK3_variant", "asd_phenotype", "synaptic_pathway")


@R.add("scm_path_effects")
def scm_path_effects(spark: SparkSession, sf: str) -> DataFrame:
    return C.path_effects(C.example(spark), "CHD8_variant", "asd_phenotype")


@R.add("scm_backdoor", "SELECT * FROM (VALUES ('ancestry')) t(adjust_for)")
def scm_backdoor(spark: SparkSession, sf: str) -> DataFrame:
    """The single nodes that close every backdoor between a variant and the phenotype."""
    sets = C.Graph(C.example(spark)).adjustment_sets("SHANK3_variant", "asd_phenotype")
    return spark.createDataFrame([(n,) for s in sets for n in sorted(s)], "adjust_for string")


# hashed vectors, messages, tails --------------------------------------------------------------------------


@R.add("vec_hashed_genes")
def vec_hashed_genes(spark: SparkSession, sf: str) -> DataFrame:
    from lociflow.functions.hashed import hash_vector

    return table(spark, sf, "gene_info").select("symbol", hash_vector(F.upper("symbol"), 32).alias("v"))


@R.add("substitution_score", "WITH r AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS a), g AS (SELECT a, CASE WHEN a IN ('A', 'I', 'L', 'M', 'F', 'W', 'V') THEN 1 WHEN a IN ('S', 'T', 'N', 'Q') THEN 2 WHEN a IN ('K', 'R', 'H') THEN 3 WHEN a IN ('D', 'E') THEN 4 WHEN a IN ('C', 'G', 'P') THEN 5 ELSE 6 END AS g FROM r) SELECT x.a AS ref, y.a AS alt, CASE WHEN x.a = y.a THEN 0 WHEN x.g = y.g THEN 0.3 WHEN x.g IN (3, 4) AND y.g IN (3, 4) THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM g x, g y")
def substitution_score(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 x 20 residues."""
    from lociflow.functions.hashed import RESIDUES, substitution_score as score

    r = spark.createDataFrame([(x, list(RESIDUES)) for x in RESIDUES], "ref string, alts array<string>").select("ref", F.explode("alts").alias("alt"))
    return r.select("ref", "alt", score(F.col("ref"), F.col("alt")).cast("double").alias("score"))


@R.add("gnn_message_pass")
def gnn_message_pass(spark: SparkSession, sf: str) -> DataFrame:
    v = vec_hashed_genes(spark, sf).select(F.col("symbol").alias("id"), "v")
    return E.message_pass(v, G.both_ways(graph(spark, sf)[1]), 32)


@R.add("link_auc", f"WITH {Q.SQL_ANNOTATED}, x AS (SELECT is_lof AS l, cadd AS s FROM a WHERE cadd IS NOT NULL), k AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x) SELECT round((sum(r) FILTER (l) - count_if(l) * (count_if(l) + 1) / 2) / (count_if(l)::DOUBLE * count_if(NOT l)), 6) AS auc FROM k")
def link_auc(spark: SparkSession, sf: str) -> DataFrame:
    return r6(E.auc(Q.annotated(spark, sf).where("cadd IS NOT NULL").select(F.col("cadd").alias("score"), F.col("is_lof").alias("label"))), "auc")


@R.add("clu_pvalues")
def clu_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures with the probability of their t and their false discovery rate."""
    from lociflow.functions.tails import student_p

    long = people(spark, sf).where("planted_subtype IS NOT NULL").select(F.col("planted_subtype").alias("label"), F.inline(F.array(F.struct(F.lit("iq").alias("feature"), F.col("iq").alias("value")), F.struct(F.lit("age").alias("feature"), F.col("age").alias("value"))))).where("value IS NOT NULL")
    s = CS.signatures(long).withColumn("p_value", student_p(F.col("welch_t"), F.col("n") - 1)).withColumn("key", F.concat_ws(":", "label", "feature"))
    return CS.benjamini_hochberg(s.where("p_value IS NOT NULL").select("key", "p_value"))


@R.add("train_translation")
def train_translation(spark: SparkSession, sf: str) -> DataFrame:
    member = Q.membership(spark, sf).select(F.col("gene").alias("head"), F.lit("member_of").alias("relation"), F.col("pathway_id").alias("tail"))
    return E.train_translation(member, [{"dim": 8}, {"dim": 16, "rate": 0.1}])

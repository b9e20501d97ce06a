"""Graphs as two frames, nodes (node_id, node_type) and edges (src, dst, edge_type, weight), and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.session import cut


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, and the edges between known nodes without loops; scores above 1 are per mille."""
    nodes = nodes.select("node_id", "node_type").distinct()
    ids = nodes.select("node_id").distinct()
    w = F.when(F.col("weight") > 1, F.col("weight") / 1000).otherwise(F.coalesce("weight", F.lit(1.0)))
    e = edges.where("src <> dst").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return nodes, e.select("src", "dst", "edge_type", w.alias("weight"))


def invalid_edges(nodes: DataFrame, edges: DataFrame, schema: DataFrame) -> DataFrame:
    """Edges whose types of source, edge and target are not in schema (src_type, edge_type, dst_type)."""
    t = lambda end: nodes.select(F.col("node_id").alias(end), F.col("node_type").alias(f"{end}_type"))
    return edges.join(t("src"), "src", "left").join(t("dst"), "dst", "left").join(schema, ["src_type", "edge_type", "dst_type"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected weights: every edge in both directions, parallel edges summed, no loops."""
    two = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return two.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def neighbors(edges: DataFrame, of: Column | None = None) -> DataFrame:
    pairs = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor")))
    return (pairs.where(of) if of is not None else pairs).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength")).withColumnRenamed("src", "node_id")


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    ids = keep.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component (its smallest node): smallest labels spread, then jump to their label's label.

    Jumping halves the depth, so the rounds grow with the logarithm of the diameter. Each round is a checkpoint.
    """
    pairs = cut(both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst"))
    label = cut(nodes.select("node_id").distinct().withColumn("component", F.col("node_id")))
    while True:
        near = pairs.join(label.withColumnRenamed("node_id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near")).withColumnRenamed("src", "node_id")
        step = label.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("node_id").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component").select("node_id", "old", F.least("component", "far").alias("component")))
        changed = not new.where("old <> component").isEmpty()
        label = new.select("node_id", "component")
        if not changed:
            return label


def node_index(nodes: DataFrame, parts: int = 64) -> DataFrame:
    """node_id, idx: 0.. in the order of hash bucket and id; offsets per bucket, so that no task orders all nodes."""
    b = nodes.select("node_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(parts)))
    sizes = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("bucket", (F.sum("k").over(Window.orderBy("bucket")) - F.col("k")).alias("before"))
    return b.withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("node_id"))).join(F.broadcast(before), "bucket").select("node_id", (F.col("i") + F.col("before") - 1).alias("idx"))


def negatives(nodes: DataFrame, edges: DataFrame, per_node: int = 2, seed: int = 42) -> DataFrame:
    """Pairs that are no edges: each node with some nodes drawn by hash, known edges and loops left out."""
    idx = node_index(nodes)
    n = idx.agg(F.count(F.lit(1)).alias("n"))
    drawn = idx.crossJoin(F.broadcast(n)).select(F.col("node_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("j"), "n").select("src", F.pmod(F.xxhash64("src", "j", F.lit(seed)), F.col("n")).alias("idx"))
    pairs = drawn.join(idx.withColumnRenamed("node_id", "dst"), "idx").select("src", "dst").where("src <> dst").distinct()
    known = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.join(known, ["src", "dst"], "left_anti")


def split(edges: DataFrame, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """edges with the part they belong to, by hash: the same edge is always in the same part."""
    u = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return edges.withColumn("part", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


# propagation: scores (key, node_id, score) over both_ways() weights ---------------------------------------------


def walk_matrix(edges: DataFrame) -> DataFrame:
    """Weights divided by the strength of their source."""
    e = both_ways(edges)
    return e.join(e.groupBy("src").agg(F.sum("weight").alias("t")), "src").select("src", "dst", (F.col("weight") / F.col("t")).alias("w"))


def laplacian_matrix(edges: DataFrame, normalised: bool = False) -> DataFrame:
    """The off-diagonal and diagonal entries of D - A, or of I - D^-1/2 A D^-1/2."""
    e = both_ways(edges)
    d = e.groupBy("src").agg(F.sum("weight").alias("t"))
    if not normalised:
        return e.select("src", "dst", (-F.col("weight")).alias("w")).unionByName(d.select("src", F.col("src").alias("dst"), F.col("t").alias("w")))
    j = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("t").alias("u")), "dst")
    return j.select("src", "dst", (-F.col("weight") / F.sqrt(F.col("t") * F.col("u"))).alias("w")).unionByName(d.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w")))


def times(scores: DataFrame, matrix: DataFrame, factor: float = 1.0) -> DataFrame:
    j = scores.join(matrix, scores["node_id"] == matrix["src"])
    return j.groupBy("key", F.col("dst").alias("node_id")).agg((F.sum(F.col("score") * F.col("w")) * factor).alias("score"))


def added(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("key", "node_id").agg(F.sum("score").alias("score"))


def random_walk(start: DataFrame, edges: DataFrame, restart: float = 0.5, rounds: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """p = (1 - restart) * W p + restart * p0 with p0 of sum 1 per key, for so many rounds or until nothing moves."""
    m = walk_matrix(edges)
    m = cut(m) if rounds is None else m
    p0 = start.join(start.groupBy("key").agg(F.sum("score").alias("t")).where("t > 0"), "key").select("key", "node_id", (F.col("score") / F.col("t")).alias("score"))
    p0 = cut(p0) if rounds is None else p0
    back = p0.withColumn("score", F.col("score") * restart)
    p = p0
    for _ in range(rounds or most):
        new = added(times(p, m, 1 - restart), back)
        if rounds is None:
            new = cut(new)
            moved = new.join(p.withColumnRenamed("score", "was"), ["key", "node_id"], "full_outer").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            if moved is None or moved < tolerance:
                return new
        p = new
    return p


def walk_by_set(start: DataFrame, edges: DataFrame, membership: DataFrame, restart: float = 0.5, rounds: int = 3) -> DataFrame:
    """key, pathway_id, score: random_walk's scores of so many rounds, summed over the nodes of each set of membership
    (pathway_id, node_id).

    The sum is linear in where a key starts, so the sets walk backwards, all in one array per node, and what they bring
    to a node is weighed by the keys' starts: no key is spread over the network. Sets are a bounded list.
    """
    of = membership.where("pathway_id IS NOT NULL AND node_id IS NOT NULL")
    sets = sorted(r.pathway_id for r in of.select("pathway_id").distinct().collect())
    if not sets:
        return start.sparkSession.createDataFrame([], start.select("key", F.lit("").alias("pathway_id"), F.lit(0.0).alias("score")).schema)
    added_up = lambda w: F.array(*(F.sum(F.col("v")[i] * w) for i in range(len(sets)))).alias("v")
    m = cut(walk_matrix(edges))
    own = cut(of.groupBy("node_id").agg(F.array(*(F.count(F.when(F.col("pathway_id") == p, 1)).cast("double") for p in sets)).alias("v")))
    back, g = own.select("node_id", "v", F.lit(restart).alias("w")), own
    for _ in range(rounds):
        steps = m.join(g.withColumnRenamed("node_id", "dst"), "dst").select(F.col("src").alias("node_id"), "v", (F.col("w") * (1 - restart)).alias("w"))
        g = cut(steps.unionByName(back).groupBy("node_id").agg(added_up(F.col("w"))))
    total = start.groupBy("key").agg(F.sum("score").alias("t")).where("t > 0")
    out = start.join(g, "node_id").groupBy("key").agg(added_up(F.col("score"))).join(total, "key")
    named = F.arrays_zip(F.array(*map(F.lit, sets)).alias("pathway_id"), F.col("v").alias("s"))
    return out.select("key", "t", F.inline(named)).where("s > 0").select("key", "pathway_id", (F.col("s") / F.col("t")).alias("score"))


def diffusion(start: DataFrame, edges: DataFrame, t: float = 0.1, terms: int = 3, normalised: bool = False) -> DataFrame:
    """exp(-t L) p0 by so many terms of its series; normalised: the insulated form."""
    m = laplacian_matrix(edges, normalised)
    term, parts = start.select("key", "node_id", "score"), [start.select("key", "node_id", "score")]
    for k in range(1, terms + 1):
        term = times(term, m, -t / k)
        parts.append(term)
    return added(*parts)


def scaled(scores: DataFrame, least: float = 1e-10) -> DataFrame:
    """Scores divided by the largest of their key; what is next to nothing is dropped."""
    top = scores.groupBy("key").agg(F.max("score").alias("top")).where("top > 0")
    return scores.join(top, "key").select("key", "node_id", (F.col("score") / F.col("top")).alias("score")).where(F.col("score") > least)


# parts of one typed graph --------------------------------------------------------------------------------


def membership_part(membership: DataFrame, kind: str = "pathway") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of sets and their genes (pathway_id, gene)."""
    nodes = membership.select(F.col("gene").alias("node_id"), F.lit("gene").alias("node_type")).unionByName(membership.select(F.col("pathway_id").alias("node_id"), F.lit(kind).alias("node_type")))
    return nodes, membership.select(F.col("gene").alias("src"), F.col("pathway_id").alias("dst"), F.lit("member_of").alias("edge_type"), F.lit(1.0).alias("weight"))


def hierarchy_part(parents: DataFrame, child_type: str, parent_type: str, relation: str = "is_a") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a hierarchy (child, parent)."""
    nodes = parents.select(F.col("child").alias("node_id"), F.lit(child_type).alias("node_type")).unionByName(parents.select(F.col("parent").alias("node_id"), F.lit(parent_type).alias("node_type")))
    return nodes, parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(relation).alias("edge_type"), F.lit(1.0).alias("weight"))


def interactions(rows: DataFrame, a: str, b: str, score: str, least: float = 0.0) -> DataFrame:
    """Edges of pairs in any frame with more than a least score: each pair in order; scores above 1 are per mille."""
    s = F.col(score)
    return rows.where((s > least) & (F.col(a) != F.col(b))).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.lit("interacts").alias("edge_type"), F.when(s > 1, s / 1000).otherwise(s).alias("weight"))


def assemble(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One graph of several: distinct nodes and the distinct edges of all parts."""
    nodes, edges = (parts[0][i].select(c) for i, c in ((0, ["node_id", "node_type"]), (1, ["src", "dst", "edge_type", "weight"])))
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n.select(nodes.columns)), edges.unionByName(e.select(edges.columns))
    return nodes.distinct(), edges.distinct()

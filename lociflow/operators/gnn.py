"""A graph network over vectors (id, v) and edges (src, dst, edge_type, weight): projection, typed messages, attention, hierarchy.

Weights are given or drawn from a seed; they are a model, small, and travel with the functions. Messages are partial sums
by target, so a hub's neighbours never meet in one row; attention is a softmax by two aggregations per target.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.embeddings import dot, propagate_up


def draw(rows: int, cols: int, seed: int) -> list[list[float]]:
    """Weights of a layer, drawn within sqrt(6 / (rows + cols))."""
    import numpy as np

    most = (6 / (rows + cols)) ** 0.5
    return np.random.default_rng(seed).uniform(-most, most, (rows, cols)).tolist()


def linear(vectors: DataFrame, w: list[list[float]], bias: list[float] | None = None, relu: bool = False) -> DataFrame:
    """id, v times w plus bias, by matrix products over Arrow batches."""
    import numpy as np
    import pyarrow as pa

    m, b = np.array(w), np.array(bias if bias is not None else [0.0] * len(w[0]))
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("v").flatten(), float).reshape(-1, len(m)) @ m + b
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(np.maximum(x, 0) if relu else x), pa.list_(pa.float64()))], names=["id", "v"])

    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, v array<double>")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of the vectors of each id of a; b lacks some."""
    return a.join(b.select("id", F.col("v").alias("_u")), "id", "left").select("id", F.when(F.col("_u").isNull(), F.col("v")).otherwise(F.zip_with("v", "_u", lambda x, y: x + y)).alias("v"))


def with_types(vectors: DataFrame, nodes: DataFrame, types: dict[str, list[float]]) -> DataFrame:
    """Each vector plus that of its node's type (nodes: id, node_type)."""
    t = F.create_map(*(x for k, v in types.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return vectors.join(nodes.select("id", t[F.col("node_type")].alias("_t")), "id", "left").select("id", F.when(F.col("_t").isNull(), F.col("v")).otherwise(F.zip_with("v", "_t", lambda x, y: x + y)).alias("v"))


def _times(v: Column | str, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def sums(messages: DataFrame, dim: int, w: Column | None = None) -> DataFrame:
    """id, v: by dst the sum of v times w."""
    w = F.lit(1.0) if w is None else w
    return messages.groupBy(F.col("dst").alias("id")).agg(F.array(*(F.sum(F.col("v")[i] * w) for i in range(dim))).alias("v"))


def typed_messages(vectors: DataFrame, edges: DataFrame, layers: dict[str, list[list[float]] | float], dim: int) -> DataFrame:
    """id, v: mean over incoming edges of the source's vector, changed by the layer (or factor) of the edge's type."""
    out = None
    for kind, w in sorted(layers.items()):
        of = linear(vectors, w) if isinstance(w, list) else vectors.select("id", _times("v", F.lit(w)).alias("v"))
        one = edges.where(F.col("edge_type") == kind).join(of.withColumnRenamed("id", "src"), "src").select("dst", "v", "weight")
        out = one if out is None else out.unionByName(one)
    n = out.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("_n"))
    return sums(out, dim, F.col("weight")).join(n, "id").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def attention(vectors: DataFrame, edges: DataFrame, dim: int, prior: Column | None = None) -> DataFrame:
    """id, v: sources mixed by the softmax, over a target's incoming edges, of dot / sqrt(dim) plus the log of a prior."""
    src, dst = (vectors.select(F.col("id").alias(e), F.col("v").alias(f"_{e}")) for e in ("src", "dst"))
    s = edges.join(src, "src").join(dst, "dst").select("*", (dot("_src", "_dst") / dim**0.5 + (F.lit(0.0) if prior is None else F.log(prior))).alias("_s"))
    top = s.groupBy("dst").agg(F.max("_s").alias("_m"))
    e = s.join(top, "dst").select("dst", F.col("_src").alias("v"), F.exp(F.col("_s") - F.col("_m")).alias("_e"))
    total = e.groupBy(F.col("dst").alias("id")).agg(F.sum("_e").alias("_t"))
    return sums(e, dim, F.col("_e")).join(total, "id").select("id", F.transform("v", lambda x: x / F.col("_t")).alias("v"))


def term_similarity(annotations: DataFrame, least: float = 0.0) -> DataFrame:
    """src, dst, weight: Jaccard of the genes of two terms (term, gene) that share one, both ways; pairs form inside a gene."""
    size = annotations.groupBy("term").agg(F.count_distinct("gene").alias("n"))
    a = annotations.distinct()
    both = a.select(F.col("term").alias("src"), "gene").join(a.select(F.col("term").alias("dst"), "gene"), "gene").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    j = both.join(size.select(F.col("term").alias("src"), F.col("n").alias("a")), "src").join(size.select(F.col("term").alias("dst"), F.col("n").alias("b")), "dst")
    return j.select("src", "dst", (F.col("k") / (F.col("a") + F.col("b") - F.col("k"))).alias("weight")).where(F.col("weight") > least)


def co_attention(genes: DataFrame, sets: DataFrame, membership: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Genes that attend to their sets, and sets that attend to their genes (membership: gene, set)."""
    up = membership.select(F.col("gene").alias("src"), F.col("set").alias("dst"))
    everything = genes.unionByName(sets)
    return attention(everything, up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), dim), attention(everything, up, dim)


def forward(vectors: DataFrame, nodes: DataFrame, edges: DataFrame, parents: DataFrame, dims: tuple[int, int], layers: int = 2, seed: int = 42) -> DataFrame:
    """id, v of a whole network: projection, node types, layers of typed messages with residuals, attention, hierarchy."""
    from lociflow.session import cut

    width, hidden = dims
    kinds = sorted(r.edge_type for r in edges.select("edge_type").distinct().collect())  # a schema's types
    types = sorted(r.node_type for r in nodes.where("node_type IS NOT NULL").select("node_type").distinct().collect())
    h = with_types(linear(vectors, draw(width, hidden, seed)), nodes, {t: draw(1, hidden, seed + 100 + i)[0] for i, t in enumerate(types)})
    for k in range(layers):
        h = cut(h)
        m = typed_messages(h, edges, {t: draw(hidden, hidden, seed + 10 * k + i) for i, t in enumerate(kinds)}, hidden)
        h = add(h, linear(m, draw(hidden, hidden, seed + 10 * k + 9), relu=True))
    h = cut(h)
    h = add(h, attention(h, edges.where("src <> dst"), hidden))
    return propagate_up(cut(h), parents, hidden, 1)


def train_readout(vectors: DataFrame, labels: DataFrame, rounds: int = 50, penalty: float = 0.01):
    """A logistic readout of label (0 or 1) by the node vectors; transform() of the model adds its probability."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = vectors.join(labels, "id").select("id", array_to_vector("v").alias("features"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=penalty).fit(x)

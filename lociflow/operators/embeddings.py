"""Vectors as array columns: similarity, fusion, translation models and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, tiny: float = 1e-10) -> Column:
    """0 where a vector is next to nothing."""
    return F.when((norm(a) < tiny) | (norm(b) < tiny), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def usable(v: str, dim: int) -> Column:
    c = F.col(v)
    return c.isNotNull() & (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0)


def most_similar(vectors: DataFrame, query: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, id, similarity: for every row of query (id, v) the k most similar other rows of vectors (id, v).

    Both sides are cut into blocks of about so many rows by hash; each pair of blocks is one product of matrices that
    keeps k rows per query, and the best k of these remain. Vectors of different length are not compared.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.window import Window

    def blocks(df: DataFrame, ids: str, vs: str) -> DataFrame:
        df = df.where("v IS NOT NULL").select("id", "v", F.size("v").alias("d"))
        n = max(1, -(-df.count() // block))
        return df.groupBy("d", F.pmod(F.xxhash64("id"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("r")).select("d", F.col("r.id").alias(ids), F.col("r.v").alias(vs))

    def best(frames):
        for f in frames:
            for qi, qv, vi, vv in zip(f["qi"], f["qv"], f["vi"], f["vv"]):
                q, x = (np.stack([np.asarray(v, dtype=float) for v in m]) for m in (qv, vv))
                lq, lx = (np.linalg.norm(m, axis=1) for m in (q, x))
                s = q @ x.T / np.where(lq < 1e-10, np.inf, lq)[:, None] / np.where(lx < 1e-10, np.inf, lx)
                s, ids, out = np.round(s, 6) + 0.0, np.asarray(vi), []
                for i, row in zip(qi, s):
                    top = [j for j in np.lexsort((ids, -row))[: k + (ids == i).sum()] if ids[j] != i][:k]
                    out.append(pd.DataFrame({"query_id": i, "id": ids[top], "similarity": row[top]}))
                yield pd.concat(out)

    pairs = blocks(vectors, "vi", "vv").join(blocks(query, "qi", "qv"), "d").drop("d")
    pairs = pairs.repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    hits = pairs.mapInPandas(best, "query_id bigint, id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fuse_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that both have, with both vectors one after the other."""
    return a.join(b.withColumnRenamed("v", "u"), "id").select("id", F.concat("v", "u").alias("v"))


def fuse_weighted(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5) -> DataFrame:
    mix = F.zip_with("v", "u", lambda x, y: (x * wa + y * wb) / (wa + wb))
    return a.join(b.withColumnRenamed("v", "u"), "id").where("size(v) = size(u)").select("id", mix.alias("v"))


def unit(v: Column | str) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def translate_distance(h: str, r: str, t: str, p: int = 2) -> Column:
    """Norm of h + r - t."""
    d = F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: x - y)
    if p == 1:
        return F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def rotate_distance(h: str, phase: str, t: str) -> Column:
    """Norm of h turned by the phases, minus t; the first half of a vector is real, the second imaginary."""
    half = (F.size(h) / 2).cast("int")
    re, im = F.slice(F.col(h), F.lit(1), half), F.slice(F.col(h), half + 1, half)
    tr, ti = F.slice(F.col(t), F.lit(1), half), F.slice(F.col(t), half + 1, half)
    term = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.pow(F.get(re, i) * F.cos(F.get(phase, i)) - F.get(im, i) * F.sin(F.get(phase, i)) - F.get(tr, i), F.lit(2)) + F.pow(F.get(re, i) * F.sin(F.get(phase, i)) + F.get(im, i) * F.cos(F.get(phase, i)) - F.get(ti, i), F.lit(2)))
    return F.sqrt(F.aggregate(term, F.lit(0.0), lambda s, x: s + x))


def margin_loss(positive: str, negative: str, margin: float = 1.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), margin + F.col(positive) - F.col(negative)))


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """Mean rank, mean reciprocal rank and hits at 1, 3, 10 of a column rank."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits_{k}")
    return ranks.agg(F.avg("rank").alias("mean_rank"), F.avg(1 / F.col("rank")).alias("mrr"), hit(1), hit(3), hit(10), F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    tp, fp = F.count_if(F.col(label) & F.col(predicted)), F.count_if(~F.col(label) & F.col(predicted))
    fn, n = F.count_if(F.col(label) & ~F.col(predicted)), F.count(F.lit(1))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return df.agg(n.alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), safe(n - fp - fn, n).alias("accuracy"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve of score for a boolean label by the rank sum, ties counting half; ranks from value counts."""
    from pyspark.sql.window import Window

    c = scored.groupBy("score").agg(F.count_if("label").cast("double").alias("p"), F.count_if(~F.col("label")).cast("double").alias("q"))
    c = c.withColumn("below", F.sum("q").over(Window.orderBy("score")) - F.col("q"))
    return c.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def message_pass(vectors: DataFrame, edges: DataFrame, dim: int, keep: float = 0.5) -> DataFrame:
    """id, v: each vector mixed with the weighted mean of its neighbours' (edges src, dst, weight). One shuffle by
    target with partial sums, so a hub's messages are added up before they meet."""
    j = edges.join(vectors.select(F.col("id").alias("src"), "v"), "src")
    w = F.sum("weight")
    mean = j.groupBy("dst").agg(F.array(*(F.sum(F.col("v")[i] * F.col("weight")) / w for i in range(dim))).alias("m"))
    return vectors.join(mean, F.col("id") == F.col("dst"), "left").select("id", F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda x, y: keep * x + (1 - keep) * y)).alias("v"))


def propagate_up(vectors: DataFrame, parents: DataFrame, dim: int, levels: int = 2) -> DataFrame:
    """Children's mean mixed into their parents (child, parent), level by level."""
    up = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    for _ in range(levels):
        vectors = message_pass(vectors, up, dim)
    return vectors


def train_translation(triples: DataFrame, configs: list[dict], most_triples: int = 200_000) -> DataFrame:
    """config, node_id, v: translation embeddings of (head, relation, tail), one task per configuration.

    Training is sequential, so it runs on a bounded sample of the triples (most_triples, by hash); configurations
    (dim, epochs, rate, margin, seed) run side by side. A node that only other triples hold keeps the vector by hash that
    it would have begun with.
    """
    import numpy as np
    import pandas as pd

    spark = triples.sparkSession
    share = min(1.0, most_triples / max(1, triples.count()))
    part = triples.where(F.pmod(F.xxhash64("head", "relation", "tail"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    grid = spark.createDataFrame([(i, str(c)) for i, c in enumerate(configs)], "config int, _c string")

    def train(key, f: pd.DataFrame) -> pd.DataFrame:
        c = {"dim": 16, "epochs": 20, "rate": 0.05, "margin": 1.0, "seed": 42} | configs[int(key[0])]
        f = f.sort_values(["head", "relation", "tail"])
        nodes = sorted(set(f["head"]) | set(f["tail"]))
        at, rel = {n: i for i, n in enumerate(nodes)}, {r: i for i, r in enumerate(sorted(set(f["relation"])))}
        rng = np.random.default_rng(c["seed"])
        e, r = rng.normal(size=(len(nodes), c["dim"])), rng.normal(size=(len(rel), c["dim"])) * 0.1
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        h, t, k = (np.array([m[x] for x in f[col]]) for m, col in ((at, "head"), (at, "tail"), (rel, "relation")))
        for _ in range(c["epochs"]):
            fake = rng.integers(0, len(nodes), len(t))
            d, g = e[h] + r[k] - e[t], e[h] + r[k] - e[fake]
            on = (c["margin"] + np.linalg.norm(d, axis=1) - np.linalg.norm(g, axis=1) > 0)[:, None]
            du, gu = (on * x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9) for x in (d, g))
            for where, step in ((h, gu - du), (t, du), (fake, -gu)):
                np.add.at(e, where, c["rate"] * step)
            np.add.at(r, k, c["rate"] * (gu - du))
            e /= np.linalg.norm(e, axis=1, keepdims=True)
        return pd.DataFrame({"config": key[0], "node_id": nodes, "v": list(e)})

    trained = grid.join(part, how="cross").groupBy("config").applyInPandas(train, "config int, node_id string, v array<double>")
    if share >= 1:
        return trained
    ends = triples.select(F.col("head").alias("node_id")).unionByName(triples.select(F.col("tail").alias("node_id"))).distinct()
    width = F.create_map(*(F.lit(x) for i, c in enumerate(configs) for x in (i, ({"dim": 16} | c)["dim"])))[F.col("config")]
    first = F.transform(F.sequence(F.lit(1), width), lambda i: F.pmod(F.xxhash64("node_id", i), F.lit(2001)) / 1000.0 - 1.0)
    every = grid.select("config").join(ends, how="cross").join(trained.withColumnRenamed("v", "_v"), ["config", "node_id"], "left")
    return every.select("config", "node_id", F.coalesce("_v", unit(first)).alias("v"))


# link prediction, fusion ----------------------------------------------------------------------------------


def link_distance(triples: DataFrame, nodes: DataFrame, relations: DataFrame, distance=translate_distance) -> DataFrame:
    """head, relation, tail, distance: the lower, the likelier; triples with an unknown end are left out."""
    v = lambda df, key, name: df.select(F.col(df.columns[0]).alias(key), F.col("v").alias(name))
    j = triples.join(v(nodes, "head", "_h"), "head").join(v(nodes, "tail", "_t"), "tail").join(v(relations, "relation", "_r"), "relation")
    return j.select("head", "relation", "tail", distance("_h", "_r", "_t").alias("distance"))


def predict_tails(queries: DataFrame, nodes: DataFrame, relations: DataFrame, k: int = 10, known: DataFrame | None = None) -> DataFrame:
    """head, relation, tail, distance of the k nearest tails of each query (head, relation); known triples are filtered out.

    A query wants the node nearest to head plus relation, so it is one of the vectors that are searched in blocks.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.window import Window

    q = queries.join(nodes.select(F.col("id").alias("head"), F.col("v").alias("_h")), "head").join(relations.select(F.col("id").alias("relation"), F.col("v").alias("_r")), "relation")
    q = q.select("head", "relation", F.zip_with("_h", "_r", lambda x, y: x + y).alias("q"))
    block = 1024

    def blocks(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64(cols[0]), F.lit(n))).agg(F.collect_list(F.struct(*cols)).alias(name)).select(name)

    more = 0
    if known is not None:  # a head has so many known tails at most, which are searched beside the k
        more = known.groupBy("head", "relation").agg(F.count_distinct("tail").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def best(frames):
        for f in frames:
            for qs, ns in zip(f["qs"], f["ns"]):
                x, y = np.stack([np.asarray(r["q"], float) for r in qs]), np.stack([np.asarray(r["v"], float) for r in ns])
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
                ids = np.array([r["id"] for r in ns], object)
                for r, row in zip(qs, d):
                    top = np.lexsort((ids.astype(str), np.round(row, 9)))[: k + more + 1]
                    yield pd.DataFrame({"head": r["head"], "relation": r["relation"], "tail": ids[top], "distance": row[top]})

    kind = dict(nodes.dtypes)["id"]
    found = blocks(q, ["head", "relation", "q"], "qs").crossJoin(blocks(nodes, ["id", "v"], "ns")).repartition(q.sparkSession.sparkContext.defaultParallelism).mapInPandas(best, f"head {kind}, relation string, tail {kind}, distance double").where("head <> tail")
    if known is not None:
        found = found.join(known.select("head", "relation", "tail").distinct(), ["head", "relation", "tail"], "left_anti")
    w = Window.partitionBy("head", "relation").orderBy(F.round("distance", 9), F.col("tail").cast("string"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_epoch(history: DataFrame) -> DataFrame:
    return history.agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))


def adversarial_loss(positive: Column, negatives: Column, margin: float = 6.0, temperature: float = 1.0) -> Column:
    """-log sigmoid(margin - positive) - sum of softmax(temperature * d) * log sigmoid(d - margin) over the negatives d."""
    log_sigmoid = lambda x: -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))
    top = F.array_max(negatives)
    e = F.transform(negatives, lambda d: F.exp(temperature * (d - top)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    pull = F.aggregate(F.zip_with(negatives, e, lambda d, w: w * log_sigmoid(d - margin)), F.lit(0.0), lambda s, x: s + x)
    return -log_sigmoid(margin - positive) - pull / total


def subset(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_semi")


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """rows with batch, a number that at most so many rows of a partition share; batches never span partitions."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 33, 0
        for b in it:
            number = base + (done + np.arange(b.num_rows)) // size
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], names=[*b.schema.names, "batch"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", batch bigint")


def fuse_pca(a: DataFrame, b: DataFrame, k: int | None = None, share: float = 0.95) -> DataFrame:
    """id, v: both vectors one after the other, on their first k principal axes, or on as many as hold a share of the variance.

    The axes are the eigenvectors of the scatter matrix, which is symmetric: that always converges, the singular values
    of pyspark.ml's PCA need not. Each batch adds its part of the matrix; an axis points to where its largest entry is positive.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from lociflow.operators.gnn import linear

    x = fuse_concat(a, b).withColumn("v", F.col("v").cast("array<double>"))
    dim = len(x.first()["v"])
    mean = np.array(x.agg(F.array(*(F.avg(F.col("v")[i]) for i in range(dim))).alias("m")).first()["m"])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            y = np.asarray(batch.column("v").flatten(), float).reshape(-1, dim) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "r"])

    rows = x.select("v").mapInArrow(scatter, "i int, r array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("r")[j]) for j in range(dim))).alias("r"))
    variance, axes = np.linalg.eigh(np.array([r["r"] for r in rows.sort("i").collect()]))
    variance, axes = np.maximum(variance[::-1], 0), axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(dim)])
    if k is None:
        held = np.cumsum(variance) / (variance.sum() or 1.0)
        k = int((held < share).sum()) + 1 if held[-1] >= share else dim
    return linear(x, axes[:, :k].tolist(), (-mean @ axes[:, :k]).tolist())


def fuse_attention(sources: list[DataFrame]) -> DataFrame:
    """id, v: sources that all have the id, filled with zeros to equal length, mixed by scaled dot-product self-attention and averaged."""
    names = [f"v{i}" for i in range(len(sources))]
    j = sources[0].select("id", F.col("v").alias("v0"))
    for name, s in zip(names[1:], sources[1:]):
        j = j.join(s.select("id", F.col("v").alias(name)), "id")
    dim = F.greatest(*(F.size(n) for n in names)) if len(names) > 1 else F.size("v0")
    filled = lambda n: F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.coalesce(F.get(F.col(n), i), F.lit(0.0)))
    scaled = lambda v, by: F.transform(v, lambda x: x * by)
    padded = j.select("id", *(filled(n).alias(n) for n in names))
    out = F.transform("v0", lambda x: x * 0.0)
    for a in names:
        s = [dot(a, b) / F.sqrt(F.size(a)) for b in names]
        top = F.greatest(*s) if len(s) > 1 else s[0]
        e = [F.exp(x - top) for x in s]
        total = sum(e[1:], e[0])
        for b, w in zip(names, e):
            out = F.zip_with(out, scaled(b, w / total / len(names)), lambda x, y: x + y)
    return padded.select("id", out.alias("v"))


def fuse_learned(a: DataFrame, b: DataFrame, first: list[list[float]], second: list[list[float]]) -> DataFrame:
    """id, v: both vectors one after the other through two layers, relu between them; the weights are given."""
    from lociflow.operators.gnn import linear

    return linear(linear(fuse_concat(a, b), first, relu=True), second)


def train_rotation(triples: DataFrame, dim: int = 8, epochs: int = 20, rate: float = 0.1, margin: float = 3.0, seed: int = 42, most_triples: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(node_id, v) and (epoch, loss): relations turn each complex coordinate of the head towards the tail's.

    Trained in one task on at most most_triples triples by hash; a node of the other triples keeps the vector it began with.
    """
    import numpy as np
    import pandas as pd

    share = min(1.0, most_triples / max(1, triples.count()))
    part = triples.where(F.pmod(F.xxhash64("head", "relation", "tail"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    ends = triples.select(F.col("head").alias("node_id")).unionByName(triples.select(F.col("tail").alias("node_id"))).distinct()

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["head", "relation", "tail"])
        nodes, kinds = sorted(set(f["head"]) | set(f["tail"])), sorted(set(f["relation"]))
        at, rel = {n: i for i, n in enumerate(nodes)}, {r: i for i, r in enumerate(kinds)}
        rng = np.random.default_rng(seed)
        e, phase = rng.normal(size=(len(nodes), 2, dim)) / dim**0.5, rng.uniform(-np.pi, np.pi, (len(kinds), dim))
        h, t, k = (np.array([m[x] for x in f[c]]) for m, c in ((at, "head"), (at, "tail"), (rel, "relation")))
        out = []
        for epoch in range(epochs):
            fake = rng.integers(0, len(nodes), len(t))
            cos, sin = np.cos(phase[k]), np.sin(phase[k])
            turned = np.stack([e[h, 0] * cos - e[h, 1] * sin, e[h, 0] * sin + e[h, 1] * cos], 1)
            d, g = turned - e[t], turned - e[fake]
            ld, lg = (np.sqrt((x**2).sum((1, 2))) + 1e-9 for x in (d, g))
            s = lambda x: 1 / (1 + np.exp(-x))
            out.append(float(np.mean(-np.log(s(margin - ld)) - np.log(s(lg - margin)))))
            du, gu = s(ld - margin)[:, None, None] * d / ld[:, None, None], s(margin - lg)[:, None, None] * g / lg[:, None, None]
            pull = du - gu
            np.add.at(e, t, rate * du)
            np.add.at(e, fake, -rate * gu)
            np.add.at(e, h, -rate * np.stack([pull[:, 0] * cos + pull[:, 1] * sin, -pull[:, 0] * sin + pull[:, 1] * cos], 1))
            np.add.at(phase, k, -rate * (du[:, 0] * -turned[:, 1] + du[:, 1] * turned[:, 0]))
        rows = pd.DataFrame({"node_id": nodes, "v": [x.reshape(-1) for x in e], "epoch": None, "loss": None})
        return pd.concat([rows, pd.DataFrame({"node_id": None, "v": None, "epoch": range(epochs), "loss": out})])

    from lociflow.session import cut

    got = cut(part.select("head", "relation", "tail", F.lit(0).alias("all")).groupBy("all").applyInPandas(train, "node_id string, v array<double>, epoch int, loss double"))
    first = F.transform(F.sequence(F.lit(1), F.lit(2 * dim)), lambda i: F.pmod(F.xxhash64("node_id", i), F.lit(2001)) / 1000.0 - 1.0)
    vectors = ends.join(got.where("node_id IS NOT NULL").select("node_id", "v"), "node_id", "left").select("node_id", F.coalesce("v", first).alias("v"))
    return vectors, got.where("epoch IS NOT NULL").select("epoch", "loss")

import numpy as np
from pyspark.sql import functions as F

from lociflow.operators import causal as C
from lociflow.operators import consensus as S
from lociflow.operators import embeddings as E
from lociflow.operators import gnn as N
from lociflow.operators import rules as RU
from lociflow.operators import verify as V


def blobs(k=3, each=20, dim=4):
    rng = np.random.default_rng(0)
    return np.vstack([rng.normal(6 * i, 0.5, (each, dim)) for i in range(k)])


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id bigint, v array<double>")


def parts(rows):
    out = {}
    for r in rows:
        out.setdefault(r.label, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_ward_equals_brute_force():
    x = np.random.default_rng(2).normal(size=(25, 3))
    groups = [[i] for i in range(25)]
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > 4:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    label = S.ward(x, np.ones(25), 4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == c)) for c in set(label)}


def test_methods_and_consensus_find_clear_groups(spark):
    x = frame(spark, blobs())
    want = [list(range(20 * i, 20 * i + 20)) for i in range(3)]
    assert parts(S.fit_ward(x, 4, 3).collect()) == want
    assert parts(S.fit_ward(x, 4, 3, micro=12).collect()) == want
    labels = spark.createDataFrame([(r, i, (i // 20 + r) % 3) for r in range(4) for i in range(60)], "run int, id bigint, label int")
    assert parts(S.consensus(labels, 3).collect()) == want
    s = S.record_stability(labels).collect()
    assert len(s) == 60 and all(r.stability == 1 for r in s)


def test_controls(spark):
    x = frame(spark, blobs())
    labels = spark.createDataFrame([(i, i // 20) for i in range(60)], "id bigint, label int")
    report = {r.control: r for r in S.control_report(S.controls(x, labels, 3, 30)).collect()}
    assert report["label_shuffle"].significant and report["label_shuffle"].observed > 0.8 > report["label_shuffle"].mean_null
    assert len(report) == 3 and S.confound_kind("site", False, 1.0) == "categorical" and S.confound_kind("x", False, 0.01) == "categorical" and S.confound_kind("age", False, 0.01) == "continuous"


def test_linear_and_network_layers(spark):
    x = np.random.default_rng(1).normal(size=(7, 3))
    w, b = N.draw(3, 2, 5), [0.1, -0.2]
    got = {r.id: r.v for r in N.linear(frame(spark, x), w, b, relu=True).collect()}
    assert all(np.allclose(got[i], np.maximum(x[i] @ np.array(w) + b, 0)) for i in range(7))
    assert N.linear(frame(spark, x[:0]), w).count() == 0


def test_rotation_learns_and_keeps_every_node(spark):
    t = spark.createDataFrame([(f"a{i}", "r", f"b{i}") for i in range(30)], "head string, relation string, tail string")
    vectors, history = E.train_rotation(t, epochs=30, rate=0.3)
    loss = {r.epoch: r.loss for r in history.collect()}
    assert loss[29] < loss[0] and vectors.count() == 60
    few, _ = E.train_rotation(t, epochs=1, most_triples=3)
    assert few.count() == 60 and few.where("v IS NULL").count() == 0


def test_pca_holds_the_variance(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 2))
    a, b = base @ rng.normal(size=(2, 3)), base @ rng.normal(size=(2, 4))
    got = E.fuse_pca(frame(spark, a), frame(spark, b)).collect()
    assert len(got) == 80 and len(got[0].v) == 2


def test_learned_gate_prefers_the_telling_score(spark):
    score = lambda f: spark.createDataFrame([(f"g{i}", f(i)) for i in range(40)], "gene string, score double")
    labels = spark.createDataFrame([(f"g{i}", int(i >= 20)) for i in range(40)], "gene string, label int")
    w = RU.fit_gate(score(lambda i: 1.0 if i >= 20 else 0.0), score(lambda i: float(i % 2)), labels)
    assert w[0] > 1 > abs(w[1])


def test_causal_query_and_adjustment(spark):
    import pytest

    e = C.example(spark)
    assert C.identify(e, "SHANK3_variant", "asd_phenotype").endswith("P(ancestry)")
    with pytest.raises(ValueError):
        C.Query().on("asd_phenotype").build(e)
    assert C.Query().do("SHANK3_variant").on("asd_phenotype").mediated_by("synaptic_pathway").build(e).first().indirect is not None
    confounded = spark.createDataFrame([(f"u{i}", x, "confounds", 0.5) for i in range(3) for x in ("t", "y")] + [("t", "y", "causes", 0.5)], "source string, target string, kind string, strength double")
    assert C.Graph(confounded).adjustment_sets("t", "y") == [{"u0", "u1", "u2"}]


def test_provenance_hashes_and_tables(spark, tmp_path):
    p = V.Provenance.current("GRCh38", "v1", "s1")
    p.save(str(tmp_path / "p.json"))
    q = V.Provenance.load(str(tmp_path / "p.json"))
    assert q == p and q.conflicts(V.Provenance("GRCh37", "v1", "s1", "0")) == ["reference"]
    assert V.check_hashes({str(tmp_path / "p.json"): V.file_hash(str(tmp_path / "p.json")), "/nowhere": "0"}) == {str(tmp_path / "p.json"): True, "/nowhere": False}
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, None), (5, 2.0)], "k int, v double")
    r = V.compare_tables(a, b, ["k"], "v").first()
    assert (r.rows, r.only_a, r.only_b, r.differ, r.largest) == (5, 1, 1, 1, 0.5)
    assert V.seeded(3)[0].random() == V.seeded(3)[0].random() and F is not None

import pytest
from pyspark.sql import functions as F

from lociflow.functions.hashed import hash_vector, sequence_vector, text_vector
from lociflow.functions.tails import chi2_p, normal_p, student_p
from lociflow.operators import causal as C
from lociflow.operators import embeddings as E


def test_tails(spark):
    df = spark.createDataFrame([(1.959964, 2.228139, 10.0, 3.841459, 1.0), (0.0, 0.0, 3.0, 18.307038, 10.0), (None, None, None, None, None)], "z double, t double, d double, x double, k double")
    a, b, c = df.select(normal_p(F.col("z")).alias("n"), student_p(F.col("t"), F.col("d")).alias("s"), chi2_p(F.col("x"), F.col("k")).alias("c")).collect()
    assert a.n == pytest.approx(0.05, abs=1e-6) and a.s == pytest.approx(0.05, abs=1e-6) and a.c == pytest.approx(0.05, abs=1e-6)
    assert b.n == pytest.approx(1) and b.s == pytest.approx(1) and b.c == pytest.approx(0.05, abs=1e-6)
    assert c.n is None and c.s is None and c.c is None


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("MKV", "a synapse"), ("MKV", "a synapse"), ("M1", None)], "s string, t string")
    r = df.select(hash_vector(F.col("s"), 16).alias("h"), sequence_vector(F.col("s"), 24).alias("q"), text_vector(F.col("t"), ["synapse"], 16).alias("x")).collect()
    assert r[0] == r[1] and sum(v * v for v in r[0].h) == pytest.approx(1) and len(r[0].q) == 24 and r[2].q is None


def test_messages_and_training(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [5.0, 5.0])], "id string, v array<double>")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0)], "src string, dst string, weight double")
    assert {r.id: r.v for r in E.message_pass(v, e, 2).collect()} == {"a": [0.5, 0.5], "b": [0.5, 0.5], "c": [5.0, 5.0]}
    t = spark.createDataFrame([(f"h{i}", "r", f"t{i % 3}") for i in range(30)], "head string, relation string, tail string")
    got = E.train_translation(t, [{"dim": 4}, {"dim": 6, "epochs": 5}]).collect()
    assert {(r.config, len(r.v)) for r in got} == {(0, 4), (1, 6)} and len(got) == 66


def test_causal_decisions(spark):
    g = C.Graph(C.example(spark))
    assert not g.separated("SHANK3_variant", "asd_phenotype", set())
    assert g.separated("CHD8_variant", "SHANK3_variant", set()) and not g.separated("CHD8_variant", "SHANK3_variant", {"cortical_circuit"})
    assert g.adjustment_sets("SHANK3_variant", "asd_phenotype") == [{"ancestry"}] and g.adjustment_sets("CHD8_variant", "asd_phenotype") == [set()]
    m = C.mediation(C.example(spark), "SHANK3_variant", "asd_phenotype", "synaptic_pathway").first()
    assert m.total == pytest.approx(m.direct + m.indirect)

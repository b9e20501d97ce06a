"""Rules as data: a rule is a conjunction of predicates over (sample, gene) facts, evaluated for all samples at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    rule_id: str
    kind: str
    confidence: float
    needs: tuple[str, ...]  # predicates that must hold
    without: tuple[str, ...] = ()  # predicates that must not hold


def predicates(pli: float = 0.9, prenatal: float = 1.0) -> dict[str, Column]:
    """Named predicates over one fact row; what is unknown does not hold."""
    no = F.lit(False)
    return {
        "lof": F.coalesce("has_lof", no), "damaging": F.coalesce("has_damaging", no), "missense": F.coalesce("has_damaging_missense", no),
        "constrained": F.coalesce(F.col("pli") >= pli, no), "listed": F.col("score").isNotNull(), "high_confidence": F.coalesce(F.col("score") == 1, no),
        "syndromic": F.coalesce("syndromic", no),
    }


def facts(annotated: DataFrame, constraint: DataFrame, disease: DataFrame) -> DataFrame:
    """One row per sample and gene: what its variants show, with the gene's constraint and listing."""
    v = annotated.where("gene IS NOT NULL AND sample_id IS NOT NULL").groupBy("sample_id", "gene").agg(F.max("is_lof").alias("has_lof"), F.max("is_damaging").alias("has_damaging"), F.max("is_damaging_missense").alias("has_damaging_missense"))
    return v.join(constraint.select("gene", "pli", "loeuf"), "gene", "left").join(disease.select("gene", "score", "syndromic"), "gene", "left")


def fire(facts: DataFrame, rules: list[Rule], more: dict[str, Column] | None = None) -> DataFrame:
    """sample_id, rule_id, kind, confidence, gene (the first), n_genes: at most one firing per sample and rule.

    more: further predicates by name."""
    p = predicates() | (more or {})
    tests = []
    for r in rules:
        c = F.lit(True)
        for name in r.needs:
            c = c & p[name]
        for name in r.without:
            c = c & ~p[name]
        tests.append(F.when(c, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.confidence).alias("confidence"))))
    hits = facts.select("sample_id", "gene", F.inline(F.array_compact(F.array(*tests))))
    return hits.groupBy("sample_id", "rule_id", "kind", "confidence").agg(F.min("gene").alias("gene"), F.count(F.lit(1)).alias("n_genes"))


def set_flags(facts: DataFrame, sets: DataFrame, names: list[str]) -> DataFrame:
    """facts with in_<name> for each named set of sets (set_name, gene): targets, synaptic, expressed or enriched genes."""
    has = sets.where(F.col("set_name").isin(names)).groupBy("gene").agg(F.collect_set("set_name").alias("_sets"))  # at most one per name
    j = facts.join(has, "gene", "left")
    return j.withColumns({f"in_{n}": F.coalesce(F.array_contains("_sets", n), F.lit(False)) for n in names}).drop("_sets")


def fire_sets(flagged: DataFrame, rules: list[Rule]) -> DataFrame:
    """fire() with the predicates in_<name> of set_flags beside the others."""
    return fire(flagged, rules, {c: F.col(c) for c in flagged.columns if c.startswith("in_")})


def independent_hits(facts: DataFrame, least: int = 2) -> DataFrame:
    """sample_id, n_hits of samples with so many damaged genes."""
    return facts.where("has_damaging").groupBy("sample_id").agg(F.count_distinct("gene").alias("n_hits")).where(F.col("n_hits") >= least)


def drug_rule(facts: DataFrame, membership: DataFrame, targets: DataFrame, mechanisms: DataFrame, functions: DataFrame, least: int = 2) -> DataFrame:
    """sample_id, pathway_id, candidate_id: a set disrupted in the sample of which the candidate targets a member and with
    whose description its mechanism shares a word."""
    from lociflow.operators.ranking import shares_word

    hit = several_hits(facts, membership, least).select("sample_id", "pathway_id")
    able = targets.join(membership, "gene").select("candidate_id", "pathway_id").distinct().join(mechanisms, "candidate_id").join(functions, "pathway_id").where(shares_word(F.col("mechanism"), F.col("function")))
    return hit.join(able.select("pathway_id", "candidate_id"), "pathway_id").select("sample_id", "pathway_id", "candidate_id")


def steps(fired: DataFrame) -> DataFrame:
    """sample_id, step, rule_id, gene: the rules of a sample numbered, those of one gene together, the surest gene first."""
    from pyspark.sql.window import Window

    top = F.max("confidence").over(Window.partitionBy("sample_id", "gene"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("_top"), "gene", F.desc("confidence"), "rule_id")
    return fired.withColumn("_top", top).withColumn("step", F.row_number().over(order)).select("sample_id", "step", "rule_id", "gene")


def report_lines(fired: DataFrame, per_kind: int = 5) -> DataFrame:
    """sample_id, kind, line: the surest rules of each kind as text."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("sample_id", "kind").orderBy(F.desc("confidence"), "rule_id", "gene")
    text = F.concat("rule_id", F.lit(": "), F.col("gene"), F.lit(" ("), F.format_number("confidence", 2), F.lit(")"))
    return fired.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_kind).select("sample_id", "kind", F.col("_r").alias("rank"), text.alias("line"))


def several_hits(facts: DataFrame, membership: DataFrame, least: int = 2) -> DataFrame:
    """sample_id, pathway_id with so many damaged genes of one set: the rule that quantifies over sets."""
    hit = facts.where("has_damaging").join(membership, "gene")
    return hit.groupBy("sample_id", "pathway_id").agg(F.count_distinct("gene").alias("n_genes")).where(F.col("n_genes") >= least)


def paralog_intact(facts: DataFrame, paralogs: DataFrame) -> DataFrame:
    """sample_id, gene, paralog: loss of function of a gene whose paralog is not damaged in the sample."""
    damaged = facts.where("has_damaging").select("sample_id", F.col("gene").alias("paralog"))
    return facts.where("has_lof").select("sample_id", "gene").join(paralogs, "gene").join(damaged, ["sample_id", "paralog"], "left_anti").select("sample_id", "gene", "paralog")


def summary(fired: DataFrame) -> DataFrame:
    return fired.groupBy("rule_id", "kind").agg(F.count_distinct("sample_id").alias("n_samples"), F.sum("n_genes").alias("n_genes"), F.avg("confidence").alias("mean_confidence"))


def chains(fired: DataFrame) -> DataFrame:
    """Per sample its rules in order of confidence, the mean confidence and the genes. Rules are a bounded list."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "rule_id")))
    return fired.groupBy("sample_id").agg(F.transform(steps, lambda s: s["rule_id"]).alias("rules"), F.avg("confidence").alias("mean_confidence"), F.array_sort(F.collect_set("gene")).alias("genes"))


def combine_scores(neural: DataFrame, symbolic: DataFrame, how: str = "weighted_sum", weight: float = 0.6) -> DataFrame:
    """gene, score of two scores (gene, score) by full outer join, 0 where one lacks the gene."""
    j = neural.select("gene", F.col("score").alias("n")).join(symbolic.select("gene", F.col("score").alias("s")), "gene", "full_outer").select("gene", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    n, s = F.col("n"), F.col("s")
    value = {"weighted_sum": weight * n + (1 - weight) * s, "max": F.greatest(n, s), "product": F.sqrt((n + 0.01) * (s + 0.01)), "mean": (n + s) / 2}
    if how == "magnitude":
        t = j.agg(F.avg(F.abs("n")).alias("an"), F.avg(F.abs("s")).alias("as"))
        return j.crossJoin(F.broadcast(t)).select("gene", F.coalesce(F.try_divide(n * F.col("an") + s * F.col("as"), F.col("an") + F.col("as")), F.lit(0.0)).alias("score"))
    return j.select("gene", value[how].alias("score"))


def gated_scores(neural: DataFrame, symbolic: DataFrame, how: str, weights: dict[str, tuple[float, ...]]) -> DataFrame:
    """gene, score by a small network over both scores, 0 where one lacks the gene; the weights are given.

    gate: n and s mixed by sigmoid(a n + b s + c). mlp: relu units (a, b, c) and their output weights "out", sigmoid.
    attention: softmax over keys of n and s. rules: symbolic weighted by 1 + a s before the gate.
    """
    j = neural.select("gene", F.col("score").alias("n")).join(symbolic.select("gene", F.col("score").alias("s")), "gene", "full_outer").select("gene", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))
    n, s = F.col("n"), F.col("s")
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    line = lambda w: w[0] * n + w[1] * s + w[2]
    if how == "gate":
        g = sigmoid(line(weights["gate"]))
        out = g * n + (1 - g) * s
    elif how == "mlp":
        hidden = [F.greatest(F.lit(0.0), line(w)) for k, w in sorted(weights.items()) if k != "out"]
        out = sigmoid(sum((w * h for w, h in zip(weights["out"], hidden)), F.lit(weights["out"][-1])))
    elif how == "attention":
        a, b = F.exp(line(weights["neural"])), F.exp(line(weights["symbolic"]))
        out = (a * n + b * s) / (a + b)
    else:
        g = sigmoid(line(weights["gate"]))
        out = g * n + (1 - g) * s * (1 + weights["rule"][0] * s)
    return j.select("gene", out.alias("score"))


def fit_gate(neural: DataFrame, symbolic: DataFrame, labels: DataFrame, rounds: int = 50, rate: float = 1.0) -> tuple[float, float, float]:
    """Weights (a, b, c) of a logistic mix of both scores fitted to labels (gene, label 0 or 1): full-gradient steps, each
    one aggregation, so that only three sums reach the driver."""
    from lociflow.session import keep

    j = keep(labels.join(neural.select("gene", F.col("score").alias("n")), "gene", "left").join(symbolic.select("gene", F.col("score").alias("s")), "gene", "left").select("label", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s")))
    w = (0.0, 0.0, 0.0)
    for _ in range(rounds):
        error = F.col("label") - 1 / (1 + F.exp(-(w[0] * F.col("n") + w[1] * F.col("s") + w[2])))
        g = j.agg(F.avg(error * F.col("n")), F.avg(error * F.col("s")), F.avg(error)).first()
        w = tuple(x + rate * (y or 0.0) for x, y in zip(w, g))
    j.unpersist()
    return w


def integrate(neural: DataFrame, symbolic: DataFrame, weight: float = 0.6) -> DataFrame:
    """gene, score: both scores mixed and divided by the largest."""
    c = combine_scores(neural, symbolic, "weighted_sum", weight)
    top = c.agg(F.max("score").alias("_m"))
    return c.crossJoin(F.broadcast(top)).select("gene", F.coalesce(F.try_divide("score", "_m"), F.lit(0.0)).alias("score"))

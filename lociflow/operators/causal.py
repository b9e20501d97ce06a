"""Queries of a structural causal model: a small directed acyclic graph as edges (source, target, kind, strength).

The graph is a dimension; closures and paths are recursive queries over it, values are propagated level by level
for all scenarios in one frame (scenario, node_id, value).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a parent's value that an edge of a kind passes on. Fixed values.
FACTOR = {"causes": 1.0, "confounds": 0.5}
OTHER_FACTOR, ROOT = 0.7, 0.5
#: A worked example: variants, gene functions, pathways, a circuit, a phenotype and a confounder. Fixed values.
EXAMPLE = [
    ("SHANK3_variant", "SHANK3_function", "causes", 0.9),
    ("CHD8_variant", "CHD8_function", "causes", 0.85),
    ("SCN2A_variant", "SCN2A_function", "causes", 0.8),
    ("SHANK3_function", "synaptic_pathway", "causes", 0.85),
    ("CHD8_function", "chromatin_pathway", "causes", 0.8),
    ("SCN2A_function", "ion_channel_pathway", "causes", 0.75),
    ("CHD8_function", "synaptic_pathway", "modifies", 0.3),
    ("synaptic_pathway", "cortical_circuit", "causes", 0.7),
    ("chromatin_pathway", "cortical_circuit", "causes", 0.5),
    ("ion_channel_pathway", "cortical_circuit", "causes", 0.6),
    ("cortical_circuit", "asd_phenotype", "causes", 0.8),
    ("synaptic_pathway", "asd_phenotype", "causes", 0.3),
    ("ancestry", "SHANK3_variant", "confounds", 0.2),
    ("ancestry", "asd_phenotype", "confounds", 0.1),
]


def example(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE, "source string, target string, kind string, strength double")


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, descendant, depth (the longest way)."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE c(ancestor, descendant, depth) AS (
             SELECT source, target, 1 FROM {e} UNION ALL SELECT c.ancestor, e.target, c.depth + 1 FROM c JOIN {e} e ON c.descendant = e.source)
           SELECT ancestor, descendant, max(depth) AS depth FROM c GROUP BY 1, 2""",
        e=edges,
    )


def paths(edges: DataFrame, start: str, end: str, directed: bool = True) -> DataFrame:
    """All simple paths from start to end: path, strength (product of the edges')."""
    both = edges.select("source", "target", "strength")
    if not directed:
        both = both.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "strength"))
    return edges.sparkSession.sql(
        """WITH RECURSIVE p(path, last, strength) AS (
             SELECT array(source, target), target, strength FROM {e} WHERE source = :start
             UNION ALL SELECT concat(p.path, array(e.target)), e.target, p.strength * e.strength FROM p JOIN {e} e ON p.last = e.source
             WHERE p.last <> :end AND NOT array_contains(p.path, e.target))
           SELECT path, strength FROM p WHERE last = :end""",
        args={"start": start, "end": end}, e=both,
    )


class Graph:
    """The same graph on the driver, for the decisions that need all of it at once. Its size is that of a model."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = [tuple(r) for r in edges.select("source", "target", "kind", "strength").collect()]
        self.pairs = {(s, t) for s, t, _, _ in self.edges}
        self.nodes = sorted({x for p in self.pairs for x in p})

    def descendants(self, x: str) -> set[str]:
        out, todo = set(), [x]
        while todo:
            n = todo.pop()
            for s, t in self.pairs:
                if s == n and t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def order(self) -> list[str]:
        out: list[str] = []
        while len(out) < len(self.nodes):
            free = [n for n in self.nodes if n not in out and all(s in out for s, t in self.pairs if t == n)]
            if not free:
                raise ValueError("the graph has a cycle")
            out += free
        return out

    def undirected(self, a: str, b: str) -> list[list[str]]:
        out, todo = [], [[a]]
        while todo:
            p = todo.pop()
            for s, t in self.pairs:
                for x, y in ((s, t), (t, s)):
                    if x == p[-1] and y not in p:
                        (out if y == b else todo).append([*p, y])
        return sorted(out)

    def blocked(self, path: list[str], given: set[str]) -> bool:
        for x, m, y in zip(path, path[1:], path[2:]):
            if (x, m) in self.pairs and (y, m) in self.pairs:
                if m not in given and not self.descendants(m) & given:
                    return True
            elif m in given:
                return True
        return False

    def separated(self, a: str, b: str, given: set[str]) -> bool:
        return a != b and all(self.blocked(p, given) for p in self.undirected(a, b))

    def backdoor(self, a: str, b: str) -> list[list[str]]:
        return [p for p in self.undirected(a, b) if (p[1], p[0]) in self.pairs]

    def adjustment_sets(self, a: str, b: str) -> list[set[str]]:
        """The smallest sets of non-descendants that block every backdoor path; none: no set does."""
        ways = self.backdoor(a, b)
        open_ = [p for p in ways if not self.blocked(p, set())]
        if not open_:
            return [set()]
        able = [n for n in self.nodes if n not in {a, b} | self.descendants(a)]
        for k in range(1, len(able) + 1):
            found = [set(c) for c in combinations(able, k) if all(self.blocked(p, set(c)) for p in ways)]
            if found:
                return found
        return []


def propagate(edges: DataFrame, scenarios: dict[str, dict[str, float]], factors: bool = True, equations: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> DataFrame:
    """scenario, node_id, value: set values cut their in-edges, roots are 0.5, others the weighted mean of their parents.

    equations: node -> a function of its parents' columns that takes the place of the mean.
    """
    g, spark = Graph(edges), edges.sparkSession
    expr: dict[str, Column] = {}
    rows = [(name, k, float(v)) for name, s in scenarios.items() for k, v in s.items()]
    names = spark.createDataFrame([(n,) for n in scenarios], "scenario string")
    fixed = names.join(spark.createDataFrame(rows, "scenario string, node string, v double").groupBy("scenario").pivot("node", sorted({r[1] for r in rows})).agg(F.first("v")), "scenario", "left") if rows else names
    wide = fixed
    for n in g.order():  # one column per node: the whole model is one projection over the scenarios
        parents = [(s, k, w) for s, t, k, w in g.edges if t == n]
        total = sum(w for _, _, w in parents)
        mean = F.lit(ROOT) if not parents or not total else sum((expr[s] * (w * (FACTOR.get(k, OTHER_FACTOR) if factors else 1.0)) for s, k, w in parents), F.lit(0.0)) / total
        if equations and n in equations:
            mean = equations[n]({s: expr[s] for s, _, _ in parents})
        wide = wide.withColumn(f"_{n}", F.coalesce(F.col(n), mean) if n in wide.columns else mean)
        expr[n] = F.col(f"_{n}")
    return wide.select("scenario", F.inline(F.array(*(F.struct(F.lit(n).alias("node_id"), F.col(f"_{n}").alias("value")) for n in g.nodes))))


def effect(edges: DataFrame, treatment: str, outcome: str, given: dict[str, float] | None = None) -> DataFrame:
    """Average effect of setting treatment from 0 to 1."""
    v = propagate(edges, {"off": (given or {}) | {treatment: 0.0}, "on": (given or {}) | {treatment: 1.0}}).where(F.col("node_id") == outcome)
    on, off = F.max(F.when(F.col("scenario") == "on", F.col("value"))), F.max(F.when(F.col("scenario") == "off", F.col("value")))
    return v.agg((on - off).alias("effect"))


def counterfactual(edges: DataFrame, facts: dict[str, float], change: dict[str, float], query: str) -> DataFrame:
    """factual, counterfactual, difference: residuals of the facts are kept while the change is made."""
    g = Graph(edges)

    def expected(n: str, values: dict[str, float]) -> float:
        parents = [(s, w) for s, t, _, w in g.edges if t == n]
        total = sum(w for _, w in parents)
        return sum(values[s] * w for s, w in parents) / total if total else ROOT

    known: dict[str, float] = {}
    for n in g.order():
        known[n] = facts[n] if n in facts else expected(n, known)
    residual = {n: facts[n] - expected(n, known) for n in facts}
    new: dict[str, float] = {}
    for n in g.order():
        new[n] = change[n] if n in change else min(1.0, max(0.0, expected(n, new) + residual.get(n, 0.0)))
    was = facts.get(query, ROOT)
    return edges.sparkSession.createDataFrame([(query, was, new[query], new[query] - was)], "node_id string, factual double, counterfactual double, difference double")


def mediation(edges: DataFrame, treatment: str, outcome: str, mediator: str) -> DataFrame:
    """total, direct, indirect and the share that goes through the mediator."""
    base = propagate(edges, {"off": {treatment: 0.0}}).where(F.col("node_id") == mediator).first()["value"]
    v = propagate(edges, {"off": {treatment: 0.0}, "on": {treatment: 1.0}, "held": {treatment: 1.0, mediator: base}}).where(F.col("node_id") == outcome)
    x = {s: F.max(F.when(F.col("scenario") == s, F.col("value"))) for s in ("off", "on", "held")}
    total, direct = x["on"] - x["off"], x["held"] - x["off"]
    return v.agg(total.alias("total"), direct.alias("direct"), (total - direct).alias("indirect"), F.least(F.lit(1.0), F.abs(F.coalesce(F.try_divide(total - direct, total), F.lit(0.0)))).alias("share"))


def path_effects(edges: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """The total effect spread over the directed paths by the product of their strengths, and the rest."""
    p = paths(edges, treatment, outcome).crossJoin(F.broadcast(effect(edges, treatment, outcome)))
    each = p.select(F.concat_ws(" > ", "path").alias("path"), (F.col("effect") * F.col("strength")).alias("effect"))
    rest = effect(edges, treatment, outcome).crossJoin(each.agg(F.coalesce(F.sum("effect"), F.lit(0.0)).alias("s"))).select(F.lit("rest").alias("path"), (F.col("effect") - F.col("s")).alias("effect"))
    return each.unionByName(rest)


# questions to the model: every set of scenarios is one frame ---------------------------------------------


@dataclass
class Query:
    """A question put together step by step; the last of do, mediated_by and counterfactual says of what kind it is."""

    treatment: str | None = None
    outcome: str | None = None
    kind: str = "intervention"
    values: dict[str, float] = field(default_factory=dict)
    evidence: dict[str, float] = field(default_factory=dict)
    mediator: str | None = None

    def do(self, treatment: str, value: float = 1.0) -> Query:
        self.treatment, self.kind = treatment, "intervention"
        self.values[treatment] = value
        return self

    def on(self, outcome: str) -> Query:
        self.outcome = outcome
        return self

    def given(self, **evidence: float) -> Query:
        self.evidence |= evidence
        return self

    def mediated_by(self, mediator: str) -> Query:
        self.mediator, self.kind = mediator, "mediation"
        return self

    def counterfactual(self) -> Query:
        self.kind = "counterfactual"
        return self

    def build(self, edges: DataFrame) -> DataFrame:
        if not self.treatment or not self.outcome:
            raise ValueError("a query needs a treatment and an outcome")
        if self.kind == "mediation":
            return mediation(edges, self.treatment, self.outcome, self.mediator)
        if self.kind == "counterfactual":
            return counterfactual(edges, self.evidence, self.values, self.outcome)
        return propagate(edges, {"do": self.evidence | self.values}).where(F.col("node_id") == self.outcome)


def without_edge(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where((F.col("source") != source) | (F.col("target") != target))


def neighbours(edges: DataFrame) -> DataFrame:
    """node_id, parents, children of every node; a node's neighbours are few."""
    ends = edges.select(F.col("target").alias("node_id"), F.col("source").alias("parent"), F.lit(None).cast("string").alias("child")).unionByName(edges.select(F.col("source").alias("node_id"), F.lit(None).cast("string").alias("parent"), F.col("target").alias("child")))
    return ends.groupBy("node_id").agg(F.array_sort(F.collect_set("parent")).alias("parents"), F.array_sort(F.collect_set("child")).alias("children"))


def statistics(edges: DataFrame) -> DataFrame:
    """kind and how many edges and nodes have it; kind null: all."""
    e = edges.select("kind", F.explode(F.array("source", "target")).alias("node"), "source", "target")
    one = lambda g: g.agg(F.count_distinct("source", "target").alias("n_edges"), F.count_distinct("node").alias("n_nodes"))
    return one(e.groupBy("kind")).unionByName(one(e.withColumn("kind", F.lit(None).cast("string")).groupBy("kind")))


def variance(edges: DataFrame, outcome: str) -> DataFrame:
    """0.01 and, for each way from an ancestor, 0.01 times what the strengths of its edges leave open; at most 0.25."""
    ancestors = closure(edges).where(F.col("descendant") == outcome).select("ancestor").collect()  # nodes of a model
    ways = None
    for a in sorted(r.ancestor for r in ancestors):
        one = paths(edges, a, outcome).select("strength")
        ways = one if ways is None else ways.unionByName(one)
    if ways is None:
        return edges.sparkSession.createDataFrame([(0.01,)], "variance double")
    return ways.agg(F.least(F.lit(0.25), 0.01 + F.sum((1 - F.col("strength")) * 0.01)).alias("variance"))


def on_paths(edges: DataFrame, treatment: str, outcome: str, value: float) -> DataFrame:
    """node_id, value under an intervention of the nodes on the directed ways from treatment to outcome."""
    nodes = paths(edges, treatment, outcome).select(F.explode("path").alias("node_id")).distinct()
    return propagate(edges, {"do": {treatment: value}}).join(nodes, "node_id", "left_semi").select("node_id", "value")


def identify(edges: DataFrame, treatment: str, outcome: str) -> str | None:
    """The formula that gives the effect from what is observed: plain, or adjusted for a set that closes all backdoors."""
    sets = Graph(edges).adjustment_sets(treatment, outcome)
    if not sets:
        return None
    z = ", ".join(sorted(sets[0]))
    return f"sum over {z} of P({outcome} | {treatment}, {z}) P({z})" if z else f"P({outcome} | {treatment})"


def sensitivity(edges: DataFrame, treatment: str, outcome: str, low: float = 0.0, high: float = 0.5) -> DataFrame:
    """strength, effect: what a hidden confounder of some strength would leave of the effect, in steps of a tenth."""
    steps = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i / 10), lambda s: (s >= low) & (s <= high))).alias("strength")
    return effect(edges, treatment, outcome).select(steps, "effect").select("strength", (F.col("effect") * (1 - F.col("strength"))).alias("effect"))


def _would_be(edges: DataFrame, facts: dict[str, float], changes: list[dict[str, float]], query: str) -> DataFrame:
    """number, change, factual, counterfactual, difference of each change."""
    out = None
    for i, c in enumerate(changes):
        one = counterfactual(edges, facts, c, query).select(F.lit(i).alias("number"), F.lit(", ".join(f"{k}={v}" for k, v in sorted(c.items()))).alias("change"), "factual", "counterfactual", "difference")
        out = one if out is None else out.unionByName(one)
    return out


def what_if(edges: DataFrame, facts: dict[str, float], changes: list[dict[str, float]], query: str) -> DataFrame:
    """change, factual, counterfactual, difference, rank: the largest difference first."""
    from pyspark.sql.window import Window

    rows = _would_be(edges, facts, changes, query)  # as many rows as there are changes
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("difference")), "number"))).drop("number")


def probabilities(edges: DataFrame, treatment: str, outcome: str, facts: dict[str, float]) -> DataFrame:
    """necessity, sufficiency and both together of treatment for outcome, and the effect on this individual."""
    c = _would_be(edges, facts, [{treatment: 0.0}, {treatment: 1.0}], outcome)
    off, on = (F.max(F.when(F.col("number") == i, F.col("counterfactual"))) for i in (0, 1))
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    both = effect(edges, treatment, outcome).select(unit(F.col("effect")).alias("both"))
    return c.agg(unit(1 - off).alias("necessity"), unit(on).alias("sufficiency"), (on - off).alias("individual_effect")).crossJoin(both)


def controlled_effect(edges: DataFrame, treatment: str, outcome: str, mediator: str, value: float) -> DataFrame:
    return effect(edges, treatment, outcome, {mediator: value})


def heterogeneity(edges: DataFrame, treatment: str, outcome: str, modifiers: list[str], levels: int = 3) -> DataFrame:
    """modifier, level, effect: the effect with each modifier held at evenly spaced levels from 0 to 1."""
    at = [i / (levels - 1) if levels > 1 else 0.5 for i in range(levels)]
    scenarios = {f"{m}|{x}|{t}": {m: x, treatment: t} for m in modifiers for x in at for t in (0.0, 1.0)}
    v = propagate(edges, scenarios).where(F.col("node_id") == outcome).select(F.split("scenario", "[|]").alias("s"), "value")
    of = v.groupBy(F.col("s")[0].alias("modifier"), F.col("s")[1].cast("double").alias("level"))
    return of.agg((F.max(F.when(F.col("s")[2] == "1.0", F.col("value"))) - F.max(F.when(F.col("s")[2] == "0.0", F.col("value")))).alias("effect"))


def mediators(edges: DataFrame, treatment: str, outcome: str, through: list[str]) -> DataFrame:
    """mediator and its mediation(); share is what it contributes."""
    out = None
    for m in through:
        one = mediation(edges, treatment, outcome, m).select(F.lit(m).alias("mediator"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def drivers(edges: DataFrame, outcome: str, least: float = 0.05) -> DataFrame:
    """node_id, effect of every ancestor whose effect on the outcome is at least so large."""
    nodes = sorted(r.ancestor for r in closure(edges).where(F.col("descendant") == outcome).select("ancestor").collect())
    v = propagate(edges, {f"{n}|{t}": {n: t} for n in nodes for t in (0.0, 1.0)}).where(F.col("node_id") == outcome).select(F.split("scenario", "[|]").alias("s"), "value")
    e = v.groupBy(F.col("s")[0].alias("node_id")).agg((F.max(F.when(F.col("s")[1] == "1.0", F.col("value"))) - F.max(F.when(F.col("s")[1] == "0.0", F.col("value")))).alias("effect"))
    return e.where(F.abs("effect") >= least)

"""Ranking candidates that reach targets through sets: mapping, evidence score, first-come assignment, diversity.

Candidates are rows (candidate_id, kind, relevance) with targets (candidate_id, gene).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def map_to_sets(targets: DataFrame, membership: DataFrame, disrupted: DataFrame) -> DataFrame:
    """candidate_id, pathway_id, overlap, set_size, hit (targets that are disrupted), n_disrupted (of the set)."""
    m = membership.select("pathway_id", "gene").distinct().join(disrupted.select("gene").distinct().withColumn("d", F.lit(1)), "gene", "left")
    size = m.groupBy("pathway_id").agg(F.count(F.lit(1)).alias("set_size"), F.count("d").alias("n_disrupted"))
    got = targets.select("candidate_id", "gene").distinct().join(m, "gene").groupBy("candidate_id", "pathway_id").agg(F.count(F.lit(1)).alias("overlap"), F.count("d").alias("hit"))
    return got.join(size, "pathway_id")


def mapping_score(relevance: Column) -> Column:
    share = F.coalesce(F.try_divide(F.col("hit"), F.col("n_disrupted")), F.lit(0.0))
    return F.least(F.lit(1.0), 0.3 * relevance + 0.3 * F.col("overlap") / F.col("set_size") + 0.2 * share)


def plausibility() -> Column:
    share = F.coalesce(F.try_divide(F.col("hit"), F.col("n_disrupted")), F.lit(0.0))
    return 0.3 + 0.3 * F.least(5 * F.col("overlap") / F.col("set_size"), F.lit(1.0)) + 0.4 * share


#: What a mechanism should do to a set whose name holds the key. Fixed values.
HELPS = {
    "synaptic": ("agonist", "modulator", "enhancer"),
    "chromatin": ("inhibitor", "modulator"),
    "mtor": ("inhibitor",),
    "gaba": ("agonist", "modulator"),
    "glutamate": ("antagonist", "modulator"),
    "serotonin": ("inhibitor", "modulator"),
}
#: Flags that words of a mechanism bring, and those that count as critical. Fixed values.
WORD_FLAGS = (("immunosuppression", ("immunosuppres",)), ("developmental_concerns", ("mtor", "hdac")), ("cns_effects", ("ssri", "serotonin", "dopamine")), ("withdrawal_risk", ("ssri", "serotonin", "dopamine")))
CRITICAL = ("black_box_warning", "contraindicated_pediatric", "teratogenic")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def alignment(mechanism: Column, set_name: Column) -> Column:
    """0.3 for an unknown mechanism; else 0.4, 0.3 for each key of HELPS that fits, 0.1 for a receptor or transporter."""
    m, s = F.lower(F.coalesce(mechanism, F.lit(""))), F.lower(set_name)
    score = F.lit(0.4)
    for key, words in HELPS.items():
        score = score + F.when(s.contains(key) & _any(m, words), 0.3).otherwise(0.0)
    score = score + F.when(_any(m, ("receptor", "transporter")), 0.1).otherwise(0.0)
    return F.when(F.length(m) == 0, 0.3).otherwise(F.least(score, F.lit(1.0)))


def safety_flags(known: Column, mechanism: Column) -> Column:
    """Known flags and those of the mechanism's words, each once, in order."""
    m = F.lower(F.coalesce(mechanism, F.lit("")))
    said = F.array_compact(F.array(*(F.when(_any(m, words), F.lit(flag)) for flag, words in WORD_FLAGS)))
    return F.array_sort(F.array_union(F.coalesce(known, F.array().cast("array<string>")), said))


def critical(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, CRITICAL)))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """df with the value that a table (key, value) of supports has for it, the latest by order of writing; else default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def evidence_confidence(plausible: Column, aligned: Column, literature: Column, clinical: Column, flagged: Column, least: float = 0.1, clinical_boost: float = 0.3, safety_cost: float = 0.1) -> Column:
    """Sum of what strong parts and their agreement (population deviation below 0.2) add, from least to 1."""
    add = lambda test, by: F.when(test, by).otherwise(0.0)
    mean = (plausible + aligned + literature) / 3
    spread = F.sqrt((F.pow(plausible - mean, F.lit(2)) + F.pow(aligned - mean, F.lit(2)) + F.pow(literature - mean, F.lit(2))) / 3)
    total = F.lit(least) + add(plausible > 0.6, 0.15) + add(aligned > 0.6, 0.1) + add(literature > 0.5, 0.15) + add(clinical > 0.3, clinical_boost) + add(spread < 0.2, 0.1) - add(flagged, safety_cost)
    return F.greatest(F.lit(least), F.least(total, F.lit(1.0)))


def hypothesis_score(evidence_: Column, z: Column, relevance: Column, mapping: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 * evidence_ + 0.3 * F.least(z / 4, F.lit(1.0)) + 0.2 * relevance + 0.1 * mapping)


def hypothesis_confidence(confidence: Column, z: Column, rule: Column, is_critical: Column) -> Column:
    total = confidence + F.when(z > 2.5, 0.1).otherwise(0.0) + F.when(rule > 0.7, 0.1).otherwise(0.0) - F.when(is_critical, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(total, F.lit(1.0)))


def allowed(candidates: DataFrame, least: float = 0.0, without: tuple[str, ...] = ("withdrawn",)) -> DataFrame:
    """Candidates of enough relevance whose status is not switched off; an unknown status passes."""
    return candidates.where((F.col("relevance") >= least) & ~F.coalesce(F.col("status").isin(list(without)), F.lit(False)))


def search(candidates: DataFrame, name: str | None = None, mechanism: str | None = None, status: str | None = None, least: float = 0.0) -> DataFrame:
    """Candidates whose name holds a text, whatever the case, of a mechanism, a status and at least some relevance."""
    rows = candidates.where(F.col("relevance") >= least)
    if name is not None:
        rows = rows.where(F.lower("name").contains(name.lower()))
    for column, value in (("mechanism", mechanism), ("status", status)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def shares_word(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(a), r"\s+"), F.split(F.lower(b), r"\s+")), F.lit(False))


def evidence(parts: dict[str, Column], weights: dict[str, float], flags: Column, per_flag: float = 0.05, most: float = 0.3) -> Column:
    total = F.lit(0.0)
    for k, c in parts.items():
        total = total + weights[k] * c
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total - F.least(per_flag * flags, F.lit(most))))


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.5, "moderate").when(score >= 0.3, "low").otherwise("very_low")


def first_set(scored: DataFrame) -> DataFrame:
    """Each candidate with the first of its sets only, in the order of the sets' scores."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc("set_score"), "pathway_id")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def diverse(ranked: DataFrame, per_set: int = 5, per_kind: int = 3) -> DataFrame:
    """Greedy choice by score with at most so many per set and per kind.

    A row can only be chosen if it is among the first per_kind of its set and kind, so everything else is dropped
    by a window before the sequential step, which then sees at most sets x kinds x per_kind rows.
    """
    w = Window.partitionBy("pathway_id", "kind").orderBy(F.desc("score"), "candidate_id")
    few = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_kind).drop("_r").select("candidate_id", "pathway_id", "kind", "score")

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for f in frames:
            keep = []
            for r in f.itertuples():
                ok = sets.get(r.pathway_id, 0) < per_set and kinds.get(r.kind, 0) < per_kind
                if ok:
                    sets[r.pathway_id] = sets.get(r.pathway_id, 0) + 1
                    kinds[r.kind] = kinds.get(r.kind, 0) + 1
                keep.append(ok)
            yield f[keep]

    one = few.repartition(1).sortWithinPartitions(F.desc("score"), "candidate_id")
    return one.mapInPandas(greedy, few.schema)

"""Filling missing values from similar records by hierarchical group statistics.

Every level names the columns of a group. A missing numeric value takes the median, a missing categorical
value the mode, of the finest level whose group has at least ``min_support`` valid values; what is filled,
from which level and on how many values is stored beside the value.

Scale: records with nothing missing pass through without a join. Statistics are partial aggregates over value
counts, so a group that holds a third of all rows costs one row per distinct value and map task; the values of
a numeric field lie on a grid (``step``), so the counts of a group are bounded by (high - low) / step.

Defined results:
* null, NaN and out-of-range numbers are missing; null, blank and ``null_words`` categories are missing;
* a null in any key column of a level means that the record has no group on that level;
* identical rows are one record; rows that share an id but differ stay separate records;
* even counts: the median is the mean of the two middle values; ties between modes: the smallest value;
* an empty table gives an empty result; columns of the input pass through unchanged, and an added column whose
  name the input already has raises ValueError before any job runs;
* a value that no level can fill stays null with level null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lociflow.session import cut


@dataclass(frozen=True)
class Numeric:
    name: str
    low: float
    high: float
    step: float = 0.001

    def valid(self) -> Column:
        v = F.col(f"`{self.name}`").cast("double")
        return F.when(~F.isnan(v) & v.between(self.low, self.high), v)

    def grid(self) -> Column:
        """The valid value in whole steps."""
        return F.round(self.valid() / F.lit(self.step)).cast("long")


@dataclass(frozen=True)
class Categorical:
    name: str
    null_words: tuple[str, ...] = ()

    def valid(self) -> Column:
        v = F.trim(F.col(f"`{self.name}`").cast("string"))
        gone = (F.length(v) == 0) | F.lower(v).isin([w.lower() for w in self.null_words])
        return F.when(~gone, v)

    grid = valid


@dataclass(frozen=True)
class Level:
    """name: what is stored; keys: name -> column, or expression, of the group; min_support: valid values needed;
    near: a timestamp column and a number of days: only records of the group at most so far from the record itself."""

    name: str
    keys: dict[str, Column | str] = field(default_factory=dict)
    min_support: int = 1
    near: tuple[str, int] | None = None

    def exprs(self) -> list[Column]:
        at = [micros(self.near[0])] if self.near else []
        return [F.col(c) if isinstance(c, str) else c for c in self.keys.values()] + at


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def time_bucket(column: str, days: int) -> Column:
    """Number of the span of so many days in which a timestamp lies: records of one span are close in time."""
    return F.floor(F.unix_timestamp(F.col(column).cast("timestamp")) / F.lit(86400 * days))


def _stats(rows: DataFrame, level: Level, fields: list[Numeric | Categorical], tag: str) -> DataFrame:
    """One row per group of the level with the statistic and support of every field."""
    keys = [f"_imp_k{i}" for i in range(len(level.keys))]
    rows = rows.select(*(c.alias(k) for k, c in zip(keys, level.exprs())), *(w.grid().alias(f"v{i}") for i, w in enumerate(fields))).dropna(subset=keys or None, how="any" if keys else "all")
    return rows.groupBy(*keys).agg(*_aggs(level, fields, tag))


def _aggs(level: Level, fields: list[Numeric | Categorical], tag: str) -> list[Column]:
    aggs = []
    for i, w in enumerate(fields):
        stat = F.percentile(F.col(f"v{i}"), F.lit(0.5)) * F.lit(w.step) if isinstance(w, Numeric) else F.mode(f"v{i}", True)
        enough = F.count(f"v{i}") >= max(1, level.min_support)
        aggs.append(F.when(enough, F.struct(stat.alias("value"), F.lit(level.name).alias("level"), F.count(f"v{i}").alias("n"))).alias(f"{tag}_{i}"))
    return aggs


def _near_stats(rows: DataFrame, gaps: DataFrame, level: Level, fields: list[Numeric | Categorical], tag: str) -> DataFrame:
    """As _stats, one row per group and time of a gap, over the group's records at most level.near[1] days away.

    A gap meets its own and the two neighbouring spans of its group, which hold all that is near.
    """
    keys = [f"_imp_k{i}" for i in range(len(level.keys))]
    at, span = f"_imp_k{len(keys)}", 86_400_000_000 * level.near[1]
    named = [c.alias(k) for k, c in zip([*keys, at], level.exprs())]
    asked = gaps.select(*named).dropna().distinct().withColumn("b", F.explode(F.array(*(F.floor(F.col(at) / span) + i for i in (-1, 0, 1)))))
    have = rows.select(*named, *(w.grid().alias(f"v{i}") for i, w in enumerate(fields))).dropna(subset=[*keys, at]).dropna(how="all", subset=[f"v{i}" for i in range(len(fields))])
    have = have.withColumn("b", F.floor(F.col(at) / span)).withColumnRenamed(at, "u")
    near = asked.join(have, [*keys, "b"]).where(F.abs(F.col(at) - F.col("u")) <= span)
    return near.groupBy(*keys, at).agg(*_aggs(level, fields, tag))


def distinct_rows(df: DataFrame) -> DataFrame:
    """df.distinct() that also takes map columns, compared by their sorted entries."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, MapType)]
    if not maps:
        return df.distinct()
    keyed = df.withColumns({f"_imp_m{i}": F.array_sort(F.map_entries(F.col(f"`{c}`"))) for i, c in enumerate(maps)})
    plain = [c for c in keyed.columns if c not in maps]
    return keyed.dropDuplicates(plain).drop(*(f"_imp_m{i}" for i in range(len(maps))))


def fill_missing(df: DataFrame, fields: list[Numeric | Categorical], levels: list[Level]) -> DataFrame:
    """df's distinct rows with, for each field f: f_filled, f_was_missing, f_fill_level, f_fill_support.

    All fields of a level share one aggregation and one join.
    """
    added = [f"{w.name}_{s}" for w in fields for s in ("filled", "was_missing", "fill_level", "fill_support")]
    clash = set(added) & set(df.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    rows = cut(distinct_rows(df))  # every level reads it
    missing = F.lit(False)
    for w in fields:
        missing = missing | w.valid().isNull()

    def filled(of: DataFrame, best: list[Column | None]) -> DataFrame:
        out = {}
        for w, b in zip(fields, best):
            gone = w.valid().isNull()
            pick = lambda part, kind, b=b: F.lit(None).cast(kind) if b is None else b[part].cast(kind)
            kind = "double" if isinstance(w, Numeric) else "string"
            out |= {
                f"{w.name}_filled": F.coalesce(w.valid(), pick("value", kind)), f"{w.name}_was_missing": gone,
                f"{w.name}_fill_level": F.when(gone, pick("level", "string")), f"{w.name}_fill_support": F.when(gone, pick("n", "long")),
            }
        return of.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(n) for n, c in out.items()))

    gaps = rows.where(missing)
    for j, level in enumerate(levels):
        stats = _near_stats(rows, rows.where(missing), level, fields, f"_imp_s{j}") if level.near else _stats(rows, level, fields, f"_imp_s{j}")
        if n := len(level.exprs()):
            gaps = gaps.withColumns({f"_imp_g{k}": c for k, c in enumerate(level.exprs())})
            on = [F.col(f"_imp_g{k}") == F.col(f"_imp_k{k}") for k in range(n)]
            gaps = gaps.join(stats, on, "left").drop(*(f"_imp_{x}{k}" for x in "gk" for k in range(n)))
        else:  # one row, whatever the input
            gaps = gaps.join(F.broadcast(stats), F.lit(True), "left")
    best = [F.coalesce(*(F.col(f"_imp_s{j}_{i}") for j in range(len(levels)))) for i in range(len(fields))]
    return filled(rows.where(~missing), [None] * len(fields)).unionByName(filled(gaps, best))

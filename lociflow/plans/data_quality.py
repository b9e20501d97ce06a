"""Queries of problems 3 (missing values) and 4 (lines that do not parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.impute import Categorical, Level, Numeric, fill_missing, time_bucket
from lociflow.plans.base import Registry
from lociflow.session import table
from lociflow.sources.reject_csv import constraint_rows, parse_lines, rejects, variant_rows

R = Registry()
NEAR, OWN = "near_in_time", "same_group"

PHENOTYPE_FIELDS = [Numeric("iq_score", 30, 170, 1), Numeric("age_at_diagnosis", 0, 60, 0.1), Categorical("sex", ("unknown", "na", "n/a", "none"))]
CONSTRAINT_FIELDS = [Numeric("loeuf", 0, 3, 0.001)]


def _levels(own: str, when: str, coarse: list[str], days: int, spans: bool = False) -> list[Level]:
    """Same group within so many days (spans: in the same span of the calendar), same group, then ever shorter lists of the coarse columns, then all rows."""
    tail = [Level("+".join(coarse[: len(coarse) - i]), {c: F.col(c) for c in coarse[: len(coarse) - i]}, 5) for i in range(len(coarse))]
    finest = Level(NEAR, {own: F.col(own), "span": time_bucket(when, days)}) if spans else Level(NEAR, {own: F.col(own)}, near=(when, days))
    return [finest, Level(OWN, {own: F.col(own)}), *tail, Level("all", {}, 5)]


def filled_phenotypes(spark: SparkSession, sf: str, spans: bool = False) -> DataFrame:
    return fill_missing(table(spark, sf, "phenotypes"), PHENOTYPE_FIELDS, _levels("sample_id", "visit_date", ["diagnosis", "cohort"], 180, spans))


def filled_constraints(spark: SparkSession, sf: str, spans: bool = False) -> DataFrame:
    return fill_missing(table(spark, sf, "gene_constraints"), CONSTRAINT_FIELDS, _levels("transcript", "released_at", ["gene"], 180, spans))


def _from_own_group(df: DataFrame, name: str, key: str, fields: list[str]) -> DataFrame:
    flags = F.array(*(F.when(F.col(f"{f}_fill_level").isin(NEAR, OWN), F.lit(f)) for f in fields))
    return df.select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.explode(F.array_compact(flags)).alias("field_name"))


_FOUND_SQL = """
WITH p AS (
    SELECT DISTINCT visit_id, sample_id, visit_date, CASE WHEN iq_score BETWEEN 30 AND 170 THEN iq_score END AS iq,
           CASE WHEN NOT isnan(age_at_diagnosis) AND age_at_diagnosis BETWEEN 0 AND 60 THEN age_at_diagnosis END AS age FROM phenotypes
), g AS (
    SELECT DISTINCT row_id, transcript, CASE WHEN NOT isnan(loeuf) AND loeuf BETWEEN 0 AND 3 THEN loeuf END AS v FROM gene_constraints
)
SELECT DISTINCT 'phenotypes' AS table_name, visit_id AS record_id, 'iq_score' AS field_name FROM p
WHERE iq IS NULL AND sample_id IN (SELECT sample_id FROM p WHERE iq IS NOT NULL AND sample_id IS NOT NULL)
UNION ALL
SELECT DISTINCT 'phenotypes', visit_id, 'age_at_diagnosis' FROM p
WHERE age IS NULL AND sample_id IN (SELECT sample_id FROM p WHERE age IS NOT NULL AND sample_id IS NOT NULL)
UNION ALL
SELECT DISTINCT 'gene_constraints', row_id, 'loeuf' FROM g
WHERE v IS NULL AND transcript IN (SELECT transcript FROM g WHERE v IS NOT NULL AND transcript IS NOT NULL)
"""


@R.add("p3_found", _FOUND_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    people = _from_own_group(filled_phenotypes(spark, sf), "phenotypes", "visit_id", ["iq_score", "age_at_diagnosis"])
    genes = _from_own_group(filled_constraints(spark, sf), "gene_constraints", "row_id", ["loeuf"])
    return people.unionByName(genes).distinct()


def _fill_sql(table_name: str, key: str, field: str, low: float, high: float, step: float, own: str, when: str, coarse: list[str], spans: bool = True) -> str:
    """The hierarchy of one numeric field, each level as a grouped median; without spans the finest by distance in time."""
    chains = [(NEAR, [own, "span"], 1), (OWN, [own], 1), *(("+".join(c), c, 5) for c in (coarse[: len(coarse) - i] for i in range(len(coarse))))]
    ctes, joins, values, names, ns = [], [], [], [], []
    for i, (name, keys, least) in enumerate(chains):
        on = " AND ".join(f"t.{k} = l{i}.{k}" for k in keys)
        ctes.append(f"l{i} AS (SELECT {', '.join(keys)}, median(v) AS m, count(v) AS n FROM t WHERE v IS NOT NULL GROUP BY {', '.join(keys)} HAVING count(v) >= {least})")
        joins.append(f"LEFT JOIN l{i} ON {on}")
        values.append(f"l{i}.m")
        names.append(f"CASE WHEN l{i}.m IS NOT NULL THEN '{name}' END")
        ns.append(f"l{i}.n")
    if not spans:
        ctes[0] = f"l0 AS (SELECT a.{own}, a.at, median(t.v) AS m, count(t.v) AS n FROM (SELECT DISTINCT {own}, epoch_us({when}) AS at FROM t WHERE v IS NULL) a JOIN t ON t.{own} = a.{own} AND t.v IS NOT NULL AND abs(epoch_us(t.{when}) - a.at) <= {86_400_000_000 * 180} GROUP BY 1, 2)"
        joins[0] = f"LEFT JOIN l0 ON t.{own} = l0.{own} AND epoch_us(t.{when}) = l0.at"
    ctes.append("la AS (SELECT median(v) AS m, count(v) AS n FROM t WHERE v IS NOT NULL HAVING count(v) >= 5)")
    return f"""
WITH t AS (SELECT *, floor(epoch({when}) / {86400 * 180}) AS span,
                  CASE WHEN NOT isnan({field}::DOUBLE) AND {field} BETWEEN {low} AND {high} THEN {field}::DOUBLE END AS v
           FROM (SELECT DISTINCT * FROM {table_name})), {", ".join(ctes)}
SELECT t.{key}, round(coalesce(t.v, {", ".join(values)}, la.m), 6) AS filled, t.v IS NULL AS was_missing,
       CASE WHEN t.v IS NULL THEN coalesce({", ".join(names)}, CASE WHEN la.m IS NOT NULL THEN 'all' END) END AS fill_level,
       CASE WHEN t.v IS NULL THEN coalesce({", ".join(ns)}, la.n) END AS fill_support
FROM t {" ".join(joins)} LEFT JOIN la ON true
"""


def _one_field(df: DataFrame, key: str, f: str) -> DataFrame:
    return df.select(key, F.round(f"{f}_filled", 6).alias("filled"), F.col(f"{f}_was_missing").alias("was_missing"), F.col(f"{f}_fill_level").alias("fill_level"), F.col(f"{f}_fill_support").alias("fill_support"))


@R.add("p3_filled_iq", _fill_sql("phenotypes", "visit_id", "iq_score", 30, 170, 1, "sample_id", "visit_date", ["diagnosis", "cohort"]))
def p3_filled_iq(spark: SparkSession, sf: str) -> DataFrame:
    return _one_field(filled_phenotypes(spark, sf, spans=True), "visit_id", "iq_score")


@R.add("p3_filled_age", _fill_sql("phenotypes", "visit_id", "age_at_diagnosis", 0, 60, 0.1, "sample_id", "visit_date", ["diagnosis", "cohort"]))
def p3_filled_age(spark: SparkSession, sf: str) -> DataFrame:
    return _one_field(filled_phenotypes(spark, sf, spans=True), "visit_id", "age_at_diagnosis")


@R.add("p3_filled_loeuf", _fill_sql("gene_constraints", "row_id", "loeuf", 0, 3, 0.001, "transcript", "released_at", ["gene"]))
def p3_filled_loeuf(spark: SparkSession, sf: str) -> DataFrame:
    return _one_field(filled_constraints(spark, sf, spans=True), "row_id", "loeuf")


def _near(name: str, filled, key: str, field: str, *rest) -> None:
    """The same with the finest level by distance in time, as p3_found has it; the SQL of p3_filled_* is by calendar spans."""

    @R.add(f"p3_near_{name}", _fill_sql("phenotypes" if key == "visit_id" else "gene_constraints", key, field, *rest, spans=False))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _one_field(filled(spark, sf), key, field)


_near("iq", filled_phenotypes, "visit_id", "iq_score", 30, 170, 1, "sample_id", "visit_date", ["diagnosis", "cohort"])
_near("age", filled_phenotypes, "visit_id", "age_at_diagnosis", 0, 60, 0.1, "sample_id", "visit_date", ["diagnosis", "cohort"])
_near("loeuf", filled_constraints, "row_id", "loeuf", 0, 3, 0.001, "transcript", "released_at", ["gene"])


@R.add("p3_filled_sex")
def p3_filled_sex(spark: SparkSession, sf: str) -> DataFrame:
    df = filled_phenotypes(spark, sf)
    return df.select("visit_id", F.col("sex_filled").alias("filled"), F.col("sex_was_missing").alias("was_missing"), F.col("sex_fill_level").alias("fill_level"))


_NUM = r"[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_SPLIT_SQL = r"""
WITH l AS (
    SELECT record_id, feed, regexp_replace(coalesce(line, ''), '\r$', '') AS s FROM raw_records
), q AS (
    SELECT *, regexp_full_match(s, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS whole FROM l
), f AS (
    SELECT *, CASE WHEN whole THEN list_transform(regexp_extract_all(chr(9) || s, '\t("([^"]|"")*"|[^"\t]*)', 1),
        lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS v FROM q
)
"""
_REASON_SQL = (
    _SPLIT_SQL
    + f"""
SELECT record_id, 'quoting' AS reason FROM f WHERE NOT whole
UNION ALL SELECT record_id, 'column_count' FROM f WHERE whole AND len(v) <> CASE feed WHEN 'variant' THEN 10 ELSE 7 END
UNION ALL SELECT record_id, 'pos' FROM f WHERE feed = 'variant' AND whole AND len(v) = 10
    AND NOT (regexp_full_match(trim(v[2], ' '), '[0-9]{{1,9}}') AND coalesce(try_cast(trim(v[2], ' ') AS BIGINT) >= 1, false))
UNION ALL SELECT record_id, 'quality' FROM f WHERE feed = 'variant' AND whole AND len(v) = 10
    AND NOT (trim(v[6], ' ') = '.' OR (regexp_full_match(trim(v[6], ' '), '{_NUM}') AND coalesce(isfinite(try_cast(trim(v[6], ' ') AS DOUBLE)), false)))
UNION ALL SELECT record_id, 'pli' FROM f WHERE feed = 'constraint' AND whole AND len(v) = 7
    AND NOT (trim(v[3], ' ') IN ('', 'NA', '.') OR (regexp_full_match(trim(v[3], ' '), '{_NUM}') AND coalesce(try_cast(trim(v[3], ' ') AS DOUBLE) BETWEEN 0 AND 1, false)))
"""
)


@R.add("p4_found", _REASON_SQL)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(parse_lines(table(spark, sf, "raw_records"))).distinct()


@R.add(
    "p4_variants",
    _SPLIT_SQL
    + f"""
SELECT record_id, v[1] AS chrom, v[3] AS variant_id, v[4] AS ref, v[5] AS alt, v[7] AS filter_status, v[8] AS info, v[9] AS format, v[10] AS sample,
       try_cast(trim(v[2], ' ') AS BIGINT) AS pos, CASE WHEN trim(v[6], ' ') <> '.' THEN try_cast(trim(v[6], ' ') AS DOUBLE) END AS quality
FROM f WHERE feed = 'variant' AND record_id NOT IN (SELECT record_id FROM ({_REASON_SQL}))
""",
)
def p4_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variant_rows(parse_lines(table(spark, sf, "raw_records")))


@R.add(
    "p4_constraints",
    _SPLIT_SQL
    + f"""
SELECT record_id, v[1] AS gene, v[2] AS transcript, try_cast(trim(v[3], ' ') AS DOUBLE) AS pli, try_cast(trim(v[4], ' ') AS DOUBLE) AS loeuf,
       try_cast(trim(v[5], ' ') AS DOUBLE) AS mis_z, try_cast(trim(v[6], ' ') AS DOUBLE) AS syn_z, v[7] AS note
FROM f WHERE feed = 'constraint' AND record_id NOT IN (SELECT record_id FROM ({_REASON_SQL}))
""",
)
def p4_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return constraint_rows(parse_lines(table(spark, sf, "raw_records")))

"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm.mapping import brute_force_sql, gene_keys, match_values
from lociflow.plans.base import Registry
from lociflow.session import table

R = Registry()


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        """SELECT DISTINCT 'gene_constraints' AS table_name, row_id AS record_id, gene AS value FROM {a} WHERE gene IS NOT NULL
           UNION ALL SELECT DISTINCT 'disease_genes', entry_id, gene_symbol FROM {b} WHERE gene_symbol IS NOT NULL""",
        a=table(spark, sf, "gene_constraints"), b=table(spark, sf, "disease_genes"),
    )


def _matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    genes, typed = table(spark, sf, "gene_info"), _typed(spark, sf)
    odd = spark.sql("SELECT t.* FROM {t} t LEFT ANTI JOIN {g} g ON t.value = g.symbol", t=typed, g=genes)
    return typed, odd, match_values(spark, spark.sql("SELECT value FROM {o}", o=odd), gene_keys(spark, genes))


_SQL = f"""
WITH typed AS (
    SELECT DISTINCT 'gene_constraints' AS table_name, row_id AS record_id, gene AS value FROM gene_constraints WHERE gene IS NOT NULL
    UNION ALL SELECT DISTINCT 'disease_genes', entry_id, gene_symbol FROM disease_genes WHERE gene_symbol IS NOT NULL
), odd AS (
    SELECT * FROM typed WHERE value NOT IN (SELECT symbol FROM gene_info) AND trim(regexp_replace(value, '[\\s\u00a0]', '', 'g'), ' ') <> ''
), keys AS (
    SELECT symbol AS key, symbol AS entry, true AS fuzzy FROM gene_info UNION ALL SELECT unnest(aliases), symbol, true FROM gene_info
    UNION ALL SELECT ensembl_id, symbol, false FROM gene_info UNION ALL SELECT entrez_id, symbol, false FROM gene_info UNION ALL SELECT name, symbol, false FROM gene_info
), found AS ({brute_force_sql("odd", "keys")})
"""


@R.add("p5_found", _SQL + "SELECT DISTINCT table_name, record_id, entry AS symbol FROM odd JOIN found USING (value)")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    _, odd, m = _matches(spark, sf)
    return spark.sql("SELECT DISTINCT o.table_name, o.record_id, m.entry AS symbol FROM {o} o JOIN {m} m ON o.value = m.value", o=odd, m=m)


@R.add("p5_unmatched", _SQL + "SELECT value, count(DISTINCT (table_name, record_id)) AS n_records FROM odd JOIN found USING (value) WHERE entry = 'UNMATCHED' GROUP BY 1")
def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that name no listed gene, with the number of their records."""
    _, odd, m = _matches(spark, sf)
    return spark.sql("SELECT o.value, count(DISTINCT o.table_name, o.record_id) AS n_records FROM {o} o JOIN {m} m ON o.value = m.value WHERE m.distance IS NULL GROUP BY o.value", o=odd, m=m)

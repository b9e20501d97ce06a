"""Questions to expression tables in long form (gene, stage, region, value) or (gene, cell_type, value); nulls and NaN are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.operators.reference import broad_type, specific

def valid(value: str = "value") -> Column:
    return F.when(~F.isnan(value), F.col(value))


def part(long: DataFrame, **wanted: str) -> DataFrame:
    """The rows of a gene, stage, region or cell type."""
    for column, value in wanted.items():
        long = long.where(F.col(column) == value)
    return long


def stage_mean(long: DataFrame) -> DataFrame:
    return long.groupBy("gene", "stage").agg(F.avg(valid()).alias("mean"))


def gene_mean(long: DataFrame) -> DataFrame:
    return long.groupBy("gene").agg(F.avg(valid()).alias("mean"))


def region_mean(long: DataFrame, regions: list[str]) -> DataFrame:
    """Mean over some regions by gene and stage; null where any of the values is missing."""
    rows = long.where(F.col("region").isin(regions)).groupBy("gene", "stage")
    return rows.agg(F.when(F.count(valid()) == F.count(F.lit(1)), F.avg(valid())).alias("mean"))


def expressed(long: DataFrame, stages: list[str], least: float = 1.0) -> DataFrame:
    """gene: the largest value over some stages is at least so much."""
    return long.where(F.col("stage").isin(stages)).groupBy("gene").agg(F.max(valid()).alias("most")).where(F.col("most") >= least).select("gene")


def flags(genes: DataFrame, hit: DataFrame, name: str) -> DataFrame:
    """genes with a column that tells whether hit has the gene; unknown ones have not."""
    return genes.join(hit.select("gene", F.lit(True).alias(name)), "gene", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def peak(long: DataFrame) -> DataFrame:
    """gene, region, stage and value of the largest value; of equal ones the first stage."""
    rows = long.where(valid().isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("gene", "region").orderBy(F.desc("value"), "stage"))).where("_r = 1")
    return rows.select("gene", "region", "stage", "value")


def profile(cells: DataFrame) -> DataFrame:
    """gene and its mean value by cell type as a map; cell types are a bounded list."""
    by = cells.groupBy("gene", "cell_type").agg(F.avg(valid()).alias("value"))
    return by.groupBy("gene").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_type", "value")))).alias("values"))


def markers(cells: DataFrame, n: int = 50, fold: float = 1.5) -> DataFrame:
    """cell_type, gene, fold of the n genes most specific to each cell type."""
    s = specific(cells, "cell_type", fold).withColumn("fold", F.round("fold", 9))
    w = Window.partitionBy("cell_type").orderBy(F.desc("fold"), "gene")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cell_type", "gene", "fold", "rank")


def enriched_in(cells: DataFrame, kinds: list[str], fold: float = 2.0) -> DataFrame:
    """Genes specific to any cell type of some broad types."""
    return specific(cells, "cell_type", fold).where(broad_type("cell_type").isin(kinds)).select("gene").distinct()

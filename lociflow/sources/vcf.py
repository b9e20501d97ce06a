"""Variant call files: text lines to long variant rows, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_header(spark: SparkSession, path: str) -> dict:
    """File format, contigs, INFO, FORMAT and FILTER definitions and the samples, from the header lines alone, however many."""
    value = F.col("value")
    text = spark.read.text(path)
    names = text.where(value.startswith("#CHROM")).select(F.split("value", "\t").alias("f")).first()
    kinds = ("contig", "INFO", "FORMAT", "FILTER")
    wanted = value.startswith("##fileformat=")
    for k in kinds:
        wanted = wanted | value.startswith(f"##{k}=<")
    lines = [r.value for r in text.where(wanted).toLocalIterator()]  # definitions, not data
    fields = {k: [dict(re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,>]*)', x.split("=<", 1)[1])) for x in lines if x.startswith(f"##{k}=<")] for k in kinds}
    defined = {k: [{n: v.strip('"') for n, v in d.items()} for d in of if "ID" in d] for k, of in fields.items()}
    version = next((x.split("=", 1)[1] for x in lines if x.startswith("##fileformat=")), None)
    ids = {k: [d["ID"] for d in of] for k, of in defined.items()}
    return {"fileformat": version, "contigs": ids["contig"], "info": ids["INFO"], "format": ids["FORMAT"], "filters": ids["FILTER"], "definitions": defined, "samples": names.f[9:] if names else []}


def info_map(text: Column) -> Column:
    """k=v;flag to a map; a flag has the value true, '.' is empty."""
    parts = F.filter(F.split(text, ";"), lambda p: (p != "") & (p != "."))
    pairs = F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("true")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))  # the last of a repeated key
    return F.map_from_entries(last)


def parse_lines(lines: DataFrame, samples: list[str], min_quality: float = 0.0, pass_only: bool = False) -> DataFrame:
    """One row per sample and allele that is not the reference; missing calls and short lines give none.

    Without sample columns every alternative allele is one row of the sample UNKNOWN. A comma list in AF is
    indexed by the allele.
    """
    f = F.split(F.col("value"), "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 8)
    quality = F.coalesce(F.when(F.col("f")[5] != ".", F.col("f")[5].try_cast("double")), F.lit(0.0))
    rows = rows.select(
        "f", F.col("f")[0].alias("chrom"), F.col("f")[1].try_cast("long").alias("pos"), F.nullif(F.col("f")[2], F.lit(".")).alias("variant_id"), F.col("f")[3].alias("ref"),
        F.split(F.col("f")[4], ",").alias("alts"), quality.alias("quality"), F.col("f")[6].alias("filter_status"), info_map(F.col("f")[7]).alias("info"),
    ).where((F.col("quality") >= min_quality) & F.col("pos").isNotNull())
    if pass_only:
        rows = rows.where("filter_status = 'PASS'")
    if samples:
        names = F.array(*(F.lit(s) for s in samples))
        calls = F.arrays_zip(names.alias("sample_id"), F.slice("f", 10, len(samples)).alias("call"))
        rows = rows.select("*", F.inline(calls)).withColumn("genotype", F.split("call", ":")[0])
        rows = rows.where("genotype IS NOT NULL").withColumn("allele", F.explode(F.split("genotype", "[/|]"))).withColumn("allele", F.col("allele").try_cast("int"))
    else:
        rows = rows.withColumns({"sample_id": F.lit("UNKNOWN"), "genotype": F.lit(None).cast("string"), "allele": F.explode(F.sequence(F.lit(1), F.size("alts")))})
    rows = rows.where((F.col("allele") > 0) & (F.col("allele") <= F.size("alts"))).withColumn("alt", F.element_at("alts", F.col("allele")))
    per_allele = F.transform_values("info", lambda k, v: F.when(k == "AF", F.coalesce(F.get(F.split(v, ","), F.col("allele") - 1), v)).otherwise(v))
    return rows.select("chrom", "pos", "variant_id", "ref", "alt", "sample_id", "genotype", "quality", "filter_status", per_allele.alias("info"))


def read(spark: SparkSession, path: str, min_quality: float = 0.0, pass_only: bool = False) -> DataFrame:
    """Long variant rows of a plain or gzip file; many files of one header may be read by a pattern."""
    return parse_lines(spark.read.text(path), read_header(spark, path)["samples"], min_quality, pass_only)


def to_lines(variants: DataFrame, samples: list[str]) -> DataFrame:
    """One line per site, with a call for each of the samples ('.' where it has none). samples: a bounded list."""
    info = F.concat_ws(";", F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    site = variants.select("chrom", "pos", "ref", "alt", "sample_id", "genotype", F.coalesce("variant_id", F.lit(".")).alias("id"), F.coalesce(F.col("quality").cast("string"), F.lit(".")).alias("q"), F.coalesce("filter_status", F.lit(".")).alias("fl"), F.when(F.size("info") > 0, info).otherwise(".").alias("i"))
    one = site.groupBy("chrom", "pos", "ref", "alt").agg(F.min("id").alias("id"), F.min("q").alias("q"), F.min("fl").alias("fl"), F.min("i").alias("i"), *(F.coalesce(F.max(F.when(F.col("sample_id") == s, F.coalesce("genotype", F.lit("0/1")))), F.lit("./.")).alias(f"g{k}") for k, s in enumerate(samples)))
    cols = ["chrom", F.col("pos").cast("string"), "id", "ref", "alt", "q", "fl", "i", *([F.lit("GT")] + [F.col(f"g{k}") for k in range(len(samples))] if samples else [])]
    return one.select(F.concat_ws("\t", *cols).alias("value"))

"""Runs held against each other: hashes of files, metrics within tolerances, tables compared cell by cell, provenance."""

from __future__ import annotations

import hashlib
import json
import os
import random
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_hash(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def check_hashes(expected: dict[str, str]) -> dict[str, bool]:
    """Whether each file exists and has the hash."""
    return {p: os.path.exists(p) and file_hash(p) == h for p, h in expected.items()}


def check_metrics(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """metric, value, expected, tolerance, passed; metrics (metric, value), expected (metric, expected, tolerance). What is
    not there has not passed."""
    j = expected.join(metrics, "metric", "left")
    return j.select("metric", "value", "expected", "tolerance", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False)).alias("passed"))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """rows, only_a, only_b, differ, largest: how the values of two runs by keys differ; equal nulls and NaN agree."""
    x = a.select(*keys, F.col(value).cast("double").alias("x"), F.lit(True).alias("in_a"))
    y = b.select(*keys, F.col(value).cast("double").alias("y"), F.lit(True).alias("in_b"))
    j = x.join(y, keys, "full_outer")
    both = F.col("in_a") & F.col("in_b")
    gap = F.abs(F.col("x") - F.col("y"))
    same = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(gap <= tolerance, F.lit(False))
    return j.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(both & ~same).alias("differ"), F.coalesce(F.max(F.when(both & ~F.isnan(gap), gap)), F.lit(0.0)).alias("largest"),
    )


def seeded(seed: int):
    """Generators of Python and numpy from one seed."""
    import numpy as np

    random.seed(seed)
    return random.Random(seed), np.random.default_rng(seed)


@dataclass
class Provenance:
    """What a result was made with; two agree if what has to be equal is."""

    reference: str
    annotation: str
    sets: str
    version: str
    versions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def current(cls, reference: str, annotation: str, sets: str) -> Provenance:
        import numpy
        import pyspark

        import lociflow

        return cls(reference, annotation, sets, lociflow.__version__, {"pyspark": pyspark.__version__, "numpy": numpy.__version__})

    def conflicts(self, other: Provenance) -> list[str]:
        """Names of what must agree and does not."""
        return [k for k in ("reference", "annotation", "sets") if getattr(self, k) != getattr(other, k)]

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2, sort_keys=True)

    @classmethod
    def load(cls, path: str) -> Provenance:
        with open(path) as f:
            return cls(**json.load(f))

"""A bounded sample of rows, the same for the same rows, of which no partition sends more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, id_col: str, rows: int, total: int) -> DataFrame:
    """At most so many of df's total rows, the first by the hash of the id.

    A threshold on the hash first cuts the rows down to a few more than wanted, so that the final limit sorts and
    sends about as many rows as it keeps, whatever the number of partitions.
    """
    span = 1 << 30
    share = min(1.0, (rows + 6 * rows**0.5 + 10) / max(total, 1))
    near = df.where(F.pmod(F.xxhash64(id_col), F.lit(span)) < int(share * span)) if share < 1 else df
    return near.orderBy(F.pmod(F.xxhash64(id_col), F.lit(span)), id_col).limit(rows)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores, for work that costs more than reading: one small
    file would otherwise be one task. Scans with enough partitions are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def together(df: DataFrame, key: str, *order: str) -> DataFrame:
    """All rows of a key in one partition, next to each other and in order, for work on whole groups of rows.

    Partitioned by a hash of the key: an exchange by the key itself is left out where a join before has the same
    partitioning, and an adaptive plan that then turns that join into a broadcast scatters the groups.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)

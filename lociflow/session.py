"""Session, table loading and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings variants phenotypes "
    "gene_constraints disease_genes gene_info node_features subtype_profiles cluster_assignments raw_records "
    "eval_items context_sizes"
).split()


def get_session(app: str = "lociflow", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a local session takes one beside its
    warehouse; a cluster has to name one, as a folder of one machine would be of no use there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a shared folder")
    if not folder:
        home = spark.conf.get("spark.sql.warehouse.dir", "").removeprefix("file:") or os.getcwd()
        folder = os.path.join(home, "_checkpoints")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder: a lineage cut that outlives executors, and that computes df once only
    (checkpoint() computes its last stage twice). The table is deleted by forget(), or as the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of cut frames that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame) -> DataFrame:
    """Keep df for reuse within a query; lost blocks are recomputed from the lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

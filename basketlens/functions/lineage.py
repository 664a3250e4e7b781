"""Cut lineage by writing a table to the shared checkpoint folder.

A written Parquet table survives executor loss (no recomputation from the
sources), keeps column pruning, predicate pushdown and partition pruning for
everything that reads it, and keeps the downstream plans small.  The folder
is the cluster's ``spark.checkpoint.dir``; a scratch folder is set only when
nothing is configured (local tests).  An application's tables lie in one
folder of its own, which :func:`drop_checkpoints` removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.sinks import write_table


def checkpoint_root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/basketlens-tables/{spark.conf.get('spark.app.id', 'application')}"


def table_checkpoint(df: DataFrame, name: str, partition_by: list[str] | None = None,
                     cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the checkpoint folder and return the table read back
    (partitioned and clustered as :func:`write_table` does)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path, "parquet", partition_by=partition_by, cluster_by=cluster_by)
    return spark.read.parquet(path)


def drop_checkpoints(spark: SparkSession) -> None:
    """Remove all tables this application has written with
    :func:`table_checkpoint`; whatever was read from them can be read no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

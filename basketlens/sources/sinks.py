"""Writers for the three data products."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None,
                cluster_by: list[str] | None = None, observe=None, compression: str | None = None) -> None:
    """Overwrite ``path`` with ``df``; the writer creates missing folders.

    Parquet is the default hand-off format (typed, columnar, prunable).  CSV
    is kept for consumers that need text; it is written with a header and
    without an index column, as plain text unless ``compression`` names a
    codec (a compressed file is read by one task).

    With ``partition_by`` the rows are first rebalanced on the partition
    columns: one shuffle without a sampling pass, after which adaptive
    execution splits the tasks of large values and merges those of small ones,
    so every value gets a few files of about the advisory size.  ``cluster_by``
    sorts the rows of a task below the partition columns.

    ``observe`` = (Observation, metric columns) collects metrics during the
    write itself.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *(cluster_by or []))
    if observe:
        df = df.observe(observe[0], *observe[1])
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown sink format {fmt!r}")

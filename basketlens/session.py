"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Target sizes: a scan task reads about 256 MB of Parquet; after a shuffle AQE
# merges partitions up to about 128 MB.  The initial shuffle partition count
# must be large enough for the biggest shuffle (AQE can merge partitions but
# not split them, except for skewed join partitions).
SCAN_PARTITION_BYTES = "256m"
SHUFFLE_PARTITION_BYTES = "128m"
INITIAL_SHUFFLE_PARTITION_BYTES = 256 * 1024 ** 2
# Every shuffle here reads pruned columns and is partially aggregated map-side
# first; the largest (order-grain facts) moves roughly a tenth of the input.
SHUFFLE_SHARE_OF_INPUT = 0.1


def shuffle_partitions_for(input_bytes: int) -> int:
    """Initial shuffle partitions for a job reading ``input_bytes``: one per
    256 MB of expected shuffle data, between 200 and 100,000 (more would
    inflate the map-output bookkeeping; AQE merges small partitions and
    splits skewed join partitions)."""
    expected = input_bytes * SHUFFLE_SHARE_OF_INPUT
    return int(min(100_000, max(200, expected // INITIAL_SHUFFLE_PARTITION_BYTES)))


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "basketlens", input_bytes: int | None = None) -> SparkSession:
    """A session tuned for this workload.

    Locally (tests, bench) the caller passes ``local[N]`` and gets a few
    shuffle partitions per core.  On a cluster the master, memory and
    ``spark.checkpoint.dir`` come from the submit configuration; pass
    ``input_bytes`` (total size of the sources) to size the shuffles, e.g.
    100 TB -> about 41,000 initial partitions, which AQE coalesces towards
    128 MB after each shuffle.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = is_local(master)
    if shuffle_partitions:
        parts = shuffle_partitions
    elif input_bytes:
        parts = shuffle_partitions_for(input_bytes)
    elif local:
        parts = max(8, _cores(master) * 2)
    else:
        parts = None  # keep the cluster's setting
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Lets AQE keep several tasks after small shuffles (CPU-bound final
        # stages); large shuffles are sized by the advisory partition size.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    if not local:
        builder = (builder
                   .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_PARTITION_BYTES)
                   .config("spark.sql.files.maxPartitionBytes", SCAN_PARTITION_BYTES))
    if local:
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("BASKETLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cores(master: str | None) -> int:
    if master and master.startswith("local[") and master[6:-1].isdigit():
        return int(master[6:-1])
    return os.cpu_count() or 4


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and is
    used as is.  Only in local runs (tests, bench), where nothing is
    configured, a fresh scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc is None or not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a "
                               "shared, durable folder (a machine-local folder would not "
                               "survive executor loss)")
        configured = tempfile.mkdtemp(prefix="basketlens-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
    return configured


def is_local(master: str | None) -> bool:
    """Driver and executors are one process (unlike ``local-cluster``)."""
    return bool(master) and (master == "local" or master.startswith("local["))

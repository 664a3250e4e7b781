"""Sources landed in buckets of the order id.

The order-grain sources are written once as tables of ``buckets`` buckets, each
one file, sorted by order id.  The master's aggregations and joins on the order
id then read bucket by bucket and shuffle nothing; every later run over the
landed copy saves those shuffles.  Dimensions are plain Parquet.

A bucket is read by one task.  A source in which a bucket is much larger than
the others (one order with a large share of all rows) is therefore read without
its buckets: its rows are aggregated before they are shuffled.

The tables are external and known to the session's catalog under a name that
depends on the folder; another session, or catalog, registers them again from
the folder's ``_BUCKETS`` file.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basketlens.sources.release import read_text, sizes_of, write_text
from basketlens.sources.schemas import REQUIRED

KEY = "order_id"
ORDER_GRAIN = ["orders", "order_items", "order_payments", "order_reviews"]
MANIFEST = "_BUCKETS"
#: The largest bucket against the mean, beyond which buckets are not used.
MOST_SKEW = 8.0


def _name(base: str, source: str) -> str:
    return f"basketlens_{zlib.crc32(base.rstrip('/').encode()):08x}_{source}"


def land_bucketed(spark: SparkSession, sources: dict[str, DataFrame], base: str, buckets: int) -> None:
    """Write the sources to ``base``.  One shuffle per order-grain source; as
    its partitions are the buckets, each gives one file."""
    base = base.rstrip("/")
    kinds = {sources[n].schema[KEY].dataType.simpleString() for n in ORDER_GRAIN}
    if len(kinds) > 1:
        raise ValueError(f"{KEY} has several types: {sorted(kinds)}")
    said: dict = {"buckets": buckets, "sources": {}}
    for source in REQUIRED:
        df, path = sources[source], f"{base}/{source}.parquet"
        if source not in ORDER_GRAIN:
            df.write.mode("overwrite").parquet(path)
            continue
        table = _name(base, source)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        (df.repartition(buckets, KEY).write.format("parquet").mode("overwrite").option("path", path)
         .bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table))
        sizes = sizes_of(spark, path)
        said["sources"][source] = {"schema": json.loads(df.schema.json()),
                                   "skew": max(sizes) * buckets / max(1, sum(sizes)) if sizes else 1.0}
    write_text(spark, f"{base}/{MANIFEST}", json.dumps(said, indent=1))


class BucketedSources(dict):
    """Sources by name.  The rows of the ``placed`` ones need no dealing by
    order id before the master aggregates them."""

    placed = frozenset(ORDER_GRAIN)


def load_bucketed(spark: SparkSession, base: str, most_skew: float = MOST_SKEW) -> dict[str, DataFrame]:
    """All eight sources from a folder written by :func:`land_bucketed`."""
    base = base.rstrip("/")
    said = json.loads(read_text(spark, f"{base}/{MANIFEST}"))
    out = BucketedSources()
    for source in REQUIRED:
        path, known = f"{base}/{source}.parquet", said["sources"].get(source)
        if known is None or known["skew"] > most_skew:
            out[source] = spark.read.parquet(path)
            continue
        table = _name(base, source)
        if not spark.catalog.tableExists(table):
            fields = T.StructType.fromJson(known["schema"]).fields
            columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
            where = path.replace("'", "\\'")
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                      f"INTO {said['buckets']} BUCKETS LOCATION '{where}'")
        out[source] = spark.table(table)
    return out

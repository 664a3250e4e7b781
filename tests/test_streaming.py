"""The streaming delivery feed equals the batch projection."""

import os
import tempfile

from pyspark.sql import functions as F

from basketlens.operators.delivery import add_delivery_metrics
from basketlens.sources.adapter import logical_sources
from basketlens.streaming.delivery_feed import (ORDER_STREAM_SCHEMA, delivery_stream,
                                                monthly_on_time_stream, start)
from conftest import SF_SMALL


def test_stream_matches_batch(spark):
    orders = logical_sources(spark, SF_SMALL)["orders"].select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ORDER_STREAM_SCHEMA.fields])
    src = tempfile.mkdtemp(prefix="basketlens-stream-")
    # two arrivals of files
    orders.where(F.col("order_id").cast("long") % 2 == 0).write.parquet(os.path.join(src, "a"))
    orders.where(F.col("order_id").cast("long") % 2 == 1).write.parquet(os.path.join(src, "b"))

    stream = delivery_stream(spark, os.path.join(src, "*"), max_files_per_trigger=1)
    q1 = start(stream, "deliveries_test", sink="memory", available_now=True)
    q2 = start(monthly_on_time_stream(stream), "monthly_on_time_test", sink="memory",
               output_mode="complete", available_now=True)
    q1.awaitTermination(120)
    q2.awaitTermination(120)

    got = spark.table("deliveries_test").select("order_id", "delay_days", "is_late", "is_early")
    want = add_delivery_metrics(orders).select("order_id", "delay_days", "is_late", "is_early")
    assert got.count() == orders.count()
    assert got.exceptAll(want).count() == 0

    monthly = spark.table("monthly_on_time_test")
    batch = (add_delivery_metrics(orders)
             .where((F.col("order_status") == "delivered") & F.col("delay_days").isNotNull()))
    assert monthly.agg(F.sum("delivered_orders")).first()[0] == batch.count()

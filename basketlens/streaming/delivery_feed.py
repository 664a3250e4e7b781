"""Incremental delivery facts with Structured Streaming.

The reference recomputes its products in batch.  When order files keep
arriving, the per-order delivery columns are a stateless projection of the
order row, so they can be kept up to date incrementally with the same column
functions as the batch job:

* :func:`delivery_stream`: a file stream of logical orders with
  ``delay_days``, ``is_late``, ``is_early``, ``delivery_days_actual``,
  ``order_month`` and ``order_year``;
* :func:`monthly_on_time_stream`: the running on-time share per purchase
  month (state: one row per month, so it stays bounded);
* :func:`start` runs either into a sink with its checkpoint in the shared
  checkpoint folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from basketlens.operators.delivery import DELIVERED, add_delivery_metrics, with_order_period
from basketlens.session import ensure_checkpoint_dir

ORDER_STREAM_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
    T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
    T.StructField("order_estimated_delivery_date", T.TimestampNTZType()),
])


def delivery_stream(spark: SparkSession, orders_dir: str,
                    schema: T.StructType = ORDER_STREAM_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_order_period(add_delivery_metrics(reader.parquet(orders_dir)))


def monthly_on_time_stream(deliveries: DataFrame) -> DataFrame:
    d = deliveries.where((F.col("order_status") == DELIVERED) & F.col("delay_days").isNotNull())
    return d.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.count_if(F.col("is_late")).alias("late_orders"),
        (F.avg((~F.col("is_late")).cast("double")) * 100.0).alias("on_time_rate"))


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None,
          output_mode: str = "append", available_now: bool = False) -> StreamingQuery:
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    w = (df.writeStream.queryName(name).outputMode(output_mode)
         .option("checkpointLocation", f"{base}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w
    return w.format(sink).start(path) if path else w.format(sink).start()

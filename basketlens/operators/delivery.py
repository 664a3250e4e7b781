"""Delivery metrics: per-order delay columns and the delivery log.

All columns are narrow projections of the order row, so no join is needed:
the four columns are filled for delivered orders and NULL otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.semantics import flag, floor_days, ntz_month_text, pct_not

DELIVERED = "delivered"


def add_delivery_metrics(df: DataFrame) -> DataFrame:
    """``delay_days`` (delivered minus estimated, floored days), ``is_late``,
    ``is_early`` (a missing delay counts as neither) and
    ``delivery_days_actual`` (delivered minus purchase), all NULL unless the
    order is delivered."""
    delivered = F.col("order_status") == F.lit(DELIVERED)
    delay = floor_days("order_estimated_delivery_date", "order_delivered_customer_date")
    actual = floor_days("order_purchase_timestamp", "order_delivered_customer_date")
    return df.select(
        "*",
        F.when(delivered, delay).alias("delay_days"),
        F.when(delivered, flag(delay > 0)).alias("is_late"),
        F.when(delivered, flag(delay < 0)).alias("is_early"),
        F.when(delivered, actual).alias("delivery_days_actual"),
    )


def with_order_period(df: DataFrame) -> DataFrame:
    """``order_month`` ('yyyy-MM' text) and ``order_year`` of the purchase."""
    ts = F.col("order_purchase_timestamp")
    return df.withColumn("order_month", ntz_month_text(ts)).withColumn("order_year", F.year(ts))


def delivery_log(master: DataFrame) -> DataFrame:
    """On-time share of delivered orders (missing delivery date counts as on
    time) and mean delay of late orders."""
    d = master.where(F.col("order_status") == DELIVERED)
    return d.agg(pct_not("is_late").alias("on_time_pct"),
                 F.avg(F.when(F.col("is_late"), F.col("delay_days"))).alias("avg_late_delay"),
                 F.count(F.lit(1)).alias("delivered_orders"))

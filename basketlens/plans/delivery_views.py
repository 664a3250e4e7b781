"""Delivery performance datasets over delivered orders that have a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.semantics import pct_not

HIST_BINS = 60
LATE, ON_TIME = "Late", "On Time / Early"


def with_delay(delivered: DataFrame) -> DataFrame:
    """Delivered orders with a known delay (a missing delivery date drops
    out here, unlike in the overview's on-time share)."""
    return delivered.where(F.col("delay_days").isNotNull())


def delivery_kpis(d: DataFrame) -> DataFrame:
    return d.agg(
        pct_not("is_late").alias("on_time_pct"),
        F.avg(F.when(F.col("is_late"), F.col("delay_days"))).alias("avg_delay"),
        F.avg(F.when(F.col("is_early"), F.abs("delay_days"))).alias("avg_early"),
        F.count(F.lit(1)).alias("delivered_orders"),
    ).withColumn("on_time_ok", F.col("on_time_pct") >= 90.0)


def delay_status(c: str = "is_late"):
    return F.when(F.col(c), F.lit(LATE)).otherwise(F.lit(ON_TIME))


def delay_histogram(d: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Counts of delay days per (bin, status): at most ``bins`` integer-wide
    bins spanning min..max, width ceil((max - min + 1) / bins)."""
    rng = d.agg(F.min("delay_days").alias("_lo"), F.max("delay_days").alias("_hi"))
    width = F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(bins)).cast("long")
    binned = (d.crossJoin(one_row(rng))
              .select((F.col("delay_days") - F.col("_lo")).alias("_off"), width.alias("_w"),
                      F.col("_lo"), delay_status().alias("Status")))
    b = F.expr("_off div _w")
    return (binned.groupBy(b.alias("bin"), "Status", "_lo", "_w")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w") - 1).alias("bin_end"),
                    "Status", "count")
            .orderBy("bin", "Status"))


def monthly_on_time(d: DataFrame) -> DataFrame:
    return (d.where(F.col("order_month").isNotNull())
            .groupBy("order_month").agg(pct_not("is_late").alias("on_time_rate"))
            .orderBy("order_month"))


def worst_states(d: DataFrame, min_orders: int = 20, k: int = 15) -> DataFrame:
    """The k states with the lowest on-time share among those with at least
    ``min_orders`` orders."""
    return (d.where(F.col("customer_state").isNotNull())
            .groupBy("customer_state")
            .agg(pct_not("is_late").alias("on_time_rate"), F.count("order_id").alias("orders"))
            .where(F.col("orders") >= min_orders)
            .orderBy("on_time_rate", "customer_state")
            .limit(k))


def worst_categories(d: DataFrame, min_late: int = 10, k: int = 15) -> DataFrame:
    """The k categories with the longest mean delay of late orders among
    those with at least ``min_late`` late orders."""
    return (d.where(F.col("is_late") & F.col("category").isNotNull())
            .groupBy("category")
            .agg(F.avg("delay_days").alias("avg_delay"), F.count("order_id").alias("late_orders"))
            .where(F.col("late_orders") >= min_late)
            .orderBy(F.desc("avg_delay"), "category")
            .limit(k))

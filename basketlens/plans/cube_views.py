"""The order-grain dashboard datasets from the cube (``operators.cube``): the
same columns and rows as those over the order master, read from small tables.

``cells`` and ``bits`` are filtered rows of the cube and of the bitmaps; they
hold the columns that the dashboard's filters use, so ``apply_filters`` and
``delivered_only`` work on them as on the master.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.semantics import title_words
from basketlens.operators.cube import (distinct_customers, is_delivered, mean_of, on_time, orders, ratio, revenue)
from basketlens.plans.overview import ON_TIME_TARGET, REVIEW_TARGET, share_of_total


def sidebar_totals(cells: DataFrame, bits: DataFrame) -> DataFrame:
    return distinct_customers(bits).crossJoin(one_row(cells.agg(F.coalesce(orders(), F.lit(0)).alias("orders"))))


def overview_kpis(cells: DataFrame, bits: DataFrame) -> DataFrame:
    dlv = is_delivered()
    kpis = cells.agg(
        F.coalesce(orders(), F.lit(0)).alias("total_orders"),
        revenue(dlv).cast("double").alias("total_revenue"),
        ratio(revenue(dlv), F.sum(F.when(dlv, F.col("paid")))).alias("avg_order_value"),
        mean_of("review_sum", "reviews", dlv).alias("avg_review"),
        on_time("rows", dlv).alias("on_time_rate"))
    return distinct_customers(bits, "total_customers").crossJoin(one_row(kpis)).withColumn(
        "review_ok", F.col("avg_review") >= REVIEW_TARGET).withColumn(
        "on_time_ok", F.col("on_time_rate") >= ON_TIME_TARGET)


def monthly_trend(cells: DataFrame) -> DataFrame:
    return (cells.where(F.col("order_month").isNotNull()).groupBy("order_month")
            .agg(orders().alias("Orders"), revenue().cast("double").alias("Revenue")).orderBy("order_month"))


def payment_mix(cells: DataFrame) -> DataFrame:
    counts = (cells.where(F.col("payment_type").isNotNull())
              .groupBy("payment_type").agg(F.sum("rows").alias("Count")))
    named = counts.select(title_words("payment_type").alias("Type"), "Count")
    return share_of_total(named, "Count").orderBy(F.desc("Count"), "Type")


def top_states_revenue(delivered: DataFrame, k: int = 10) -> DataFrame:
    return (delivered.where(F.col("customer_state").isNotNull()).groupBy(F.col("customer_state").alias("State"))
            .agg(revenue().cast("double").alias("Revenue")).orderBy(F.desc("Revenue"), "State").limit(k))


def delivery_kpis(delivered: DataFrame) -> DataFrame:
    """Of the delivered orders with a delay."""
    return delivered.agg(
        on_time("with_delay").alias("on_time_pct"),
        mean_of("late_delay_sum", "late").alias("avg_delay"),
        mean_of("early_sum", "early").alias("avg_early"),
        F.coalesce(F.sum("with_delay"), F.lit(0)).alias("delivered_orders"),
    ).withColumn("on_time_ok", F.col("on_time_pct") >= 90.0)


def with_delay(delivered: DataFrame) -> DataFrame:
    """Cells that hold an order with a delay."""
    return delivered.where(F.col("with_delay") > 0)


def monthly_on_time(d: DataFrame) -> DataFrame:
    return (d.where(F.col("order_month").isNotNull()).groupBy("order_month")
            .agg(on_time("with_delay").alias("on_time_rate")).orderBy("order_month"))


def worst_states(d: DataFrame, min_orders: int = 20, k: int = 15) -> DataFrame:
    return (d.where(F.col("customer_state").isNotNull()).groupBy("customer_state")
            .agg(on_time("with_delay").alias("on_time_rate"), F.sum("with_delay").alias("orders"))
            .where(F.col("orders") >= min_orders).orderBy("on_time_rate", "customer_state").limit(k))


def worst_categories(d: DataFrame, min_late: int = 10, k: int = 15) -> DataFrame:
    return (d.where((F.col("late") > 0) & F.col("category").isNotNull()).groupBy("category")
            .agg(mean_of("late_delay_sum", "late").alias("avg_delay"), F.sum("late").alias("late_orders"))
            .where(F.col("late_orders") >= min_late).orderBy(F.desc("avg_delay"), "category").limit(k))


def state_summary(delivered: DataFrame) -> DataFrame:
    return (delivered.where(F.col("customer_state").isNotNull()).groupBy(F.col("customer_state").alias("State"))
            .agg(orders().alias("orders"), revenue().cast("double").alias("revenue"),
                 ratio(revenue(), F.sum("paid")).alias("avg_revenue"), mean_of("review_sum", "reviews").alias("avg_review"),
                 on_time("rows").alias("on_time_rate"), mean_of("delay_sum", "with_delay").alias("avg_delay")))


def peak_month(cells: DataFrame) -> DataFrame:
    return (cells.where(F.col("order_month").isNotNull()).groupBy("order_month").agg(orders().alias("orders"))
            .orderBy(F.desc("orders"), "order_month").limit(1))


def top_state_revenue_share(delivered: DataFrame) -> DataFrame:
    per_state = (delivered.where(F.col("customer_state").isNotNull()).groupBy("customer_state")
                 .agg(revenue().alias("revenue")))
    total = per_state.agg(F.sum("revenue").alias("_total"))
    top = per_state.orderBy(F.desc("revenue"), "customer_state").limit(1)
    return top.crossJoin(one_row(total)).select(
        F.col("customer_state").alias("State"), F.col("revenue").cast("double").alias("revenue"),
        (F.col("revenue").cast("double") / F.col("_total").cast("double") * 100.0).alias("revenue_share_pct"))

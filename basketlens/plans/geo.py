"""Geographic datasets: per-state order and customer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.semantics import (fmt_money, fmt_percent, fmt_percent_of_one,
                                            money_mean, money_sum, pct_not)


def state_summary(delivered: DataFrame) -> DataFrame:
    """Per customer state over delivered orders: orders, revenue, mean order
    value, mean review, on-time share (missing date = on time), mean delay."""
    return (delivered.where(F.col("customer_state").isNotNull())
            .groupBy("customer_state")
            .agg(F.count("order_id").alias("orders"),
                 money_sum("payment_value").cast("double").alias("revenue"),
                 money_mean("payment_value").alias("avg_revenue"),
                 F.avg("review_score").alias("avg_review"),
                 pct_not(F.coalesce(F.col("is_late"), F.lit(False))).alias("on_time_rate"),
                 F.avg("delay_days").alias("avg_delay"))
            .withColumnRenamed("customer_state", "State"))


def rfm_by_state(scored: DataFrame) -> DataFrame:
    """Per state over the whole customer table (not affected by filters)."""
    return (scored.where(F.col("customer_state").isNotNull())
            .groupBy("customer_state")
            .agg(F.avg("RFM_total").alias("avg_rfm"),
                 F.count("customer_unique_id").alias("customers"),
                 F.avg("churn_probability").alias("avg_churn"))
            .withColumnRenamed("customer_state", "State"))


def state_table(summary: DataFrame, by_state: DataFrame) -> DataFrame:
    """State summary left-joined with the customer view.  Both sides are
    per-state aggregates (one row per state), so the join moves only those
    rows; no size check is spent on it and AQE picks the strategy from the
    real sizes."""
    return summary.join(by_state, "State", "left")


def top_20_states(table: DataFrame, k: int = 20) -> DataFrame:
    """The k states with the highest revenue, shown in ascending order."""
    return table.orderBy(F.desc("revenue"), "State").limit(k).orderBy("revenue", "State")


def states_by_on_time(table: DataFrame) -> DataFrame:
    return table.orderBy("on_time_rate", "State")


def state_table_fmt(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("revenue"), "State").select(
        "State",
        F.col("orders").alias("Orders"),
        fmt_money("revenue", 0).alias("Total Revenue"),
        fmt_money("avg_revenue", 2).alias("Avg Order Value"),
        F.bround("avg_review", 2).alias("Avg Review"),
        fmt_percent("on_time_rate", 1).alias("On-Time Rate"),
        F.bround("avg_delay", 1).alias("Avg Delay (days)"),
        F.bround("avg_rfm", 2).alias("Avg RFM Score"),
        F.col("customers").alias("Customers"),
        fmt_percent_of_one("avg_churn").alias("Avg Churn Risk"),
    )

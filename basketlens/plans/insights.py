"""Datasets behind the dashboard's narrative statements: the claims the
reference shows as fixed text are computed here from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.semantics import money_sum, pct_not
from basketlens.plans.delivery_views import delay_status


def peak_month(mdf: DataFrame) -> DataFrame:
    """The month with the most orders (ties: earliest)."""
    return (mdf.where(F.col("order_month").isNotNull())
            .groupBy("order_month").agg(F.count("order_id").alias("orders"))
            .orderBy(F.desc("orders"), "order_month").limit(1))


def top_state_revenue_share(delivered: DataFrame) -> DataFrame:
    """The state with the highest delivered revenue and its share of the
    total, in percent."""
    per_state = (delivered.where(F.col("customer_state").isNotNull())
                 .groupBy("customer_state").agg(money_sum("payment_value").alias("revenue")))
    total = per_state.agg(F.sum("revenue").alias("_total"))
    top = per_state.orderBy(F.desc("revenue"), "customer_state").limit(1)
    return top.crossJoin(one_row(total)).select(
        F.col("customer_state").alias("State"),
        F.col("revenue").cast("double").alias("revenue"),
        (F.col("revenue").cast("double") / F.col("_total").cast("double") * 100.0)
        .alias("revenue_share_pct"))


def dormant_share(rfm: DataFrame) -> DataFrame:
    """Share of customers in the "Lost" and "Hibernating" segments."""
    dormant = F.col("Segment").isin("Lost", "Hibernating")
    return rfm.agg(F.count_if(dormant).alias("dormant_customers"),
                   F.count(F.lit(1)).alias("customers"),
                   (F.avg(dormant.cast("double")) * 100.0).alias("dormant_pct"))


def delay_vs_review(d: DataFrame) -> DataFrame:
    """Mean review score of late versus on-time/early deliveries, with the
    correlation of delay and review over all of them."""
    corr = d.agg(F.corr(F.col("delay_days").cast("double"),
                        F.col("review_score").cast("double")).alias("delay_review_corr"))
    by_status = (d.groupBy(delay_status().alias("Status"))
                 .agg(F.count("order_id").alias("orders"),
                      F.avg("review_score").alias("avg_review"),
                      F.avg("delay_days").alias("avg_delay")))
    return by_status.crossJoin(one_row(corr))


def churn_by_segment_and_late(scored: DataFrame) -> DataFrame:
    """Churn share per segment for customers with and without a late
    delivery (the segment x delivery view the dashboard promises)."""
    had_late = F.coalesce(F.col("late_pct") > 0, F.lit(False))
    return (scored.groupBy("Segment", had_late.alias("had_late_delivery"))
            .agg(F.count("customer_unique_id").alias("customers"),
                 (F.avg(F.col("is_churned").cast("double")) * 100.0).alias("churn_rate"),
                 pct_not(F.col("is_churned") == 1).alias("retained_pct")))

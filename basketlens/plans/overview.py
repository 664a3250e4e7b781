"""Overview datasets: sidebar totals, KPIs, monthly trend, payment mix and
top states by revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row
from basketlens.functions.semantics import money_mean, money_sum, pct_not, title_words
from basketlens.operators.delivery import DELIVERED

REVIEW_TARGET = 4.0
ON_TIME_TARGET = 90.0


def sidebar_totals(master: DataFrame) -> DataFrame:
    """Distinct customers and orders of the unfiltered master (``order_id``
    is unique in the master, so a plain count is its distinct count)."""
    return master.agg(F.countDistinct("customer_unique_id").alias("customers"),
                      F.count("order_id").alias("orders"))


def overview_kpis(mdf: DataFrame) -> DataFrame:
    """Counts over the filtered rows; revenue, order value, review and
    on-time share over its delivered rows; and the KPI verdicts."""
    dlv = F.col("order_status") == DELIVERED
    pay = F.when(dlv, F.col("payment_value"))
    kpis = mdf.agg(
        F.countDistinct("customer_unique_id").alias("total_customers"),
        F.count("order_id").alias("total_orders"),
        money_sum(pay).cast("double").alias("total_revenue"),
        money_mean(pay).alias("avg_order_value"),
        F.avg(F.when(dlv, F.col("review_score"))).alias("avg_review"),
        pct_not(F.when(dlv, F.coalesce(F.col("is_late"), F.lit(False)))).alias("on_time_rate"),
    )
    return kpis.withColumn("review_ok", F.col("avg_review") >= REVIEW_TARGET).withColumn(
        "on_time_ok", F.col("on_time_rate") >= ON_TIME_TARGET)


def monthly_trend(mdf: DataFrame) -> DataFrame:
    """Orders and revenue per month over all selected statuses."""
    return (mdf.where(F.col("order_month").isNotNull())
            .groupBy("order_month")
            .agg(F.count("order_id").alias("Orders"),
                 money_sum("payment_value").cast("double").alias("Revenue"))
            .orderBy("order_month"))


def share_of_total(counts: DataFrame, count_col: str) -> DataFrame:
    """Adds ``share`` = count / total.  The total is a one-row aggregate of
    the (small) grouped result, broadcast back; no global window."""
    total = counts.agg(F.sum(count_col).alias("_total"))
    return (counts.crossJoin(one_row(total))
            .withColumn("share", F.col(count_col) / F.col("_total")).drop("_total"))


def payment_mix(mdf: DataFrame) -> DataFrame:
    """Orders per payment type (non-null), prettified name, pie share."""
    counts = (mdf.where(F.col("payment_type").isNotNull())
              .groupBy("payment_type").agg(F.count(F.lit(1)).alias("Count")))
    named = counts.select(title_words("payment_type").alias("Type"), "Count")
    return share_of_total(named, "Count").orderBy(F.desc("Count"), "Type")


def top_states_revenue(delivered: DataFrame, k: int = 10) -> DataFrame:
    """The k states with the highest delivered revenue (ties by name)."""
    return (delivered.where(F.col("customer_state").isNotNull())
            .groupBy("customer_state")
            .agg(money_sum("payment_value").cast("double").alias("Revenue"))
            .select(F.col("customer_state").alias("State"), "Revenue")
            .orderBy(F.desc("Revenue"), "State")
            .limit(k))

"""Churn-risk datasets over the scored customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.quantiles import exact_quantiles
from basketlens.functions.semantics import fmt_money, fmt_percent, fmt_percent_of_one
from basketlens.operators.churn import HIGH_RISK
from basketlens.operators.rfm import SEGMENT_ORDER, segment_rank
from basketlens.plans.segments import segment_facts

# The target share and the rows shown.
CHURN_TARGET = 50.0
HIGH_RISK_ROWS = 50


def churn_kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        (F.avg(F.col("is_churned").cast("double")) * 100.0).alias("churn_rate"),
        F.count_if(F.col("churn_probability") > HIGH_RISK).alias("high_risk_customers"),
        F.count_if(F.col("Segment") == "Champions").alias("champions"),
    ).withColumn("churn_ok", F.col("churn_rate") < CHURN_TARGET)


def segment_churn(scored: DataFrame) -> DataFrame:
    """Churn share, mean late share, mean churn probability and customers per
    segment, highest churn first; from the scored customers or their
    ``segment_facts``."""
    facts = scored if "customer_unique_id" not in scored.columns else segment_facts(scored)
    return (facts.select("Segment", "churn_rate", "late_pct", "avg_churn_prob", "customers")
            .orderBy(F.desc("churn_rate"), "Segment"))


def segment_churn_by_probability(seg: DataFrame) -> DataFrame:
    return seg.orderBy("avg_churn_prob", "Segment")


def coefficients_by_value(coef: DataFrame) -> DataFrame:
    return coef.orderBy("Coefficient", "Feature")


def churn_box(scored: DataFrame) -> DataFrame:
    """Five-number summary of the churn probability per segment (linear
    quartiles), in display order.  Exact and distributed: a segment holding
    most customers is not gathered into one task."""
    q = exact_quantiles(scored, "churn_probability", [0.0, 0.25, 0.5, 0.75, 1.0],
                        ["p_min", "p_q1", "p_median", "p_q3", "p_max"], by=["Segment"],
                        max_groups=len(SEGMENT_ORDER) + 1)
    return q.orderBy(segment_rank("Segment"))


def high_risk(scored: DataFrame, k: int = HIGH_RISK_ROWS) -> DataFrame:
    """Customers with churn probability above the threshold, most at risk
    first (ties by id), top k, numbered from 1."""
    top = (scored.where(F.col("churn_probability") > HIGH_RISK)
           .select("customer_unique_id", "Segment", "recency_days", "frequency",
                   F.col("monetary").cast("double").alias("monetary"), "avg_review_score",
                   "late_pct", "churn_probability")
           .orderBy(F.desc("churn_probability"), "customer_unique_id")
           .limit(k))
    # At most k rows remain, so a single-partition window is bounded.
    w = Window.orderBy(F.desc("churn_probability"), "customer_unique_id")
    return top.withColumn("rank", F.row_number().over(w))


def high_risk_fmt(top: DataFrame) -> DataFrame:
    return top.select(
        "rank",
        F.col("customer_unique_id").alias("Customer ID"),
        "Segment",
        F.col("recency_days").alias("Recency (days)"),
        F.col("frequency").alias("Orders"),
        fmt_money("monetary").alias("Total Spend"),
        F.bround("avg_review_score", 2).alias("Avg Review"),
        fmt_percent("late_pct", 1).alias("Late Delivery %"),
        fmt_percent_of_one("churn_probability").alias("P(Churn)"),
    )


"""RFM segmentation datasets (read the whole customer table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.semantics import fmt_grouped, fmt_money, money_mean, str_of_rounded
from basketlens.plans.overview import share_of_total

SAMPLE_SIZE = 3000


def segment_facts(rfm: DataFrame) -> DataFrame:
    """Everything the segment datasets show, per segment, in one pass over the
    customers: at most nine rows that :func:`segment_treemap`,
    :func:`segment_profile`, :func:`segment_distribution` and the churn
    datasets select from.  ``avg_churn_prob`` is there when the customers are
    scored."""
    scored = [F.avg("churn_probability").alias("avg_churn_prob")] if "churn_probability" in rfm.columns else []
    return (rfm.groupBy("Segment")
            .agg(F.count("customer_unique_id").alias("customers"), F.count(F.lit(1)).alias("rows"),
                 money_mean("monetary").alias("avg_revenue"), F.avg("recency_days").alias("avg_recency"),
                 F.avg("frequency").alias("avg_frequency"), F.avg("avg_review_score").alias("avg_review"),
                 F.avg("late_pct").alias("late_pct"),
                 (F.avg(F.col("is_churned").cast("double")) * 100.0).alias("churn_rate"), *scored))


def _facts(rfm: DataFrame) -> DataFrame:
    """Segment facts, from the customers unless it is them already."""
    return rfm if "customer_unique_id" not in rfm.columns else segment_facts(rfm)


def segment_treemap(rfm: DataFrame) -> DataFrame:
    """Customers, mean revenue / recency / frequency / review and churn share
    per segment; from the customers or their :func:`segment_facts`."""
    return _facts(rfm).select(
        "Segment", F.col("customers").alias("Customers"), F.col("avg_revenue").alias("Avg_Revenue"),
        F.col("avg_recency").alias("Avg_Recency"), F.col("avg_frequency").alias("Avg_Freq"),
        F.col("avg_review").alias("Avg_Review"), F.col("churn_rate").alias("Churn_pct"))


def segment_revenue_median(rfm: DataFrame) -> DataFrame:
    """Colour midpoint: median over the segments of their mean revenue (at
    most eight values)."""
    return segment_treemap(rfm).agg(F.percentile("Avg_Revenue", 0.5).alias("median_avg_revenue"))


def customer_map_sample(rfm: DataFrame, n: int = SAMPLE_SIZE, buckets: int = 64) -> DataFrame:
    """A deterministic sample of min(n, customers) customers: the n smallest
    md5 digests of the id.

    A top-n merges n rows from every partition in one task.  So the n smallest
    of each of ``buckets`` digest classes are taken first (Spark limits the
    ranked groups before the shuffle too); the n smallest of all are among
    them, and the last task merges ``buckets * n`` rows at the most.
    """
    keyed = rfm.select("customer_unique_id", "recency_days",
                       F.col("monetary").cast("double").alias("monetary"), "frequency", "Segment",
                       F.md5(F.col("customer_unique_id").cast("string")).alias("_digest"))
    bucket = F.pmod(F.conv(F.substring("_digest", 25, 8), 16, 10).cast("long"), F.lit(buckets))
    ranked = keyed.withColumn("_bucket", bucket).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest")))
    return ranked.where(F.col("_rank") <= n).drop("_bucket", "_rank").orderBy("_digest").limit(n).drop("_digest")


def segment_profile(rfm: DataFrame) -> DataFrame:
    """Per segment: customers, mean recency, frequency, revenue, review and
    late-delivery share; richest segment first."""
    return _facts(rfm).select(
        "Segment", F.col("customers").alias("Customers"), F.col("avg_recency").alias("Avg_Recency"),
        F.col("avg_frequency").alias("Avg_Frequency"), F.col("avg_revenue").alias("Avg_Revenue"),
        F.col("avg_review").alias("Avg_Review"), F.col("late_pct").alias("Late_Pct"),
    ).orderBy(F.desc("Avg_Revenue"), "Segment")


def segment_profile_fmt(profile: DataFrame) -> DataFrame:
    """Display form: rounded (half to even), money and percent text."""
    return profile.select(
        F.col("Segment"),
        fmt_grouped("Customers", 0).alias("Customers"),
        F.bround("Avg_Recency", 0).cast("int").alias("Avg Recency (days)"),
        F.bround("Avg_Frequency", 2).alias("Avg Orders"),
        fmt_money("Avg_Revenue").alias("Avg Revenue"),
        F.bround("Avg_Review", 2).alias("Avg Review"),
        F.concat(str_of_rounded("Late_Pct", 1), F.lit("%")).alias("Late Delivery %"),
    )


def rfm_total_hist(rfm: DataFrame) -> DataFrame:
    """One bin per RFM total (3..15)."""
    return rfm.groupBy("RFM_total").agg(F.count(F.lit(1)).alias("customers")).orderBy("RFM_total")


def rfm_total_median(rfm: DataFrame) -> DataFrame:
    """Median RFM total.  The total takes at most 13 values (3..15), so the
    customers are first counted per value (map-side) and the exact
    ``percentile`` runs on those few (value, count) rows with the count as
    frequency: its value map is bounded by construction."""
    counts = rfm.groupBy("RFM_total").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile("RFM_total", 0.5, F.col("n")).cast("double")
                      .alias("median_rfm_total"))


def segment_distribution(rfm: DataFrame) -> DataFrame:
    """Customers per segment and share, largest first."""
    counts = _facts(rfm).select("Segment", F.col("rows").alias("Count"))
    return share_of_total(counts, "Count").orderBy(F.desc("Count"), "Segment")


"""Every dataset as a named query over the test tables: (spark, sf_dir) -> DataFrame.

Outputs are normalised for comparison with an independent SQL oracle:
decimals become doubles and doubles are rounded to 6 decimals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.broadcast import one_row
from basketlens.functions.lineage import checkpoint_root
from basketlens.functions.semantics import floor_days, ntz_date_text, ntz_text
from basketlens.operators import churn
from basketlens.operators.delivery import delivery_log
from basketlens.operators.filters import Filters, apply_filters, delivered_only, filter_options
from basketlens.operators.master import (build_master, items_by_order, latest_review_by_order,
                                         payments_by_order, product_category)
from basketlens.operators.rfm import rfm_base, rfm_cutpoints, snapshot_date
from basketlens.plans import churn_views, delivery_views, geo, insights, overview, segments
from basketlens.plans.dashboard import Dashboard
from basketlens.plans.marts import FIXED_COEFFICIENTS, FIXED_INTERCEPT, Marts, marts_for
from basketlens.sources.readers import load_sources, parse_timestamp
from basketlens.sources.schemas import ORDER_TIMESTAMPS
from basketlens.sources.sinks import write_table

# Parameters of the registered checks.  The state/status/month filter
# exercises every filter kind; 180 orders per state makes HAVING bite at
# sf0.01 (the dashboard default is 20).
FILTER_CHECK = Filters(state="NATION_7", statuses=("delivered", "shipped"),
                       months=("1996-01", "1998-12"))
WORST_STATES_MIN_ORDERS = 180
# Cells of the CSV round trip that are replaced: by the row's key modulo 20,
# texts for a missing value, and in a money column one that is no number.
MISSING_CHECK = {"customers": {"customer_state": ("customer_id", ["NA", "null", "None", "N/A"])},
                 "order_payments": {"payment_type": ("order_id", ["nan", "n/a", "<NA>"]),
                                    "payment_value": ("order_id", ["NaN", "12,50 R$"])}}


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def positioned(df: DataFrame) -> DataFrame:
    """An ordered dataset with each row's position, so that its order is
    checked too.  For datasets of a few dozen rows."""
    return df.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ROWS_ONLY: set[str] = set()


def query(name: str, rows_only: bool = False):
    def register(fn: Callable[[Marts], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(marts_for(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return register


def _mdf(m: Marts, f: Filters = Filters()) -> DataFrame:
    return apply_filters(m.master, f)


def _delivered(m: Marts) -> DataFrame:
    return delivered_only(_mdf(m))


def _with_delay(m: Marts) -> DataFrame:
    return delivery_views.with_delay(_delivered(m))


# --- order grain -----------------------------------------------------------

@query("items_by_order")
def _q(m):
    return items_by_order(m.sources["order_items"])


@query("payments_by_order")
def _q(m):
    return payments_by_order(m.sources["order_payments"])


@query("latest_review_by_order")
def _q(m):
    return latest_review_by_order(m.sources["order_reviews"])


@query("product_category")
def _q(m):
    return product_category(m.sources["products"], m.sources["category_translation"]).select(
        "product_id", "product_category_name", "product_category_name_english", "category")


@query("order_master")
def _q(m):
    return m.master.drop("order_month", "order_year")


@query("csv_roundtrip_master")
def _q(m):
    """The sources written as CSV, with missing-value texts in place of some
    values and a column that the analytics do not know, and read back by their
    headers."""
    spark = m.sources["orders"].sparkSession
    base = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    for name, df in m.sources.items():
        text = df.select(*[(ntz_text(c, fraction=False) if c in ORDER_TIMESTAMPS else F.col(c).cast("string")).alias(c)
                           for c in df.columns], F.lit('more, "quoted" text').alias("note"))
        for column, (key, texts) in MISSING_CHECK.get(name, {}).items():
            at = F.pmod(F.col(key).cast("long"), F.lit(20))
            said = F.coalesce(*[F.when(at == i, F.lit(t)) for i, t in enumerate(texts)], F.col(column))
            text = text.withColumn(column, said)
        write_table(text, f"{base}/{name}.csv", "csv", compression="gzip")
    again = build_master(load_sources(spark, base, "csv"))
    return again.select(F.col("order_id").cast("long").alias("order_id"), "order_status", "delay_days", "is_late",
                        "item_count", "total_price", "payment_value", "payment_type", "review_score",
                        "customer_state", (F.length("note") + F.length("note_customer")).alias("note_length"))


@query("delivery_metrics")
def _q(m):
    return m.master.select("order_id", "order_status", "delay_days", "is_late", "is_early",
                           "delivery_days_actual")


@query("floor_days_events")
def _q(m):
    """Sub-day flooring on event timestamps against the first and last event
    time (positive and negative fractional days)."""
    ev = m.tables["events"]
    ends = one_row(ev.agg(F.min("ts").alias("_first"), F.max("ts").alias("_last")))
    return ev.crossJoin(ends).select(
        "event_id", floor_days("_first", "ts").alias("days_since_first"),
        floor_days("_last", "ts").alias("days_from_last"))


@query("timestamp_coerce")
def _q(m):
    """Coercing timestamp parse of text built from event times: full
    timestamps parse, date-only text and junk become NULL."""
    ev = m.tables["events"]
    text = (F.when(F.col("event_type") == "error", F.concat(F.lit("bad-"), F.col("event_id").cast("string")))
            .when(F.col("event_type") == "signup", ntz_date_text("ts"))
            .otherwise(ntz_text("ts", fraction=False)))
    return ev.select("event_id", text.alias("raw")).select(
        "event_id", "raw", parse_timestamp("raw").alias("parsed"))


@query("order_month_year")
def _q(m):
    return m.master.select("order_id", "order_month", "order_year")


@query("delivery_log")
def _q(m):
    return delivery_log(m.master)


# --- customer grain --------------------------------------------------------

@query("snapshot_date")
def _q(m):
    return snapshot_date(m.master)


@query("rfm_base")
def _q(m):
    return rfm_base(m.master)


@query("rfm_cutpoints")
def _q(m):
    return rfm_cutpoints(m.rfm)


@query("recency_quantiles_sketch")
def _q(m):
    """Brackets from a coarse sketch: the path that large tables take."""
    return rfm_cutpoints(m.rfm, accuracy=50).select(*[f"r{i}" for i in range(6)])


@query("monetary_quantiles_sketch")
def _q(m):
    return rfm_cutpoints(m.rfm, accuracy=50).select(*[f"m{i}" for i in range(6)])


@query("rfm_scored")
def _q(m):
    return m.rfm.drop("is_churned")


@query("segment_distribution")
def _q(m):
    return positioned(segments.segment_distribution(m.segment_facts))


# --- filters and overview --------------------------------------------------

@query("filter_options")
def _q(m):
    return filter_options(m.master)


@query("filtered_orders")
def _q(m):
    return _mdf(m, FILTER_CHECK).select("order_id", "customer_state", "order_status",
                                        "order_month", "payment_value")


@query("sidebar_totals")
def _q(m):
    return overview.sidebar_totals(m.master)


@query("overview_kpis")
def _q(m):
    return overview.overview_kpis(_mdf(m))


@query("monthly_trend")
def _q(m):
    return overview.monthly_trend(_mdf(m))


@query("payment_mix")
def _q(m):
    return overview.payment_mix(_mdf(m))


@query("top_states_revenue")
def _q(m):
    return overview.top_states_revenue(_delivered(m))


# --- segmentation ----------------------------------------------------------

@query("segment_treemap")
def _q(m):
    return segments.segment_treemap(m.segment_facts)


@query("segment_revenue_median")
def _q(m):
    return segments.segment_revenue_median(m.segment_facts)


@query("customer_map_sample")
def _q(m):
    return segments.customer_map_sample(m.rfm)


@query("segment_profile")
def _q(m):
    return segments.segment_profile(m.segment_facts)


@query("segment_profile_fmt")
def _q(m):
    return segments.segment_profile_fmt(segments.segment_profile(m.segment_facts))


@query("customer_map_sample_300")
def _q(m):
    """Fewer rows than customers at sf0.01, so the limit is checked."""
    return segments.customer_map_sample(m.rfm, n=300, buckets=16)


@query("rfm_total_hist")
def _q(m):
    return positioned(segments.rfm_total_hist(m.rfm))


@query("rfm_total_median")
def _q(m):
    return segments.rfm_total_median(m.rfm)


# --- delivery --------------------------------------------------------------

@query("delivery_kpis")
def _q(m):
    return delivery_views.delivery_kpis(_with_delay(m))


@query("delay_histogram")
def _q(m):
    return delivery_views.delay_histogram(_with_delay(m))


@query("monthly_on_time")
def _q(m):
    return delivery_views.monthly_on_time(_with_delay(m))


@query("worst_states")
def _q(m):
    return delivery_views.worst_states(_with_delay(m), min_orders=WORST_STATES_MIN_ORDERS)


@query("worst_categories")
def _q(m):
    return delivery_views.worst_categories(_with_delay(m))


@query("worst_categories_top3")
def _q(m):
    """Fewer rows than categories, so the limit is checked."""
    return positioned(delivery_views.worst_categories(_with_delay(m), k=3))


# --- churn model -----------------------------------------------------------

@query("churn_label")
def _q(m):
    return m.rfm.select("customer_unique_id", "recency_days", "is_churned")


@query("churn_base_rate")
def _q(m):
    return churn.churn_base_rate(m.rfm)


@query("churn_features")
def _q(m):
    cases = churn.complete_cases(m.rfm)
    z = churn.with_scaled(cases, m.scaling_stats)
    return z.select("customer_unique_id", *[f"z_{f}" for f in churn.FEATURES], "is_churned")


@query("churn_split")
def _q(m):
    return churn.complete_cases(m.rfm).select("customer_unique_id", m.split.is_test().alias("is_test"))


@query("churn_class_weights")
def _q(m):
    return churn.class_weights(churn.complete_cases(m.rfm).where(~m.split.is_test()))


@query("churn_split_sizes")
def _q(m):
    """Test and training rows per class."""
    return (churn.complete_cases(m.rfm).groupBy("is_churned", m.split.is_test().alias("is_test"))
            .agg(F.count(F.lit(1)).alias("rows")))


@query("churn_coefficients", rows_only=True)
def _q(m):
    return m.churn.coefficients


@query("coefficients_by_value", rows_only=True)
def _q(m):
    return positioned(churn_views.coefficients_by_value(m.churn.coefficients))


def _centroid_table(m: Marts) -> DataFrame:
    row = churn.centroid_coefficients(m.rfm).first()  # six numbers
    return churn.coefficient_table(m.rfm.sparkSession, churn.FEATURES, list(row))


@query("churn_coefficients_centroid")
def _q(m):
    """The coefficient table of a model without an optimiser."""
    return positioned(_centroid_table(m))


@query("coefficients_by_value_centroid")
def _q(m):
    return positioned(churn_views.coefficients_by_value(_centroid_table(m)))


@query("churn_fit_optimality")
def _q(m):
    """Gradient of the stated objective at the fitted coefficients: 0."""
    g = churn.objective_gradient(m.rfm, m.churn.coefficient_values, m.churn.intercept)
    return g.select("parameter", F.round(F.abs("gradient"), 5).alias("gradient"))


@query("churn_scores_fixed")
def _q(m):
    return m.rfm_fixed.select("customer_unique_id", "Segment", "is_churned", "churn_probability")


@query("churn_scores", rows_only=True)
def _q(m):
    return m.rfm_scored.select("customer_unique_id", "Segment", "is_churned", "churn_probability")


@query("churn_metrics", rows_only=True)
def _q(m):
    return m.churn.metrics


@query("churn_report", rows_only=True)
def _q(m):
    return m.churn.report


def _churn_views(suffix: str, scored: Callable[[Marts], DataFrame], rows_only: bool):
    @query(f"churn_kpis{suffix}", rows_only)
    def _a(m):
        return churn_views.churn_kpis(scored(m))

    def facts(m):
        return scored(m) if rows_only else m.segment_facts

    @query(f"segment_churn{suffix}", rows_only)
    def _b(m):
        return churn_views.segment_churn(facts(m))

    @query(f"segment_churn_by_prob{suffix}", rows_only)
    def _c(m):
        return positioned(churn_views.segment_churn_by_probability(churn_views.segment_churn(facts(m))))

    @query(f"churn_box{suffix}", rows_only)
    def _d(m):
        return positioned(churn_views.churn_box(scored(m)))

    @query(f"high_risk{suffix}", rows_only)
    def _e(m):
        return churn_views.high_risk(scored(m))

    @query(f"high_risk_fmt{suffix}", rows_only)
    def _f(m):
        return churn_views.high_risk_fmt(churn_views.high_risk(scored(m)))


@query("churn_report_fixed")
def _q(m):
    """Classification report of the literal model on the test split."""
    scored = churn.test_scores(m.rfm, m.scaling_stats, FIXED_COEFFICIENTS, FIXED_INTERCEPT)
    return churn.classification_report(churn.predictions(scored))


@query("churn_auc_fixed")
def _q(m):
    """ROC-AUC of the literal model on the test split (one row)."""
    scored = churn.test_scores(m.rfm, m.scaling_stats, FIXED_COEFFICIENTS, FIXED_INTERCEPT)
    auc = churn.area_under_roc(scored)
    n = scored.agg(F.count(F.lit(1)).alias("test_rows"),
                   F.count_if(F.col("label") == 1).alias("positives"))
    return n.select(F.lit(auc).alias("auc"), "test_rows", "positives")


_churn_views("", lambda m: m.rfm_scored, rows_only=True)
_churn_views("_fixed", lambda m: m.rfm_fixed, rows_only=False)


# --- geography -------------------------------------------------------------

def _state_table(m: Marts) -> DataFrame:
    return geo.state_table(geo.state_summary(_delivered(m)), geo.rfm_by_state(m.rfm_fixed))


@query("state_summary")
def _q(m):
    return geo.state_summary(_delivered(m))


@query("rfm_by_state")
def _q(m):
    return geo.rfm_by_state(m.rfm_fixed)


@query("state_table")
def _q(m):
    return _state_table(m)


@query("top_20_states")
def _q(m):
    return geo.top_20_states(_state_table(m))


@query("states_by_on_time")
def _q(m):
    return positioned(geo.states_by_on_time(_state_table(m)))


@query("state_table_fmt")
def _q(m):
    return geo.state_table_fmt(_state_table(m))


# --- narrative statements ---------------------------------------------------

@query("peak_month")
def _q(m):
    return insights.peak_month(_mdf(m))


@query("top_state_revenue_share")
def _q(m):
    return insights.top_state_revenue_share(_delivered(m))


@query("dormant_share")
def _q(m):
    return insights.dormant_share(m.rfm)


@query("delay_vs_review")
def _q(m):
    return insights.delay_vs_review(_with_delay(m))


@query("churn_by_segment_and_late")
def _q(m):
    return insights.churn_by_segment_and_late(m.rfm)


# --- from the cube ------------------------------------------------------------

def _cube_dashboard(m: Marts, f: Filters) -> Dashboard:
    return Dashboard(m.master, m.rfm_fixed, filters=f, min_state_orders=WORST_STATES_MIN_ORDERS,
                     cube=(m.cube, m.bitmaps))


for _name in ("sidebar_totals", "overview_kpis", "monthly_trend", "payment_mix", "top_states_revenue", "delivery_kpis",
              "monthly_on_time", "worst_states", "worst_categories", "state_summary", "peak_month",
              "top_state_revenue_share"):
    def _from_cube(m, name=_name):
        """The dataset from the cube and the customer bitmaps."""
        return _cube_dashboard(m, Filters()).dataset(name)
    query(f"{_name}_cube")(_from_cube)


@query("overview_kpis_filtered")
def _q(m):
    """State, statuses and months chosen; from the order master."""
    return overview.overview_kpis(_mdf(m, FILTER_CHECK))


@query("overview_kpis_filtered_cube")
def _q(m):
    """The same from the cube: distinct customers are an OR of bitmaps."""
    return _cube_dashboard(m, FILTER_CHECK).dataset("overview_kpis")


# --- selections without rows --------------------------------------------------

NO_ORDERS = Filters(state="NOWHERE")
NO_DELAY = Filters(statuses=("shipped",))


@query("overview_kpis_no_orders")
def _q(m):
    """No order passes the filters: no row instead of a row of nulls."""
    return Dashboard(m.master, m.rfm_fixed, filters=NO_ORDERS).dataset("overview_kpis")


@query("segment_profile_no_orders")
def _q(m):
    """Customer-grain datasets are empty then as well."""
    return Dashboard(m.master, m.rfm_fixed, filters=NO_ORDERS).dataset("segment_profile")


@query("delivery_kpis_no_delay")
def _q(m):
    """There are orders, but none with a delivery delay."""
    return Dashboard(m.master, m.rfm_fixed, filters=NO_DELAY).dataset("delivery_kpis")


@query("overview_kpis_no_delay")
def _q(m):
    """The overview of orders that are not delivered has its row."""
    return Dashboard(m.master, m.rfm_fixed, filters=NO_DELAY).dataset("overview_kpis").select(
        "total_customers", "total_orders", "total_revenue")

"""Edge rows for each semantic rule (hand-made frames, one rule each)."""

import pytest
from pyspark.sql import functions as F

from basketlens.functions.semantics import (first_non_null, floor_days, fmt_grouped,
                                            last_non_null_nulls_last, mode_low, money_sum, title_words)
from basketlens.operators.delivery import add_delivery_metrics
from basketlens.operators.filters import Filters, apply_filters
from basketlens.operators.master import build_master, product_category
from basketlens.operators.rfm import frequency_score, score, segment_of
from basketlens.plans import delivery_views, geo, overview
from basketlens.sources.readers import parse_timestamp
from conftest import make_sources, ts


def test_s1_s3_delivery_flags(spark):
    rows = [
        ("a", "delivered", ts("2017-01-01 00:00:00"), None, ts("2017-01-10 00:00:00")),
        ("b", "shipped", ts("2017-01-01 00:00:00"), ts("2017-01-20 00:00:00"), ts("2017-01-10 00:00:00")),
        ("c", "delivered", ts("2017-01-01 00:00:00"), ts("2017-01-12 00:00:00"), ts("2017-01-10 00:00:00")),
    ]
    df = spark.createDataFrame(rows, "order_id string, order_status string, "
                               "order_purchase_timestamp timestamp_ntz, "
                               "order_delivered_customer_date timestamp_ntz, "
                               "order_estimated_delivery_date timestamp_ntz")
    out = {r.order_id: r for r in add_delivery_metrics(df).collect()}
    assert out["a"].delay_days is None and out["a"].is_late is False and out["a"].is_early is False
    b = out["b"]
    assert (b.delay_days, b.is_late, b.is_early, b.delivery_days_actual) == (None, None, None, None)
    assert (out["c"].delay_days, out["c"].is_late, out["c"].delivery_days_actual) == (2, True, 11)


def test_s2_floor_days(spark):
    base = ts("2017-01-10 12:00:00")
    ends = ["2017-01-10 00:00:00", "2017-01-11 00:00:00", "2017-01-09 11:00:00", "2017-01-12 00:00:00"]
    df = spark.createDataFrame([(base, ts(e)) for e in ends], "s timestamp_ntz, e timestamp_ntz")
    assert [r.d for r in df.select(floor_days("s", "e").alias("d")).collect()] == [-1, 0, -2, 1]


def test_s4_null_group_dropped(spark):
    df = spark.createDataFrame(
        [("o1", "SP", "delivered", 10.0, False, 1), ("o2", None, "delivered", 5.0, False, 1)],
        "order_id string, customer_state string, order_status string, payment_value double, "
        "is_late boolean, delay_days int").withColumn("review_score", F.lit(5))
    out = geo.state_summary(df).collect()
    assert [r.State for r in out] == ["SP"]


def test_s5_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([("o", None), ("o", None)], "k string, v double")
    assert df.groupBy("k").agg(money_sum("v").alias("s")).first().s == 0


def test_s8_first_non_null(spark):
    df = spark.createDataFrame([("o", 1, None), ("o", 2, "p2"), ("o", 3, "p3")],
                               "o string, n int, p string")
    assert df.groupBy("o").agg(first_non_null("p", "n").alias("f")).first().f == "p2"


def test_s9_latest_review_null_time_wins(spark):
    df = spark.createDataFrame([("o", "2", 4, "r1"), ("o", "1", 3, "r2"), ("o", None, 1, "r3")],
                               "o string, t string, s int, id string")
    got = df.groupBy("o").agg(last_non_null_nulls_last("s", "t", "id").alias("x")).first().x
    assert got == 1


def test_s10_s11_mode(spark):
    df = spark.createDataFrame([("o", "b"), ("o", "a"), ("o", "b"), ("o", "a"), ("o", None),
                                ("e", None)], "o string, t string")
    out = {r.o: r.m for r in df.groupBy("o").agg(
        F.coalesce(mode_low("t"), F.lit("unknown")).alias("m")).collect()}
    assert out == {"o": "a", "e": "unknown"}


def test_s12_null_key_kept(spark):
    src = make_sources(
        spark,
        orders=[("o1", "c1", "shipped", ts("2017-01-01 00:00:00"), None, None)],
        customers=[("c1", "u1", "SP")],
        items=[("o1", 1, None, None, 10.0, 1.0)],
        products=[("p1", "x")], sellers=[("s1", "RJ")])
    m = build_master(src).collect()
    assert len(m) == 1 and m[0].category is None and m[0].seller_state is None


def test_s13_quintile_ties_share_bins(spark):
    from basketlens.operators.rfm import QUINTILES, rfm_cutpoints
    vals = list(range(1, 11)) + [10]
    base = spark.createDataFrame([(f"c{i}", v, 1, float(v)) for i, v in enumerate(vals)],
                                 "customer_unique_id string, recency_days long, frequency long, "
                                 "monetary double")
    cuts = rfm_cutpoints(base)
    got = [r.R for r in score(base, cuts).orderBy("recency_days", "customer_unique_id").collect()]
    assert got == [5, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert QUINTILES[0] == 0.0


def test_s13_duplicate_edges_fail(spark):
    from basketlens.operators.rfm import rfm_cutpoints
    vals = [1, 1, 1, 1, 2, 3]
    base = spark.createDataFrame([(f"c{i}", v, 1, float(i)) for i, v in enumerate(vals)],
                                 "customer_unique_id string, recency_days long, frequency long, "
                                 "monetary double")
    with pytest.raises(Exception, match="not unique"):
        score(base, rfm_cutpoints(base)).collect()


def test_s14_frequency_bins(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 6, 99]], "frequency long")
    assert [r.F for r in df.select(frequency_score().alias("F")).collect()] == [1, 2, 3, 4, 4, 5, 5]


def test_s15_segment_golden(spark):
    cells = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    df = spark.createDataFrame(cells, "R int, F int, M int").withColumn("Segment", segment_of())
    counts = {r.Segment: r["count"] for r in df.groupBy("Segment").count().collect()}
    assert counts == {"Champions": 8, "Loyal Customers": 19, "New Customers": 10,
                      "Potential Loyalists": 12, "Can't Lose Them": 8, "At Risk": 10,
                      "Hibernating": 58}
    assert "Lost" not in counts


def test_s16_s17_two_on_time_definitions(spark):
    rows = [("o1", True, 3), ("o2", False, -1), ("o3", False, 0), ("o4", False, None)]
    df = (spark.createDataFrame(rows, "order_id string, is_late boolean, delay_days int")
          .withColumn("order_status", F.lit("delivered"))
          .withColumn("customer_unique_id", F.lit("u"))
          .withColumn("payment_value", F.lit(1.0)).withColumn("review_score", F.lit(4))
          .withColumn("is_early", F.col("delay_days") < 0))
    a = overview.overview_kpis(df).first().on_time_rate
    b = delivery_views.delivery_kpis(delivery_views.with_delay(df)).first().on_time_pct
    assert a == pytest.approx(75.0) and b == pytest.approx(200.0 / 3)


def test_s18_title_case_and_unknown(spark):
    src = make_sources(spark, orders=[], products=[("p1", "home_appliances_2"), ("p2", None)])
    out = {r.product_id: r.category for r in
           product_category(src["products"], src["category_translation"]).collect()}
    assert out == {"p1": "Home Appliances 2", "p2": "Unknown"}
    df = spark.createDataFrame([("credit_card",)], "t string")
    assert df.select(title_words("t").alias("x")).first().x == "Credit Card"
    for text in ("a_3d tv", "art_&_craft", "o'neill-smith x1y", "ALL CAPS", "", "été_9ème"):
        one = spark.createDataFrame([(text,)], "t string").select(title_words("t").alias("x")).first().x
        assert one == text.replace("_", " ").title()


def test_s19_s20_rounding_and_format(spark):
    df = spark.createDataFrame([(0.125, 2.5, 1234567.5)], "a double, b double, c double")
    r = df.select(F.bround("a", 2).alias("a"), F.bround("b", 0).alias("b"),
                  fmt_grouped("c", 0).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.12, 2.0, "1,234,568")


def test_src3_coercing_timestamp_parse(spark):
    df = spark.createDataFrame([("2017-01-01 01:02:03",), ("bad",), ("2017-01-01",)], "t string")
    got = [r.p for r in df.select(parse_timestamp("t").alias("p")).collect()]
    assert got == [ts("2017-01-01 01:02:03"), None, None]


def test_flt3_empty_status_list_is_no_filter(spark):
    df = spark.createDataFrame([("a", "delivered", "2017-01"), ("b", "shipped", "2017-02")],
                               "order_id string, order_status string, order_month string")
    df = df.withColumn("customer_state", F.lit("SP"))
    assert apply_filters(df, Filters(statuses=())).count() == 2
    assert apply_filters(df, Filters()).count() == 1
    assert apply_filters(df, Filters(months=("2017-02", "2017-03"), statuses=())).count() == 1


def test_prj17_unscored_customer_gets_half(spark):
    from basketlens.operators.churn import score_customers, scaling_stats, complete_cases, with_churn_label
    rows = [("u1", 10, 1, 5.0, 4.0, 0.0, 1.0), ("u2", 400, 2, 7.0, 3.0, 50.0, None),
            ("u3", 200, 1, 3.0, 5.0, 100.0, -2.0)]
    rfm = spark.createDataFrame(rows, "customer_unique_id string, recency_days long, frequency long, "
                                "monetary double, avg_review_score double, late_pct double, "
                                "avg_delay_days double")
    rfm = with_churn_label(rfm)
    stats = scaling_stats(complete_cases(rfm))
    out = {r.customer_unique_id: r.churn_probability for r in
           score_customers(rfm, stats, [1.0] * 6, 0.0).collect()}
    assert out["u2"] == 0.5 and 0.0 < out["u1"] < 1.0


def test_ml7_class_never_predicted_precision_zero(spark):
    from basketlens.operators.churn import classification_report
    pred = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)], "label double, prediction double")
    rep = {r["class"]: r for r in classification_report(pred).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1_score == 0.0
    assert rep["0"].precision == pytest.approx(1 / 3) and rep["accuracy"].f1_score == pytest.approx(1 / 3)
    assert rep["weighted avg"].support == 3


def test_timestamps_do_not_depend_on_session_time_zone(spark):
    """Zone-less timestamps across a daylight-saving change: day counts,
    month text, review-time text and parsing must not move."""
    from basketlens.functions.semantics import ntz_month_text, ntz_text
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")  # DST began 1999-10-03 00:00
    try:
        df = spark.createDataFrame([("1999-10-02 00:00:00", "1999-10-04 00:00:00"),
                                    ("1999-10-03 00:30:00", "1999-10-01 12:00:00")], "a string, b string")
        out = df.select(
            floor_days(parse_timestamp("a"), parse_timestamp("b")).alias("d"),
            ntz_month_text(parse_timestamp("a")).alias("m"),
            ntz_text(parse_timestamp("a")).alias("t")).collect()
        assert [r.d for r in out] == [2, -2]
        assert [r.m for r in out] == ["1999-10", "1999-10"]
        assert out[1].t == "1999-10-03 00:30:00.000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_money_sums_at_any_size(spark):
    from decimal import Decimal

    from basketlens.functions.semantics import money_mean, money_sum
    big = spark.range(2_000_000).select(F.lit(1e9).alias("d"), F.lit("1000000000.25").cast("decimal(28,4)").alias("c"))
    row = big.agg(money_sum("d").alias("d"), money_sum("c").alias("c"), money_mean("c").alias("m")).first()
    assert row.d == Decimal("2000000000000000") and row.c == Decimal("2000000000500000") and row.m == 1000000000.25
    fine = spark.createDataFrame([("0.123456",), ("-7.000001",), ("900719925474.930100",), (None,)], "t string")
    got = fine.select(F.col("t").cast("decimal(28,6)").alias("v")).agg(
        money_sum("v").alias("s"), money_mean("v").alias("m")).first()
    assert got.s == Decimal("900719925468.053555") and got.m == pytest.approx(300239975156.0178517)
    empty = fine.where("t is null").select(F.col("t").cast("double").alias("v"))
    got = empty.agg(money_sum("v").alias("s"), money_mean("v").alias("m")).first()
    assert got.s == 0 and got.m is None

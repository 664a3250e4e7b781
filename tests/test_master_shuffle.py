"""What the order master shuffles: rows go to their order before they are
aggregated, so no scan task sorts its rows."""

import pytest

from basketlens.operators.master import build_master, items_by_order, latest_review_by_order, payments_by_order
from conftest import make_sources, ts


@pytest.fixture(scope="module")
def sources(spark):
    return make_sources(
        spark, [("a", "c1", "delivered", ts("2020-01-01 00:00:00"), None, None), ("b", "c1", "shipped", None, None, None)],
        items=[("a", 2, "p2", "s2", 1.5, 0.5), ("a", 1, None, "s1", 2.0, 0.25), (None, 1, "p3", "s3", 9.0, 9.0)],
        payments=[("a", "x", 1, 1.5), ("a", "y", 3, 2.0), ("a", "y", 2, 0.5), (None, "z", 1, 1.0)],
        reviews=[("r1", "a", 5, "2020-01-02 00:00:00"), ("r2", "a", 1, None), ("r3", None, 3, None)])


@pytest.mark.parametrize("by_order, source", [(items_by_order, "order_items"), (payments_by_order, "order_payments"),
                                              (latest_review_by_order, "order_reviews")])
def test_rows_are_dealt_before_they_are_aggregated(sources, by_order, source):
    plan = by_order(sources[source])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    below = plan[plan.index("Exchange "):]
    assert "Aggregate" not in below and "Sort" not in below
    placed = by_order(sources[source], True)
    assert sorted(map(str, placed.collect())) == sorted(map(str, by_order(sources[source]).collect()))


def test_the_master_of_dealt_rows(sources):
    a, b = build_master(sources).orderBy("order_id").collect()
    assert (a["item_count"], float(a["total_price"]), a["product_id"], a["seller_id"]) == (2, 3.5, "p2", "s1")
    assert (float(a["payment_value"]), a["payment_type"], a["payment_installments"], a["review_score"]) == (4.0, "y", 2.0, 1)
    assert b["item_count"] is None and b["payment_value"] is None and b["review_score"] is None

"""The cube and the customer bitmaps against the order master, the empty
selection, and one scan for all segment datasets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basketlens.operators import cube
from basketlens.operators.filters import Filters, apply_filters
from basketlens.plans.dashboard import DELIVERY, UNFILTERED, Dashboard
from basketlens.plans.marts import Marts
from basketlens.sources.adapter import logical_sources
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def marts(spark):
    return Marts(logical_sources(spark, SF_SMALL))


def choices(marts):
    rng = random.Random(5)
    states = [r[0] for r in marts.master.select("customer_state").distinct().collect()]
    months = sorted(r[0] for r in marts.master.select("order_month").distinct().collect() if r[0])
    yield Filters()
    yield Filters(statuses=())
    for _ in range(4):
        a, b = sorted(rng.sample(months, 2))
        yield Filters(state=rng.choice([None, *states]), months=(a, b),
                      statuses=tuple(rng.sample(["delivered", "shipped", "processing"], rng.randrange(3))))


def near(rows):
    return sorted(str([round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r])
                  for r in rows)


def test_datasets_from_the_cube_equal_those_from_the_master(marts):
    for f in choices(marts):
        plain = Dashboard(marts.master, marts.rfm_fixed, filters=f, min_state_orders=2, min_late_orders=1)
        quick = Dashboard(marts.master, marts.rfm_fixed, filters=f, min_state_orders=2, min_late_orders=1,
                          cube=(marts.cube, marts.bitmaps))
        for name in quick._from_cube():
            a, b = plain.dataset(name), quick.dataset(name)
            assert sorted(a.columns) == sorted(b.columns), name
            assert near(a.select(*sorted(a.columns)).collect()) == near(b.select(*sorted(a.columns)).collect()), (name, f)


def test_cube_datasets_do_not_read_the_master(marts):
    quick = Dashboard(marts.master, marts.rfm_fixed, cube=(marts.cube, marts.bitmaps))
    for name in quick._from_cube():
        plan = quick.dataset(name)._jdf.queryExecution().executedPlan().toString()
        assert "order_purchase_timestamp" not in plan and "/master-" not in plan, name


def test_numbers_are_dense_and_bitmaps_exact(spark, marts):
    numbers = cube.numbered_customers(marts.master)
    got = [r.number for r in numbers.collect()]
    assert sorted(got) == list(range(1, len(got) + 1))
    # over several buckets: numbers far apart, one customer with a third of all rows, null customers
    rows = spark.range(0, 90_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id")).alias("customer_unique_id"),
        F.concat(F.lit("2017-0"), (F.col("id") % 4 + 1)).alias("order_month"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("S"), F.col("id") % 7)).alias("customer_state"),
        F.lit("delivered").alias("order_status"))
    bits = cube.customer_bitmaps(rows).persist()
    assert bits.select("bucket").distinct().count() > 1
    for f in (Filters(), Filters(state="S3"), Filters(months=("2017-02", "2017-03")), Filters(state="none")):
        want = apply_filters(rows, f).agg(F.countDistinct("customer_unique_id").alias("n")).first().n
        assert cube.distinct_customers(apply_filters(bits, f)).first().customers == want
    bits.unpersist()


@pytest.mark.parametrize("with_cube", [False, True])
def test_selections_without_rows_give_empty_datasets(marts, with_cube):
    small = {"cube": (marts.cube, marts.bitmaps)} if with_cube else {}
    nowhere = Dashboard(marts.master, marts.rfm_fixed, filters=Filters(state="nowhere"), **small)
    shipped = Dashboard(marts.master, marts.rfm_fixed, filters=Filters(statuses=("shipped",)), **small)
    for name in nowhere.datasets():
        assert nowhere.dataset(name).isEmpty() == (name not in UNFILTERED), name
        if name in DELIVERY:
            assert shipped.dataset(name).isEmpty(), name
    assert shipped.dataset("overview_kpis").count() == 1 and not shipped.dataset("segment_profile").isEmpty()


def test_segment_datasets_select_from_one_aggregate(marts):
    """With the facts kept, no segment dataset reads the customers."""
    for df in (marts.segment_facts,):
        assert df.count() <= 9
    dash = Dashboard(marts.master, marts.rfm_fixed)
    dash.__dict__["segment_facts"] = marts.segment_facts
    for name in ("segment_treemap", "segment_revenue_median", "segment_profile", "segment_profile_fmt",
                 "segment_distribution", "segment_churn", "segment_churn_by_prob"):
        plan = dash.datasets()[name]()._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"/(rfm_fixed|segment_facts)-", plan)) <= {"segment_facts"}
        assert "customer_unique_id" not in plan

"""The dashboard datasets over the products written by the batch job.

    python -m basketlens.plans.dashboard --out OUT --dataset worst_states \\
        [--state SP] [--status delivered --status shipped] [--months 2017-01 2018-08] \\
        [--rows N | --write PATH]

``Dashboard`` reads the order master, the scored customer table and the
coefficient table once and exposes every dataset by name.  The filters
reach the order-grain datasets only; the customer-grain ones read the whole
customer table, as in the reference.  Without ``--dataset`` the CLI lists
the dataset names.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.operators.filters import (Filters, apply_filters, delivered_only, filter_options,
                                         is_empty)
from basketlens.plans import churn_views, cube_views, delivery_views, geo, insights, overview, segments
from basketlens.sources.readers import if_present, read_coefficients, read_master, read_rfm
from basketlens.sources.release import product
from basketlens.sources.sinks import write_table


#: Datasets that do not depend on the selection.
UNFILTERED = {"filter_options", "sidebar_totals"}
#: Datasets over delivered orders with a known delay.
DELIVERY = {"delivery_kpis", "delay_histogram", "monthly_on_time", "worst_states", "worst_categories", "delay_vs_review"}


class Dashboard:
    """``cube`` = (order cube, customer bitmaps): the order-grain datasets that
    they hold come from them instead of the master."""

    def __init__(self, master: DataFrame, rfm: DataFrame, coefficients: DataFrame | None = None,
                 filters: Filters = Filters(), min_state_orders: int = 20,
                 min_late_orders: int = 10, cube: tuple[DataFrame, DataFrame] | None = None):
        self.master, self.rfm, self.coefficients, self.cube = master, rfm, coefficients, cube
        self.filters = filters
        self.min_state_orders, self.min_late_orders = min_state_orders, min_late_orders

    @classmethod
    def from_outputs(cls, spark: SparkSession, out_dir: str, filters: Filters = Filters(),
                     fmt: str = "parquet", **kw) -> Dashboard:
        """Over the batch job's outputs, Parquet or CSV."""
        coef = if_present(lambda: read_coefficients(spark, os.path.join(out_dir, "churn_coefficients"), fmt))
        cells, bits = (if_present(lambda n=n: product(spark, os.path.join(out_dir, n), spark.read.parquet))
                       for n in ("cube", "customer_bitmaps"))
        if "cube" not in kw and cells is not None and bits is not None:
            kw["cube"] = (cells, bits)
        return cls(read_master(spark, os.path.join(out_dir, "master"), fmt),
                   read_rfm(spark, os.path.join(out_dir, "rfm"), fmt), coef, filters, **kw)

    def has_orders(self) -> bool:
        """Whether any order passes the filters (without one, the order-grain
        datasets are empty or NULL)."""
        return not is_empty(self.mdf)

    # the filtered order rows, their delivered part, and those with a delay
    @property
    def mdf(self) -> DataFrame:
        return apply_filters(self.master, self.filters)

    @property
    def delivered(self) -> DataFrame:
        return delivered_only(self.mdf)

    @property
    def with_delay(self) -> DataFrame:
        return delivery_views.with_delay(self.delivered)

    @cached_property
    def segment_facts(self) -> DataFrame:
        """One aggregate per segment that all segment datasets select from."""
        return segments.segment_facts(self.rfm)

    def _state_table(self) -> DataFrame:
        if self.cube:
            summary = cube_views.state_summary(delivered_only(apply_filters(self.cube[0], self.filters)))
        else:
            summary = geo.state_summary(self.delivered)
        return geo.state_table(summary, geo.rfm_by_state(self.rfm))

    def datasets(self) -> dict[str, Callable[[], DataFrame]]:
        d: dict[str, Callable[[], DataFrame]] = {
            "filter_options": lambda: filter_options(self.master),
            "sidebar_totals": lambda: overview.sidebar_totals(self.master),
            "overview_kpis": lambda: overview.overview_kpis(self.mdf),
            "monthly_trend": lambda: overview.monthly_trend(self.mdf),
            "payment_mix": lambda: overview.payment_mix(self.mdf),
            "top_states_revenue": lambda: overview.top_states_revenue(self.delivered),
            "segment_treemap": lambda: segments.segment_treemap(self.segment_facts),
            "segment_revenue_median": lambda: segments.segment_revenue_median(self.segment_facts),
            "customer_map_sample": lambda: segments.customer_map_sample(self.rfm),
            "segment_profile": lambda: segments.segment_profile(self.segment_facts),
            "segment_profile_fmt": lambda: segments.segment_profile_fmt(
                segments.segment_profile(self.segment_facts)),
            "rfm_total_hist": lambda: segments.rfm_total_hist(self.rfm),
            "rfm_total_median": lambda: segments.rfm_total_median(self.rfm),
            "segment_distribution": lambda: segments.segment_distribution(self.segment_facts),
            "delivery_kpis": lambda: delivery_views.delivery_kpis(self.with_delay),
            "delay_histogram": lambda: delivery_views.delay_histogram(self.with_delay),
            "monthly_on_time": lambda: delivery_views.monthly_on_time(self.with_delay),
            "worst_states": lambda: delivery_views.worst_states(self.with_delay,
                                                                self.min_state_orders),
            "worst_categories": lambda: delivery_views.worst_categories(self.with_delay,
                                                                        self.min_late_orders),
            "churn_kpis": lambda: churn_views.churn_kpis(self.rfm),
            "segment_churn": lambda: churn_views.segment_churn(self.segment_facts),
            "segment_churn_by_prob": lambda: churn_views.segment_churn_by_probability(
                churn_views.segment_churn(self.segment_facts)),
            "churn_box": lambda: churn_views.churn_box(self.rfm),
            "high_risk": lambda: churn_views.high_risk(self.rfm),
            "high_risk_fmt": lambda: churn_views.high_risk_fmt(churn_views.high_risk(self.rfm)),
            "state_summary": lambda: geo.state_summary(self.delivered),
            "rfm_by_state": lambda: geo.rfm_by_state(self.rfm),
            "state_table": self._state_table,
            "top_20_states": lambda: geo.top_20_states(self._state_table()),
            "states_by_on_time": lambda: geo.states_by_on_time(self._state_table()),
            "state_table_fmt": lambda: geo.state_table_fmt(self._state_table()),
            "peak_month": lambda: insights.peak_month(self.mdf),
            "top_state_revenue_share": lambda: insights.top_state_revenue_share(self.delivered),
            "dormant_share": lambda: insights.dormant_share(self.rfm),
            "delay_vs_review": lambda: insights.delay_vs_review(self.with_delay),
            "churn_by_segment_and_late": lambda: insights.churn_by_segment_and_late(self.rfm),
        }
        if self.coefficients is not None:
            d["coefficients_by_value"] = lambda: churn_views.coefficients_by_value(self.coefficients)
        return d | self._from_cube()

    def _from_cube(self) -> dict[str, Callable[[], DataFrame]]:
        if self.cube is None:
            return {}
        cells, bits = (apply_filters(x, self.filters) for x in self.cube)
        delivered = delivered_only(cells)
        d = cube_views.with_delay(delivered)
        return {
            "sidebar_totals": lambda: cube_views.sidebar_totals(*self.cube),
            "overview_kpis": lambda: cube_views.overview_kpis(cells, bits),
            "monthly_trend": lambda: cube_views.monthly_trend(cells),
            "payment_mix": lambda: cube_views.payment_mix(cells),
            "top_states_revenue": lambda: cube_views.top_states_revenue(delivered),
            "delivery_kpis": lambda: cube_views.delivery_kpis(d),
            "monthly_on_time": lambda: cube_views.monthly_on_time(d),
            "worst_states": lambda: cube_views.worst_states(d, self.min_state_orders),
            "worst_categories": lambda: cube_views.worst_categories(d, self.min_late_orders),
            "state_summary": lambda: cube_views.state_summary(delivered),
            "peak_month": lambda: cube_views.peak_month(cells),
            "top_state_revenue_share": lambda: cube_views.top_state_revenue_share(delivered),
        }

    def _any(self, name: str) -> Column:
        """Whether the selection of a dataset holds an order: a subquery of the
        dataset's own plan, from the cube where there is one."""
        if self.cube:
            rows = apply_filters(self.cube[0], self.filters)
            delivered = cube_views.with_delay(delivered_only(rows))
        else:
            rows, delivered = self.mdf, self.with_delay
        return (delivered if name in DELIVERY else rows).select(F.lit(1).alias("_any")).limit(1).exists()

    def dataset(self, name: str) -> DataFrame:
        """A dataset by name.  It has no rows when no order passes the filters,
        or, of the delivery datasets, none that has a delay."""
        ds = self.datasets()
        if name not in ds:
            raise KeyError(f"unknown dataset {name!r}; known: {sorted(ds)}")
        df = ds[name]()
        return df if name in UNFILTERED else df.where(self._any(name))


def main(argv: list[str] | None = None) -> None:
    from basketlens.session import build_session

    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("--out", required=True, help="folder written by the batch job")
    ap.add_argument("--dataset")
    ap.add_argument("--state")
    ap.add_argument("--status", action="append", help="repeatable; default: delivered")
    ap.add_argument("--all-statuses", action="store_true", help="no status filter")
    ap.add_argument("--months", nargs=2, metavar=("FROM", "TO"))
    ap.add_argument("--write", help="write the dataset as Parquet to this path")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"],
                    help="format of the batch job's outputs")
    ap.add_argument("--rows", type=int, default=50, help="rows to show")
    ap.add_argument("--master", default=None, help="Spark master, e.g. local[8]")
    a = ap.parse_args(argv)

    statuses = () if a.all_statuses else tuple(a.status or ("delivered",))
    filters = Filters(state=a.state, statuses=statuses,
                      months=tuple(a.months) if a.months else None)
    dash = Dashboard.from_outputs(build_session(a.master), a.out, filters, a.format)
    if not a.dataset:
        print("\n".join(sorted(dash.datasets())))
        return
    if not dash.has_orders():
        print("no orders match the filters")
        return
    df = dash.dataset(a.dataset)
    if a.write:
        write_table(df, a.write)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()

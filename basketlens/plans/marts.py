"""The data products (order master, customer RFM table, churn model) for one
set of sources, built lazily and kept for reuse by the dashboard datasets.

Every dashboard dataset reads the same master and customer table.  By
default each product is written once as a Parquet table to the checkpoint
folder and read back (``keep="table"``): the lineage is cut, executor loss
costs a re-read instead of a recomputation from the sources, and every
dataset plans against a pruned, filter-pushed scan.  ``keep="memory"``
persists instead; ``keep="none"`` leaves the plans lazy (benchmarks).
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from basketlens.functions.lineage import table_checkpoint
from basketlens.operators import churn
from basketlens.operators.cube import customer_bitmaps, order_cube
from basketlens.operators.delivery import with_order_period
from basketlens.operators.master import build_master
from basketlens.operators.rfm import build_rfm
from basketlens.plans.segments import segment_facts
from basketlens.sources.adapter import logical_sources, read_tables

# A literal churn model (coefficients in FEATURES order and an
# intercept).  Scoring with it is plain arithmetic, so every churn-dependent
# dataset can also be checked exactly against SQL.
FIXED_COEFFICIENTS = [1.5, -0.4, -0.3, -0.2, 0.35, 0.25]
FIXED_INTERCEPT = 0.1


class Marts:
    def __init__(self, sources: dict[str, DataFrame], keep: str = "table",
                 tables: dict[str, DataFrame] | None = None):
        if keep not in ("table", "memory", "none"):
            raise ValueError(f"unknown keep mode {keep!r}")
        self.sources = sources
        self.keep = keep
        self.tables = tables or {}

    def _keep(self, df: DataFrame, name: str = "mart", **layout) -> DataFrame:
        if self.keep == "table":
            return table_checkpoint(df, name, **layout)
        if self.keep == "memory":
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        return df

    @cached_property
    def master(self) -> DataFrame:
        """Order master with ``order_month`` / ``order_year``."""
        # Partitioned by purchase month (month filters prune files) and
        # range-clustered, like the batch job's master.
        return self._keep(with_order_period(build_master(self.sources)), "master",
                          partition_by=["order_month"], cluster_by=["order_id"])

    @cached_property
    def rfm(self) -> DataFrame:
        """Scored customer table with the churn label (no probability)."""
        keep = (lambda df: self._keep(df, "rfm_base")) if self.keep != "none" else None
        return self._keep(churn.with_churn_label(build_rfm(self.master, keep=keep)), "rfm")

    @cached_property
    def cube(self) -> DataFrame:
        """Order measures per month, state, status, payment type and category."""
        return self._keep(order_cube(self.master), "cube")

    @cached_property
    def bitmaps(self) -> DataFrame:
        """Customers per month, state and status, as bitmaps."""
        return self._keep(customer_bitmaps(self.master), "bitmaps")

    @cached_property
    def segment_facts(self) -> DataFrame:
        """Segment measures of the customers scored with the literal model."""
        return self._keep(segment_facts(self.rfm_fixed).coalesce(1), "segment_facts")

    @cached_property
    def split(self):
        """The stratified train/test split of the complete customers."""
        return churn.split_of(churn.complete_cases(self.rfm))

    @cached_property
    def churn(self) -> churn.ChurnResult:
        return churn.fit_churn(self.rfm)

    @cached_property
    def rfm_scored(self) -> DataFrame:
        """Customer table with the fitted model's churn probability."""
        return self._keep(self.churn.scores, "rfm_scored")

    @cached_property
    def scaling_stats(self) -> DataFrame:
        return churn.scaling_stats(churn.complete_cases(self.rfm))

    @cached_property
    def rfm_fixed(self) -> DataFrame:
        """Customer table scored with the literal model."""
        return self._keep(churn.score_customers(self.rfm, self.scaling_stats,
                                                FIXED_COEFFICIENTS, FIXED_INTERCEPT), "rfm_fixed")


_CACHE: dict[tuple[str, str], Marts] = {}


def marts_for(spark: SparkSession, sf_dir: str) -> Marts:
    """Marts over the test tables in ``sf_dir``, one instance per session."""
    key = (spark.conf.get("spark.app.id", None) or str(id(spark)), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Marts(logical_sources(spark, sf_dir), tables=read_tables(spark, sf_dir))
    return _CACHE[key]

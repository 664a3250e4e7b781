"""Dashboard filters: state, status list and month range."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.delivery import DELIVERED


@dataclass(frozen=True)
class Filters:
    """``state=None`` means all states; an empty ``statuses`` means no status
    filter; ``months=None`` means every month (rows without a month drop
    out, as with an inclusive range over all months)."""
    state: str | None = None
    statuses: tuple[str, ...] = field(default=(DELIVERED,))
    months: tuple[str, str] | None = None


def apply_filters(master: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Plain predicates only, so they push down to the Parquet scan (and
    prune ``order_month`` partitions when the master is partitioned)."""
    df = master
    if f.state is not None:
        df = df.where(F.col("customer_state") == F.lit(f.state))
    if f.statuses:
        df = df.where(F.col("order_status").isin(list(f.statuses)))
    if f.months is None:
        df = df.where(F.col("order_month").isNotNull())
    else:
        lo, hi = f.months
        df = df.where(F.col("order_month").between(F.lit(lo), F.lit(hi)))
    return df


def delivered_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("order_status") == DELIVERED)


def filter_options(master: DataFrame) -> DataFrame:
    """Distinct non-null states, months and statuses as (kind, value) rows,
    in a single scan: the three columns are unpivoted and de-duplicated in
    one aggregation."""
    opts = F.array(
        F.struct(F.lit("state").alias("kind"), F.col("customer_state").alias("value")),
        F.struct(F.lit("month").alias("kind"), F.col("order_month").alias("value")),
        F.struct(F.lit("status").alias("kind"), F.col("order_status").alias("value")),
    )
    return (master.select(F.explode(opts).alias("o"))
            .select("o.kind", "o.value")
            .where(F.col("value").isNotNull())
            .distinct()
            .orderBy("kind", "value"))


def is_empty(df: DataFrame) -> bool:
    """Empty-result guard; reads at most one row."""
    return df.isEmpty()

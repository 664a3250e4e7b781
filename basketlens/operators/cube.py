"""Small tables that answer the order-grain dashboard datasets.

* :func:`order_cube`: sums and counts per month, state, status, payment type
  and category.  Every measure adds up, so a filter is a choice of rows, and a
  dataset one more aggregation of what is left.
* :func:`customer_bitmaps`: which customers ordered, per month, state and
  status, as bitmaps over dense customer numbers.  Distinct customers under any
  filter are the bits of an OR of rows; distinct counts do not add up.

Customers are numbered in the order of their first month and state, so the
customers of a cell lie close together: a bitmap covers 32,768 numbers and a
cell has few of them.  The numbers come from a range partitioning: a row's
place in its partition plus the rows of the partitions before, without a
global order in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.functions.semantics import money_sum
from basketlens.operators.delivery import DELIVERED

FILTERED = ["order_month", "customer_state", "order_status"]
DIMENSIONS = FILTERED + ["payment_type", "category"]
CUSTOMER = "customer_unique_id"


def order_cube(master: DataFrame) -> DataFrame:
    """One row per cell of ``DIMENSIONS`` (nulls are a value of their own)."""
    late, early = F.col("is_late"), F.col("is_early")
    return master.groupBy(*DIMENSIONS).agg(
        F.count("order_id").alias("orders"),
        F.count(F.lit(1)).alias("rows"),
        money_sum("payment_value").alias("revenue"), F.count("payment_value").alias("paid"),
        F.sum(F.col("review_score").cast("long")).alias("review_sum"), F.count("review_score").alias("reviews"),
        F.count("delay_days").alias("with_delay"), F.sum("delay_days").alias("delay_sum"),
        F.count_if(late).alias("late"), F.sum(F.when(late, F.col("delay_days"))).alias("late_delay_sum"),
        F.count_if(early).alias("early"), F.sum(F.when(early, F.abs("delay_days"))).alias("early_sum"))


def numbered_customers(master: DataFrame) -> DataFrame:
    """``(customer_unique_id, number)``, numbers dense from 1."""
    spark = master.sparkSession
    firsts = (master.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER)
              .agg(F.min(F.struct("order_month", "customer_state")).alias("first")))
    order = [F.col("first"), F.col(CUSTOMER)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (firsts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .select(CUSTOMER, F.monotonically_increasing_id().alias("at")))
    placed = table_checkpoint(placed.select(CUSTOMER, F.shiftright("at", 33).alias("part"),
                                            F.col("at").bitwiseAND((1 << 33) - 1).alias("row")), "customers")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per shuffle partition.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select(
        CUSTOMER, (F.col("before") + F.col("row") + 1).alias("number"))


def customer_bitmaps(master: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``FILTERED``, ``bucket`` and ``customers``, the bitmap of the customers
    in the bucket that have an order in the cell."""
    numbers = numbered_customers(master) if numbers is None else numbers
    # A customer's orders shrink to the cells they fall into before the join.
    cells = master.where(F.col(CUSTOMER).isNotNull()).select(CUSTOMER, *FILTERED).distinct()
    return (cells.join(numbers, CUSTOMER)
            .groupBy(*FILTERED, F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("customers")))


def distinct_customers(bitmaps: DataFrame, name: str = "customers") -> DataFrame:
    """One row: the distinct customers of the given (filtered) bitmap rows."""
    united = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("customers").alias("b"))
    return united.agg(F.coalesce(F.sum(F.bitmap_count("b")), F.lit(0)).alias(name))


# --- measures of groups of cells --------------------------------------------

def ratio(up: Column, down: Column) -> Column:
    """A mean; NULL of nothing."""
    return F.try_divide(up.cast("double"), down.cast("double"))


def orders() -> Column:
    return F.sum("orders")


def revenue(when: Column | None = None) -> Column:
    money = F.col("revenue") if when is None else F.when(when, F.col("revenue"))
    return F.coalesce(F.sum(money), F.lit(0)).cast("decimal(38,6)")


def mean_of(total: str, count: str, when: Column | None = None) -> Column:
    up, down = (F.col(c) if when is None else F.when(when, F.col(c)) for c in (total, count))
    return ratio(F.sum(up), F.sum(down))


def on_time(of: str, when: Column | None = None) -> Column:
    """Share of rows that are not late, in percent, of all rows (``rows``: a
    missing date is on time) or of those ``with_delay``."""
    n, late = (F.col(c) if when is None else F.when(when, F.col(c)) for c in (of, "late"))
    return ratio(F.sum(n) - F.sum(late), F.sum(n)) * 100.0


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED

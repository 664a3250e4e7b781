"""Order master: one row per order with item, payment, review, product and
seller facts.

Facts are aggregated to order grain *before* joining (Spark does not push
general aggregates through joins), so no join fans out.  An order has a few
rows that lie anywhere in the input, so aggregating before the shuffle saves
next to nothing, but sorts whole scan tasks, which spill as soon as a task's
rows outgrow its memory.  The rows are therefore dealt by order id first and
aggregated in the shuffle's partitions.  The three order
aggregates and the orders table all end up hash-partitioned on ``order_id``;
their joins reuse that partitioning instead of shuffling again.  Dimension
joins follow, the customer join (a different key) last.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from basketlens.functions.semantics import (first_non_null, last_non_null_nulls_last, mode_low,
                                            money_sum, title_words)
from basketlens.operators.delivery import add_delivery_metrics


def _of_orders(rows: DataFrame, placed: bool) -> DataFrame:
    """The rows that have an order, dealt by it unless they are ``placed``: in
    buckets of the order id, or known to have a hot order, whose rows are
    better aggregated before they are shuffled."""
    rows = rows.where(F.col("order_id").isNotNull())
    return rows if placed else rows.repartition("order_id")


def items_by_order(items: DataFrame, placed: bool = False) -> DataFrame:
    """Per order: item count, price and freight sums, first product and
    seller (first non-null by item number, then product and seller id)."""
    order = ("order_item_id", "product_id", "seller_id")
    return (_of_orders(items, placed)
            .groupBy("order_id")
            .agg(F.count("order_item_id").alias("item_count"),
                 money_sum("price").alias("total_price"),
                 money_sum("freight_value").alias("total_freight"),
                 first_non_null("product_id", *order).alias("product_id"),
                 first_non_null("seller_id", *order).alias("seller_id")))


def payments_by_order(payments: DataFrame, placed: bool = False) -> DataFrame:
    """Per order: payment sum, most frequent payment type (ties: smallest;
    none: "unknown") and mean number of installments."""
    return (_of_orders(payments, placed)
            .groupBy("order_id")
            .agg(money_sum("payment_value").alias("payment_value"),
                 F.coalesce(mode_low("payment_type"), F.lit("unknown")).alias("payment_type"),
                 F.avg("payment_installments").alias("payment_installments")))


def latest_review_by_order(reviews: DataFrame, placed: bool = False) -> DataFrame:
    """Per order: the score of the latest answered review.

    Reviews are ordered by answer timestamp text with missing timestamps last,
    so a review without an answer time wins; equal keys fall back to the
    review id.
    """
    tiebreak = "review_id" if "review_id" in reviews.columns else "review_answer_timestamp"
    return (_of_orders(reviews, placed)
            .groupBy("order_id")
            .agg(last_non_null_nulls_last("review_score", "review_answer_timestamp", tiebreak)
                 .alias("review_score")))


def product_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with ``category``: English name, else original name, else
    "unknown"; underscores to spaces, title case."""
    tr = translation.select("product_category_name", "product_category_name_english")
    return (products.join(tr, "product_category_name", "left")
            .withColumn("category", title_words(F.coalesce(
                F.col("product_category_name_english"), F.col("product_category_name"),
                F.lit("unknown")))))


def _suffixed(df: DataFrame, taken: set[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in taken})


class SourceWatch:
    """Row counts and key checks that are observed while the master is built,
    in the job that writes it: no count job, no shuffle of their own.

    * Every source: its rows.  Keys of the orders and the dimensions: missing
      values.
    * ``orders``: a second row of one id, numbered along the partitioning by
      order id that the joins need anyway.
    * Dimensions: a left join gives as many rows as went into it unless a key
      that rows refer to is there twice.  (Rows that nothing refers to change
      nothing, so a repeated key among them is no error.)
    """

    #: The keys that the master's joins take to be unique and present, in the order of the joins.
    KEYS = {"orders": "order_id", "category_translation": "product_category_name", "products": "product_id",
            "sellers": "seller_id", "customers": "customer_id"}
    #: What each dimension is joined to, in the master's order.
    JOINS = {"category_translation": "products", "products": "orders", "sellers": "joined products",
             "customers": "joined sellers"}

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def _observe(self, df: DataFrame, name: str, *metrics) -> DataFrame:
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *metrics)

    def source(self, df: DataFrame, name: str) -> DataFrame:
        key = self.KEYS.get(name)
        metrics = [F.count_if(F.col(key).isNull()).alias("missing")] if key else []
        if name == "orders":
            df = df.withColumn("_copy", F.row_number().over(Window.partitionBy(key).orderBy(key)))
            metrics.append(F.max("_copy").alias("copies"))
        out = self._observe(df, name, *metrics)
        return out.drop("_copy") if name == "orders" else out

    def joined(self, df: DataFrame, name: str) -> DataFrame:
        return self._observe(df, f"joined {name}")

    def _get(self, name: str, metric: str) -> int:
        # A part of the plan that turned out empty may have been left out; its
        # row is empty then, which Spark refuses to hand over by an assertion.
        try:
            found = self.seen[name].get or {}
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName() != "java.lang.AssertionError":
                raise
            found = {}
        return found.get(metric) or 0

    def rows(self) -> dict[str, int]:
        """Rows per source; only after the master has been written."""
        return {name: self._get(name, "rows") for name in self.seen if not name.startswith("joined ")}

    def check(self) -> None:
        """Raise ``ValueError`` for a key that is missing or not unique."""
        for name, key in self.KEYS.items():
            wrong = self._get(name, "missing") > 0 or (name == "orders" and self._get(name, "copies") > 1)
            if name in self.JOINS:
                wrong = wrong or self._get(f"joined {name}", "rows") > self._get(self.JOINS[name], "rows")
            if wrong:
                raise ValueError(f"{name}: key {key} is not unique or has missing values")


class _NoWatch:
    def source(self, df: DataFrame, name: str) -> DataFrame:
        return df

    joined = source


def build_master(src: dict[str, DataFrame], watch: SourceWatch | None = None) -> DataFrame:
    """The order master plus delivery metrics.

    Column order: all order columns, customer columns, item, payment and
    review facts, ``category``, ``seller_state``, then the four delivery
    columns.  Row count equals the order count (every right side is unique
    on its key).  An extra column of the orders or customers whose name is
    taken gets the suffix ``_order`` or ``_customer``.  ``watch`` counts and
    checks the sources while the master is evaluated.
    """
    see, placed = watch or _NoWatch(), getattr(src, "placed", ())
    src = {name: see.source(df, name) for name, df in src.items()}
    facts_ = {"item_count", "total_price", "total_freight", "product_id", "seller_id", "payment_value",
              "payment_type", "payment_installments", "review_score", "category", "seller_state"}
    orders = _suffixed(src["orders"], facts_, "_order")
    customers = _suffixed(src["customers"], facts_ | (set(orders.columns) - {"customer_id"}), "_customer")
    items = items_by_order(src["order_items"], "order_items" in placed)
    pays = payments_by_order(src["order_payments"], "order_payments" in placed)
    revs = latest_review_by_order(src["order_reviews"], "order_reviews" in placed)
    # No hints: Spark broadcasts a dimension by its size in bytes and joins by
    # shuffle otherwise (splitting the partition of orders without an item).
    prods = see.joined(product_category(src["products"], src["category_translation"]), "category_translation").select(
        "product_id", "category")
    sellers = src["sellers"].select("seller_id", "seller_state")

    facts = (orders
             .join(items, "order_id", "left")
             .join(pays, "order_id", "left")
             .join(revs, "order_id", "left"))
    facts = see.joined(facts.join(prods, "product_id", "left"), "products")
    facts = see.joined(facts.join(sellers, "seller_id", "left"), "sellers")
    facts = see.joined(facts.join(customers, "customer_id", "left"), "customers")

    cust_cols = [c for c in customers.columns if c != "customer_id"]
    cols = (orders.columns + cust_cols
            + ["item_count", "total_price", "total_freight", "product_id", "seller_id",
               "payment_value", "payment_type", "payment_installments", "review_score",
               "category", "seller_state"])
    return add_delivery_metrics(facts.select(*cols))

"""Views that present the star-schema test tables as the eight logical
retail sources.

The analytics only see the logical sources; this module is the only place
that knows about the test tables.  Money columns carry at most 4 decimals;
the analytics sum them exactly in 1/10,000 units (``money_sum``), so totals
do not depend on the order partitions are merged in.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.semantics import ntz_text, plus_days

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# The category translation of the adapter.  "promo_goods" is
# deliberately left untranslated so that the fallback to the original name
# is exercised.
CATEGORY_TRANSLATION = [
    ("economy_goods", "budget_items"),
    ("large_goods", "large_items"),
    ("medium_goods", "medium_items"),
    ("small_goods", "small_items"),
    ("standard_goods", "standard_items"),
]

# Status and payment-type codes of the adapter.
ORDER_STATUS = {"F": "delivered", "O": "shipped"}        # anything else: "processing"
PAYMENT_TYPE = {"A": "credit_card", "N": "boleto"}       # anything else: "voucher"
ESTIMATE_DAYS = 1200


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in TABLES}


def _code_map(c, mapping: dict[str, str], default: str):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(c) == k, v) if expr is None else expr.when(F.col(c) == k, v))
    return expr.otherwise(default)


def logical_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = read_tables(spark, sf_dir)
    # The nation table is a fixed 25-row reference table of the test schema.
    nation = F.broadcast(t["nation"].select("n_nationkey", "n_name"))
    li = t["lineitem"]

    last_ship = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("order_delivered_customer_date"))
    orders = (t["orders"]
              .join(last_ship, t["orders"]["o_orderkey"] == last_ship["l_orderkey"], "left")
              .select(F.col("o_orderkey").alias("order_id"),
                      F.col("o_custkey").alias("customer_id"),
                      _code_map("o_orderstatus", ORDER_STATUS, "processing").alias("order_status"),
                      F.col("o_orderdate").alias("order_purchase_timestamp"),
                      F.col("order_delivered_customer_date"),
                      plus_days("o_orderdate", ESTIMATE_DAYS).alias("order_estimated_delivery_date")))

    customers = (t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                 .select(F.col("c_custkey").alias("customer_id"),
                         # one person for two customer ids
                         F.expr("c_custkey div 2").alias("customer_unique_id"),
                         F.col("n_name").alias("customer_state")))

    items = li.select(F.col("l_orderkey").alias("order_id"),
                      F.col("l_linenumber").alias("order_item_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.col("l_suppkey").alias("seller_id"),
                      F.col("l_extendedprice").alias("price"),
                      (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"))

    payments = li.select(F.col("l_orderkey").alias("order_id"),
                         _code_map("l_returnflag", PAYMENT_TYPE, "voucher").alias("payment_type"),
                         F.col("l_quantity").alias("payment_installments"),
                         (F.col("l_extendedprice") * (1 - F.col("l_discount")))
                         .alias("payment_value"))

    ev = t["events"]
    reviews = ev.select(F.col("event_id").alias("review_id"),
                        F.expr("event_id div 2").alias("order_id"),
                        (F.pmod(F.floor("value"), F.lit(5)) + 1).cast("int").alias("review_score"),
                        F.when(F.col("event_type") != "error", ntz_text("ts"))
                        .alias("review_answer_timestamp"))

    products = t["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") != 1, F.concat(F.lower("p_type"), F.lit("_goods")))
        .alias("product_category_name"))

    sellers = (t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
               .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")))

    translation = spark.createDataFrame(
        CATEGORY_TRANSLATION, "product_category_name string, product_category_name_english string")

    return {
        "orders": orders, "order_items": items, "customers": customers,
        "order_payments": payments, "order_reviews": reviews, "products": products,
        "sellers": sellers, "category_translation": translation,
    }

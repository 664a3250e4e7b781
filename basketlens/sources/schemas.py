"""Column names and types of the eight logical sources and of the products
(no inference on read).  All lists are fixed values.

Columns are found by the header's names.  Listed ones get their type; further
source columns are read as text, and those of the orders and customers pass
through the order master.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

ORDER_TIMESTAMPS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

# Text schemas for CSV landing: timestamps arrive as text and are parsed with
# a coercing parser afterwards.
CSV_SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", S), T.StructField("customer_id", S),
        T.StructField("order_status", S),
        *[T.StructField(c, S) for c in ORDER_TIMESTAMPS],
    ]),
    "order_items": T.StructType([
        T.StructField("order_id", S), T.StructField("order_item_id", I),
        T.StructField("product_id", S), T.StructField("seller_id", S),
        T.StructField("shipping_limit_date", S),
        T.StructField("price", D), T.StructField("freight_value", D),
    ]),
    "customers": T.StructType([
        T.StructField("customer_id", S), T.StructField("customer_unique_id", S),
        T.StructField("customer_zip_code_prefix", S), T.StructField("customer_city", S),
        T.StructField("customer_state", S),
    ]),
    "order_payments": T.StructType([
        T.StructField("order_id", S), T.StructField("payment_sequential", I),
        T.StructField("payment_type", S), T.StructField("payment_installments", I),
        T.StructField("payment_value", D),
    ]),
    "order_reviews": T.StructType([
        T.StructField("review_id", S), T.StructField("order_id", S),
        T.StructField("review_score", I), T.StructField("review_comment_title", S),
        T.StructField("review_comment_message", S), T.StructField("review_creation_date", S),
        T.StructField("review_answer_timestamp", S),
    ]),
    "products": T.StructType([
        T.StructField("product_id", S), T.StructField("product_category_name", S),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", S), T.StructField("seller_zip_code_prefix", S),
        T.StructField("seller_city", S), T.StructField("seller_state", S),
    ]),
    "category_translation": T.StructType([
        T.StructField("product_category_name", S),
        T.StructField("product_category_name_english", S),
    ]),
}

# CSV cells that mean a missing value, in any column.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Types of the products' columns; ids and names are text in CSV.
_MONEY = T.DecimalType(38, 6)
MASTER_TYPES: dict[str, T.DataType] = {
    **{c: TS for c in ORDER_TIMESTAMPS}, "item_count": T.LongType(), "total_price": _MONEY,
    "total_freight": _MONEY, "payment_value": _MONEY, "payment_installments": D, "review_score": I,
    "delay_days": T.LongType(), "is_late": T.BooleanType(), "is_early": T.BooleanType(),
    "delivery_days_actual": T.LongType(), "order_year": I,
}
RFM_TYPES: dict[str, T.DataType] = {
    "last_order_date": TS, "frequency": T.LongType(), "monetary": _MONEY, "avg_review_score": D,
    "late_pct": D, "avg_delay_days": D, "recency_days": T.LongType(), "R": I, "F": I, "M": I,
    "RFM_total": I, "is_churned": I, "churn_probability": D,
}

# Columns each logical source must provide (types may be narrower/wider:
# ids can be strings or longs, money double or decimal).
REQUIRED: dict[str, list[str]] = {
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price",
                    "freight_value"],
    "customers": ["customer_id", "customer_unique_id", "customer_state"],
    "order_payments": ["order_id", "payment_type", "payment_installments", "payment_value"],
    "order_reviews": ["order_id", "review_score", "review_answer_timestamp"],
    "products": ["product_id", "product_category_name"],
    "sellers": ["seller_id", "seller_state"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}

SOURCES = list(REQUIRED)

# The six churn-model features, in model order.
FEATURES = ["recency_days", "frequency", "monetary", "avg_review_score", "late_pct",
            "avg_delay_days"]

import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from basketlens import build_session, ensure_checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, app_name="basketlens-tests")
    ensure_checkpoint_dir(s)
    yield s


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


ORDER_SCHEMA = ("order_id string, customer_id string, order_status string, "
                "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
                "order_estimated_delivery_date timestamp_ntz")
ITEM_SCHEMA = ("order_id string, order_item_id int, product_id string, seller_id string, "
               "price double, freight_value double")
CUSTOMER_SCHEMA = "customer_id string, customer_unique_id string, customer_state string"
PAYMENT_SCHEMA = "order_id string, payment_type string, payment_installments int, payment_value double"
REVIEW_SCHEMA = "review_id string, order_id string, review_score int, review_answer_timestamp string"
PRODUCT_SCHEMA = "product_id string, product_category_name string"
SELLER_SCHEMA = "seller_id string, seller_state string"
TRANSLATION_SCHEMA = "product_category_name string, product_category_name_english string"


def make_sources(spark, orders, items=(), customers=(), payments=(), reviews=(), products=(),
                 sellers=(), translation=()):
    """The eight logical sources from small literal row lists."""
    mk = spark.createDataFrame
    return {
        "orders": mk(list(orders), ORDER_SCHEMA),
        "order_items": mk(list(items), ITEM_SCHEMA),
        "customers": mk(list(customers), CUSTOMER_SCHEMA),
        "order_payments": mk(list(payments), PAYMENT_SCHEMA),
        "order_reviews": mk(list(reviews), REVIEW_SCHEMA),
        "products": mk(list(products), PRODUCT_SCHEMA),
        "sellers": mk(list(sellers), SELLER_SCHEMA),
        "category_translation": mk(list(translation), TRANSLATION_SCHEMA),
    }

"""Sources in buckets of the order id: the master without a shuffle on it."""

import glob

import pytest
from pyspark.sql import functions as F

from basketlens.operators.master import SourceWatch, build_master
from basketlens.sources.adapter import logical_sources
from basketlens.sources.bucketed import ORDER_GRAIN, _name, land_bucketed, load_bucketed
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landed"))
    land_bucketed(spark, logical_sources(spark, SF_SMALL), base, 6)
    return base


@pytest.fixture
def shuffled_joins(spark):
    """As for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def on_order_id(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(order_id")


def test_no_exchange_on_the_order_id(spark, landed, shuffled_joins):
    plain = build_master({n: spark.read.parquet(f"{landed}/{n}.parquet") for n in load_bucketed(spark, landed)})
    assert on_order_id(plain) >= 4
    assert on_order_id(build_master(load_bucketed(spark, landed))) == 0
    assert on_order_id(build_master(load_bucketed(spark, landed), SourceWatch())) == 0


def test_the_same_master(spark, landed, shuffled_joins):
    a, b = build_master(load_bucketed(spark, landed)), build_master(logical_sources(spark, SF_SMALL))
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_one_file_per_bucket_and_a_new_catalog(spark, landed):
    for name in ORDER_GRAIN:
        assert len(glob.glob(f"{landed}/{name}.parquet/*.parquet")) <= 6
        spark.sql(f"DROP TABLE {_name(landed, name)}")
    again = load_bucketed(spark, landed)
    assert on_order_id(build_master(again).select("order_id", "total_price", "payment_value", "review_score")) == 0
    assert again["orders"].count() == logical_sources(spark, SF_SMALL)["orders"].count()


def test_a_hot_order_is_read_without_buckets(spark, tmp_path, shuffled_joins):
    src = logical_sources(spark, SF_SMALL)
    noise = F.concat(*[F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(4)])
    hot = spark.range(0, 30_000).select(F.lit(1).cast("long").alias("order_id"), F.col("id").cast("int").alias("order_item_id"),
                                        noise.alias("product_id"), F.lit("s").alias("seller_id"),
                                        F.lit(1.0).alias("price"), F.lit(0.5).alias("freight_value"))
    items = src["order_items"].select("order_id", F.col("order_item_id").cast("int"), F.col("product_id").cast("string"),
                                      F.col("seller_id").cast("string"), F.col("price").cast("double"),
                                      F.col("freight_value").cast("double")).unionByName(hot)
    base = str(tmp_path)
    land_bucketed(spark, {**src, "order_items": items}, base, 16)
    sums = lambda df: df.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    spread = load_bucketed(spark, base, most_skew=4)["order_items"]
    assert on_order_id(sums(spread)) == 1 and on_order_id(sums(load_bucketed(spark, base, most_skew=1e9)["order_items"])) == 0
    assert spread.count() == items.count()


def test_types_of_the_key_have_to_agree(spark, tmp_path):
    src = logical_sources(spark, SF_SMALL)
    src["orders"] = src["orders"].withColumn("order_id", F.col("order_id").cast("string"))
    with pytest.raises(ValueError, match="several types"):
        land_bucketed(spark, src, str(tmp_path), 2)

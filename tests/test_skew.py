"""Hot keys: the given tables rewritten so that one customer owns a third of
all orders and one order holds a third of all line items; every checked
dataset must still equal its SQL oracle on those tables."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from check_oracle import digest

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
CHECKED = ["items_by_order", "payments_by_order", "order_master", "rfm_base", "rfm_cutpoints",
           "rfm_scored", "segment_profile", "customer_map_sample", "churn_features",
           "churn_box_fixed", "high_risk_fixed", "state_summary", "state_table", "worst_states",
           "delay_histogram", "sidebar_totals"]


@pytest.fixture(scope="module")
def skewed_dir(spark):
    d = tempfile.mkdtemp(prefix="basketlens-skew-")
    for t in TABLES:
        df = spark.read.parquet(os.path.join(SF_SMALL, f"{t}.parquet"))
        if t == "orders":
            hot = df.agg(F.min("o_custkey")).first()[0]
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(hot))
                               .otherwise(F.col("o_custkey")))
        if t == "lineitem":
            hot = df.agg(F.min("l_orderkey")).first()[0]
            df = df.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(hot))
                               .otherwise(F.col("l_orderkey")))
        df.coalesce(1).write.parquet(os.path.join(d, f"{t}.parquet"))
    return d


@pytest.fixture(scope="module")
def duck(skewed_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM "
                    f"read_parquet('{os.path.join(skewed_dir, t + '.parquet')}/*.parquet')")
    return con


def test_hot_keys_exist(duck):
    top = duck.execute("SELECT max(n) * 1.0 / sum(n) FROM (SELECT count(*) n FROM orders "
                       "GROUP BY o_custkey)").fetchone()[0]
    assert top > 0.3


@pytest.mark.parametrize("name", CHECKED)
def test_skewed_matches_oracle(spark, duck, skewed_dir, name):
    df = E.queries()[name](spark, skewed_dir)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)

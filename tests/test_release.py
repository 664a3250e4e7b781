"""Replacing the products: nothing is seen before a run is whole, months can
be replaced alone, and keys are checked inside the master's own job."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from basketlens.functions.semantics import ntz_month_text
from basketlens.operators.master import SourceWatch, build_master
from basketlens.plans.batch import run_batch
from basketlens.plans.dashboard import Dashboard
from basketlens.sources.adapter import logical_sources
from basketlens.sources.readers import read_master
from basketlens.sources.release import Release, manifest
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    """The logical sources as small tables."""
    d = str(tmp_path_factory.mktemp("sources"))
    out = {}
    for name, df in logical_sources(spark, SF_SMALL).items():
        df.write.parquet(f"{d}/{name}")
        out[name] = spark.read.parquet(f"{d}/{name}")
    return out


@pytest.fixture(scope="module")
def ready(spark, sources, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    run_batch(spark, sources, out)
    return out


def shown(spark, out):
    dash = Dashboard.from_outputs(spark, out)

    def near(row):  # the fit's last digits depend on the order of sums
        return str([round(v, 9) if isinstance(v, float) else v for v in row])

    return {n: sorted(map(near, dash.dataset(n).collect())) for n in ("overview_kpis", "monthly_trend", "segment_profile",
                                                                     "churn_kpis", "coefficients_by_value")}


def changed(sources, month):
    """All orders of a month become late by a year."""
    orders = sources["orders"]
    late = F.col("order_delivered_customer_date") + F.make_dt_interval(F.lit(1500))
    mine = ntz_month_text("order_purchase_timestamp") == month
    return {**sources, "orders": orders.withColumn("order_delivered_customer_date",
                                                   F.when(mine, late).otherwise(F.col("order_delivered_customer_date")))}


def test_a_write_that_dies_halfway_changes_nothing(spark, sources, ready):
    before, said = shown(spark, ready), manifest(spark, ready)
    files = sorted(glob.glob(ready + "/master/version=*/*/*.parquet"))
    # Some tasks have written their files when others fail.
    dies = F.when(F.col("order_id") % 97 == 5, F.raise_error(F.lit("power cut")).cast("string")).otherwise(F.col("order_status"))
    broken = {**sources, "orders": sources["orders"].withColumn("order_status", dies)}
    with pytest.raises(Exception, match="power cut"):
        run_batch(spark, broken, ready)
    assert manifest(spark, ready) == said and shown(spark, ready) == before
    assert set(files) <= set(glob.glob(ready + "/master/version=*/*/*.parquet"))


def test_a_run_that_dies_before_the_end_changes_nothing(spark, sources, ready):
    """The new master is whole, the customer table is not yet written."""
    before = shown(spark, ready)
    half = Release(spark, ready)
    half.write(read_master(spark, ready + "/master").limit(5), "master", partition_by=["order_month"])
    assert half.read("master", spark.read.parquet).count() == 5
    assert shown(spark, ready) == before
    assert len(glob.glob(ready + "/master/version=*")) >= 2


def test_replaced_months(spark, sources, tmp_path):
    out, full = str(tmp_path / "out"), str(tmp_path / "full")
    run_batch(spark, sources, out)
    old = manifest(spark, out)["master"]["folders"]
    month = old[3].partition("order_month=")[2]
    later = changed(sources, month)
    log = run_batch(spark, later, out, months=[month])
    new = manifest(spark, out)["master"]["folders"]
    assert len(set(old) & set(new)) == len(old) - 1 and len(old) == len(new)
    assert 0 < log["source_rows"]["orders"] == log["master_rows"] < sources["orders"].count()
    run_batch(spark, later, full)
    assert shown(spark, out) == shown(spark, full)
    a, b = read_master(spark, out + "/master"), read_master(spark, full + "/master")
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # months still prune
    assert "order_month" in a.where(F.col("order_month") == month)._jdf.queryExecution().toString().split(
        "PartitionFilters: [")[1].split("]")[0]
    # a month that has lost all its orders
    gone = {**sources, "orders": sources["orders"].where(ntz_month_text("order_purchase_timestamp") != month)}
    run_batch(spark, gone, out, months=[month])
    assert read_master(spark, out + "/master").where(F.col("order_month") == month).isEmpty()
    with pytest.raises(ValueError, match="outside the partitions"):
        r = Release(spark, out)
        r.write(a, "master", partition_by=["order_month"], replace=["order_month=" + month])
    with pytest.raises(ValueError, match="replaced in part"):
        Release(spark, str(tmp_path / "none")).write(a, "master", partition_by=["order_month"], replace=["x=1"])


def test_old_versions_go(spark, tmp_path):
    out = str(tmp_path)
    for n in range(4):
        r = Release(spark, out)
        r.write(spark.range(n + 1).withColumn("p", F.col("id") % 2), "t", partition_by=["p"])
        r.write(spark.range(n + 1), "u")
        r.commit()
    for name in "tu":
        assert len(glob.glob(f"{out}/{name}/version=*")) == 2
    with open(out + "/_CURRENT") as f:
        assert set(json.load(f)) == {"t", "u"}
    assert not glob.glob(out + "/_CURRENT.*")
    r = Release(spark, out)
    r.write(spark.range(0).withColumn("p", F.lit(1)), "t", partition_by=["p"])
    assert r.read("t", spark.read.parquet).count() == 0
    r.commit()
    from basketlens.sources.release import product
    assert product(spark, out + "/t", spark.read.parquet).columns == ["id", "p"]
    assert product(spark, out + "/u", spark.read.parquet).count() == 4


@pytest.mark.parametrize("name,key", [("customers", "customer_id"), ("products", "product_id"), ("sellers", "seller_id"),
                                      ("category_translation", "product_category_name")])
def test_repeated_and_missing_dimension_keys(spark, sources, ready, name, key):
    before = manifest(spark, ready)
    twice = {**sources, name: sources[name].union(sources[name])}
    with pytest.raises(ValueError, match=f"{name}: key {key}"):
        run_batch(spark, twice, ready)
    none = sources[name].limit(1).withColumn(key, F.lit(None).cast(sources[name].schema[key].dataType))
    with pytest.raises(ValueError, match=f"{name}: key {key}"):
        run_batch(spark, {**sources, name: sources[name].union(none)}, ready)
    assert manifest(spark, ready) == before


def test_missing_order_id(spark, sources, ready):
    none = sources["orders"].limit(1).withColumn("order_id", F.lit(None).cast("long"))
    with pytest.raises(ValueError, match="orders: key order_id"):
        run_batch(spark, {**sources, "orders": sources["orders"].union(none)}, ready)


def test_repeated_rows_that_nothing_refers_to(spark, sources):
    """They change no order: counted, no error."""
    extra = spark.createDataFrame([(-5, "NOWHERE"), (-5, "NOWHERE")], "seller_id long, seller_state string")
    watch = SourceWatch()
    sellers = sources["sellers"].unionByName(extra)
    build_master({**sources, "sellers": sellers}, watch).write.format("noop").mode("overwrite").save()
    watch.check()
    assert watch.rows() == {n: (sellers if n == "sellers" else df).count() for n, df in sources.items()}


def test_watching_adds_no_shuffle(spark, sources):
    """Joins by shuffle, as for large tables: the same exchanges with the
    checks as without."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def exchanges(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            return plan.count("Exchange hashpartitioning"), plan.count("Exchange ")
        plain, watched = exchanges(build_master(sources)), exchanges(build_master(sources, SourceWatch()))
        assert plain == watched and plain[0] > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""CSV sources, the batch job's sinks and the coefficient reader."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.operators.master import build_master
from basketlens.plans.batch import run_batch
from basketlens.sources.adapter import logical_sources
from basketlens.sources.readers import (MissingInput, load_sources, read_coefficients,
                                        read_master, read_rfm)
from basketlens.sources.schemas import CSV_SCHEMAS, ORDER_TIMESTAMPS
from conftest import SF_SMALL


def _to_csv_frame(df, name):
    cols = []
    for f in CSV_SCHEMAS[name].fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if isinstance(df.schema[f.name].dataType, T.TimestampNTZType):
                c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            cols.append(c.cast("string").alias(f.name))
        elif name == "order_reviews" and f.name == "review_comment_message":
            cols.append(F.lit('line one\nline "two", with comma').alias(f.name))
        else:
            cols.append(F.lit(None).cast("string").alias(f.name))
    return df.select(*cols)


@pytest.fixture(scope="module")
def csv_dir(spark):
    d = tempfile.mkdtemp(prefix="basketlens-csv-")
    for name, df in logical_sources(spark, SF_SMALL).items():
        out = _to_csv_frame(df, name).toPandas()
        out.to_csv(os.path.join(d, f"{name}.csv"), index=False)
    return d


def test_csv_sources_build_the_same_master(spark, csv_dir):
    src = load_sources(spark, csv_dir, "csv")
    assert src["orders"].schema["order_purchase_timestamp"].dataType == T.TimestampNTZType()
    assert src["order_reviews"].count() == logical_sources(spark, SF_SMALL)["order_reviews"].count()
    # ids are text in CSV, so the "first item" tiebreak between equal item
    # numbers compares ids as text; columns derived from it are left out.
    cols = ["order_id", "order_status", "delay_days", "is_late", "review_score",
            "payment_type", "item_count", "customer_state", "delivery_days_actual"]
    a = build_master(src).select(*cols).withColumn("order_id", F.col("order_id").cast("long"))
    b = build_master(logical_sources(spark, SF_SMALL)).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_input_is_reported(spark):
    with pytest.raises(MissingInput):
        load_sources(spark, tempfile.mkdtemp(), "csv")


def test_batch_job_writes_three_products(spark):
    out = tempfile.mkdtemp(prefix="basketlens-out-")
    log = run_batch(spark, logical_sources(spark, SF_SMALL), out)
    master = read_master(spark, os.path.join(out, "master"))
    assert master.count() == log["master_rows"] == log["source_rows"]["orders"]
    assert {"order_month", "order_year"} <= set(master.columns)
    rfm = read_rfm(spark, os.path.join(out, "rfm"))
    assert rfm.count() == log["customers"]
    assert rfm.where(~F.col("churn_probability").between(0, 1)).count() == 0
    coef = read_coefficients(spark, os.path.join(out, "churn_coefficients"))
    assert coef.count() == 6 and set(coef.columns) == {"Feature", "Coefficient", "Impact"}
    assert 0.0 <= log["auc"] <= 1.0


def test_coefficient_reader_tolerates_index_and_headers(spark):
    d = tempfile.mkdtemp(prefix="basketlens-coef-")
    p = os.path.join(d, "coef.csv")
    with open(p, "w") as f:
        f.write("Unnamed: 0, Feature ,Value\n0,Recency Days,1.5\n1,Frequency,-0.2\n")
    coef = read_coefficients(spark, p, fmt="csv")
    assert coef.columns == ["Feature", "Coefficient"]
    assert coef.count() == 2


def test_dashboard_over_batch_outputs(spark):
    from basketlens.operators.filters import Filters
    from basketlens.plans.dashboard import Dashboard
    out = tempfile.mkdtemp(prefix="basketlens-dash-")
    run_batch(spark, logical_sources(spark, SF_SMALL), out, validate=False)
    dash = Dashboard.from_outputs(spark, out)
    names = dash.datasets()
    assert "coefficients_by_value" in names and len(names) >= 36
    for name in names:
        dash.dataset(name).collect()
    kpis = dash.dataset("overview_kpis").first()
    assert kpis.total_orders == dash.master.where("order_status = 'delivered'").count()
    narrow = Dashboard.from_outputs(spark, out, Filters(state="NATION_7", statuses=()))
    assert narrow.dataset("sidebar_totals").first().orders == dash.dataset("sidebar_totals").first().orders
    assert narrow.mdf.count() == dash.master.where("customer_state = 'NATION_7'").count()


def test_unknown_columns_are_kept(spark):
    d = tempfile.mkdtemp(prefix="basketlens-csv-")
    with open(os.path.join(d, "my products.csv"), "w") as f:
        f.write('weight,product_id,a.b,product_category_name\n12,p1,x,toys\n,p2,"y, z",\n')
    from basketlens.sources.readers import read_csv_source
    df = read_csv_source(spark, d, "products", "my products")
    assert df.columns == ["weight", "product_id", "a.b", "product_category_name"]
    assert [tuple(r) for r in df.collect()] == [("12", "p1", "x", "toys"), (None, "p2", "y, z", None)]


def test_batch_and_dashboard_in_csv(spark, csv_dir):
    from basketlens.operators.filters import Filters
    from basketlens.plans.dashboard import Dashboard
    from basketlens.sources.readers import land_csv_sources
    landed = tempfile.mkdtemp(prefix="basketlens-landed-")
    os.rename(os.path.join(csv_dir, "orders.csv"), os.path.join(csv_dir, "the_orders.csv"))
    try:
        land_csv_sources(spark, csv_dir, landed, {"orders": "the_orders.csv"})
    finally:
        os.rename(os.path.join(csv_dir, "the_orders.csv"), os.path.join(csv_dir, "orders.csv"))
    sources = load_sources(spark, landed)
    as_csv, as_parquet = (tempfile.mkdtemp(prefix="basketlens-out-") for _ in range(2))
    log = run_batch(spark, sources, as_csv, "csv")
    assert log == run_batch(spark, sources, as_parquet)
    a, b = Dashboard.from_outputs(spark, as_csv, fmt="csv"), Dashboard.from_outputs(spark, as_parquet)
    assert set(a.datasets()) == set(b.datasets()) and "coefficients_by_value" in a.datasets()

    def shown(df):
        return [tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)
                for r in df.collect()]

    for name in ("overview_kpis", "monthly_trend", "worst_states", "segment_profile_fmt", "churn_box", "high_risk_fmt",
                 "state_table_fmt", "coefficients_by_value", "delay_histogram"):
        assert shown(a.dataset(name)) == shown(b.dataset(name)), name
    nowhere = Dashboard.from_outputs(spark, as_parquet, Filters(state="nowhere"))
    assert a.has_orders() and not nowhere.has_orders()


def test_month_filter_prunes_partitions(spark):
    import contextlib
    import io

    from basketlens.operators.filters import Filters
    from basketlens.plans.dashboard import Dashboard
    out = tempfile.mkdtemp(prefix="basketlens-prune-")
    run_batch(spark, logical_sources(spark, SF_SMALL), out, validate=False)
    # over the master; with the cube that the run has written, the trend does not read it
    dash = Dashboard.from_outputs(spark, out, Filters(months=("1996-01", "1996-06")), cube=None)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        dash.dataset("monthly_trend").explain("formatted")
    filters = [x for x in buf.getvalue().splitlines() if x.startswith("PartitionFilters")]
    assert filters and "order_month" in filters[0] and ">= 1996-01" in filters[0], filters
    assert 0 < dash.dataset("monthly_trend").count() <= 6


def test_keys_are_checked(spark):
    sources = logical_sources(spark, SF_SMALL)
    twice = {**sources, "orders": sources["orders"].union(sources["orders"].limit(1))}
    with pytest.raises(ValueError, match="orders: key order_id"):
        run_batch(spark, twice, tempfile.mkdtemp())
    missing = {**sources, "sellers": sources["sellers"].withColumn(
        "seller_id", F.when(F.col("seller_id") > 1, F.col("seller_id")))}
    with pytest.raises(ValueError, match="sellers: key seller_id"):
        run_batch(spark, missing, tempfile.mkdtemp())


def test_absent_coefficients_are_no_error(spark):
    from basketlens.sources.readers import if_present
    assert if_present(lambda: read_coefficients(spark, tempfile.mkdtemp() + "/none")) is None


def _write_sources(folder, **changed):
    """Eight small CSV files; ``changed`` gives the text of some of them."""
    texts = {
        "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,"
                  "order_estimated_delivery_date\no1,c1,delivered,2017-01-01 10:00:00,2017-01-05 10:00:00,2017-01-09 00:00:00\n",
        "order_items": "order_id,order_item_id,product_id,seller_id,price,freight_value\no1,1,p1,s1,10.5,1\n",
        "customers": "customer_id,customer_unique_id,customer_state\nc1,u1,SP\n",
        "order_payments": "order_id,payment_type,payment_installments,payment_value\no1,boleto,1,11.5\n",
        "order_reviews": "review_id,order_id,review_score,review_comment_message,review_answer_timestamp\nr1,o1,5,,2017-01-06 00:00:00\n",
        "products": "product_id,product_category_name\np1,toys\n", "sellers": "seller_id,seller_state\ns1,RJ\n",
        "category_translation": "product_category_name,product_category_name_english\ntoys,toys\n"}
    for name, text in (texts | changed).items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write(text)


def test_missing_value_texts(spark, tmp_path):
    """Every text that means a missing value, quoted or not, in text and number
    columns; texts that only look like one stay."""
    from basketlens.sources.readers import read_csv_source
    from basketlens.sources.schemas import MISSING_TEXTS
    states = [*MISSING_TEXTS, '"NA"', '""']
    kept = ["na", "Na", "NULLS", " NA", "none", "NONE", "-"]
    _write_sources(tmp_path, customers="customer_id,customer_unique_id,customer_state,note\n" + "".join(
        f"c{i},u{i},{s},{s}\n" for i, s in enumerate(states + kept)))
    rows = {r.customer_id: r for r in read_csv_source(spark, str(tmp_path), "customers").collect()}
    for i, s in enumerate(states + kept):
        want = None if i < len(states) else s
        assert rows[f"c{i}"].customer_state == rows[f"c{i}"].note == want, s


def test_coerced_cells_are_counted_and_kept(spark, tmp_path):
    """Each bad cell is found; missing-value texts are not bad."""
    from basketlens.sources.readers import land_csv_sources
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    _write_sources(
        src,
        orders="order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,"
               "order_estimated_delivery_date\n"
               "o1,c1,delivered,2017-01-01,2017-02-30 10:00:00,2017-01-09 00:00:00\n"
               "o2,c1,delivered,2017-01-01 10:00:00,NA,\no3,c1,shipped,yesterday,,2017-01-09 00:00:00\n",
        order_items="order_id,order_item_id,product_id,seller_id,price,freight_value\n"
                    "o1,one,p1,s1,\"10,5\",1\no2,1,p1,s1,NaN,null\no3,2,p1,s1,3.5,0.5\n",
        order_reviews='review_id,order_id,review_score,review_comment_message,review_answer_timestamp\n'
                      'r1,o1,5,"line one\nNA, ""two""",2017-01-06 00:00:00\nr2,o2,good,,\n')
    log = land_csv_sources(spark, str(src), str(out))
    assert {n: x["coerced"] for n, x in log.items() if x["coerced"]} == {
        "orders": {"order_purchase_timestamp": 2, "order_delivered_customer_date": 1},
        "order_items": {"order_item_id": 1, "price": 1}, "order_reviews": {"review_score": 1}}
    assert {n: x["rows"] for n, x in log.items()} == {
        "orders": 3, "order_items": 3, "customers": 1, "order_payments": 1, "order_reviews": 2, "products": 1,
        "sellers": 1, "category_translation": 1}
    assert sorted(os.listdir(out / "_rejected")) == ["order_items", "order_reviews", "orders"]
    bad = {r.order_id: r for r in spark.read.parquet(str(out / "_rejected" / "orders")).collect()}
    assert set(bad) == {"o1", "o3"}
    assert bad["o1"].bad_columns == ["order_purchase_timestamp", "order_delivered_customer_date"]
    assert bad["o1"].order_delivered_customer_date == "2017-02-30 10:00:00" and bad["o3"].bad_columns == [
        "order_purchase_timestamp"]
    items = spark.read.parquet(str(out / "_rejected" / "order_items")).collect()
    assert [(r.order_item_id, r.price, r.bad_columns) for r in items] == [("one", "10,5", ["order_item_id", "price"])]
    landed = load_sources(spark, str(out))
    assert landed["order_items"].where("price IS NULL").count() == 2
    assert landed["order_reviews"].where("order_id = 'o1'").first().review_comment_message == 'line one\nNA, "two"'

"""The batch job: sources -> order master -> customer RFM table -> churn model,
writing the three data products.

    python -m basketlens.plans.batch --tables /root/testdata/sf0.01 --out OUT
    python -m basketlens.plans.batch --csv SRC_DIR --out OUT [--format csv]
        [--file-names orders=my_orders.csv customers=my_customers.csv ...]

Each product is written before the next step reads it back, so every step
starts from a table (lineage cut, pruned scans).  The products of the run before
stay in use until all new ones are whole (``sources.release``); with ``--months``
only those months of the master are built anew.  CSV sources are
landed as Parquet first.  The master is partitioned by order month, so month
filters prune files; with ``--format csv`` all three products are written as
CSV, and the steps read a Parquet copy of the master in the checkpoint folder.
"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.semantics import ntz_month_text
from basketlens.functions.lineage import checkpoint_root, drop_checkpoints, table_checkpoint
from basketlens.operators.churn import fit_churn
from basketlens.operators.cube import customer_bitmaps, order_cube
from basketlens.operators.delivery import DELIVERED, with_order_period
from basketlens.operators.master import SourceWatch, build_master
from basketlens.operators.rfm import build_rfm
from basketlens.sources.bucketed import land_bucketed, load_bucketed
from basketlens.sources.readers import land_csv_sources, load_sources, read_master, with_period
from basketlens.sources.release import Release
from basketlens.sources.schemas import REQUIRED
from basketlens.sources.sinks import write_table


def run_batch(spark: SparkSession, sources: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
              validate: bool = True, months: list[str] | None = None) -> dict:
    """Write the three products, the cube and the customer bitmaps, and switch readers to them at the end, all at
    once.  Raises ``ValueError`` before that when a source's key is missing or
    repeated.

    ``months``: only these purchase months (``yyyy-MM``) of the master are
    built and replaced, in the products of an earlier run; the customer table
    and the model follow from the whole new master.  ``source_rows`` then
    counts the orders of these months.
    """
    release, watch = Release(spark, out_dir), SourceWatch()
    if months is not None:
        if fmt != "parquet":
            raise ValueError("only the Parquet master has partitions to replace")
        of_months = ntz_month_text("order_purchase_timestamp").isin(list(months))
        sources = {**sources, "orders": sources["orders"].where(of_months)}
    # The master's row count and delivery log, the sources' rows and the checks
    # of their keys are observed while it is written: no pass of their own.
    seen = Observation("master_log")
    dlv = F.col("order_status") == DELIVERED
    metrics = [F.count(F.lit(1)).alias("master_rows"),
               (F.avg(F.when(dlv, (~F.col("is_late")).cast("double"))) * 100.0).alias("on_time_pct"),
               F.avg(F.when(dlv & F.col("is_late"), F.col("delay_days"))).alias("avg_late_delay")]
    built = with_order_period(build_master(sources, watch))
    layout = {"partition_by": ["order_month"], "cluster_by": ["order_id"], "observe": (seen, metrics)}
    if fmt == "parquet":
        release.write(built, "master", **layout,
                      replace=None if months is None else [f"order_month={m}" for m in months])
        master = with_period(release.read("master", spark.read.parquet))
    else:
        copy = f"{checkpoint_root(spark)}/master-{uuid.uuid4().hex}"
        write_table(built, copy, **layout)
        master = read_master(spark, copy)
    log: dict = {"source_rows": watch.rows()}
    if validate:
        watch.check()
    log.update(seen.get)
    if fmt != "parquet":
        release.write(master, "master", fmt)

    rfm = build_rfm(master, keep=lambda df: table_checkpoint(df, "rfm_base"))
    rfm = table_checkpoint(rfm, "rfm")
    log["segments"] = {r.Segment: r["count"] for r in rfm.groupBy("Segment").count().collect()}

    result = fit_churn(rfm)
    # Counted while it is written.
    seen = Observation("rfm_log")
    counts = [F.count(F.lit(1)).alias("customers"),
              (F.avg(F.col("is_churned").cast("double")) * 100.0).alias("churn_rate")]
    release.write(result.scores, "rfm", fmt, observe=(seen, counts))
    release.write(result.coefficients.coalesce(1), "churn_coefficients", fmt)
    log.update(seen.get)
    log["auc"] = result.auc
    # What the order-grain dashboard datasets need of the master.
    release.write(order_cube(master), "cube")
    release.write(customer_bitmaps(master), "customer_bitmaps")
    release.commit()
    return log


def main(argv: list[str] | None = None) -> None:
    from basketlens.session import build_session
    from basketlens.sources.adapter import logical_sources

    ap = argparse.ArgumentParser(description=__doc__)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder of the star-schema test tables")
    src.add_argument("--csv", help="folder with the eight source CSV files")
    src.add_argument("--parquet", help="folder with the eight sources as Parquet")
    src.add_argument("--bucketed", help="folder that an earlier run has landed with --land")
    ap.add_argument("--land", metavar="DIR", help="first land the sources in DIR in buckets of the order id, for this "
                                                  "run and later ones (--bucketed DIR)")
    ap.add_argument("--buckets", type=int, default=200, help="buckets to land (the size of a bucket is a task's)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--file-names", nargs="*", default=[], metavar="SOURCE=FILE",
                    help="CSV files that are not named after their source")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--months", nargs="+", metavar="YYYY-MM",
                    help="replace only these purchase months of the master of an earlier run")
    ap.add_argument("--master", default=None, help="Spark master, e.g. local[8]")
    ap.add_argument("--input-bytes", type=int, default=None,
                    help="total source size; sizes the shuffle partitions on a cluster")
    a = ap.parse_args(argv)

    spark = build_session(a.master, input_bytes=a.input_bytes)
    if a.tables:
        sources = logical_sources(spark, a.tables)
    elif a.csv:
        names = dict(x.split("=", 1) for x in a.file_names)
        if unknown := set(names) - set(REQUIRED):
            ap.error(f"unknown source(s) {sorted(unknown)}; known: {sorted(REQUIRED)}")
        landed = f"{checkpoint_root(spark)}/landed-{uuid.uuid4().hex}"
        coerced = {n: x["coerced"] for n, x in land_csv_sources(spark, a.csv, landed, names).items() if x["coerced"]}
        if coerced:
            # The rows as they stood in the files outlive the landed copies.
            for n in coerced:
                write_table(spark.read.parquet(f"{landed}/_rejected/{n}"), f"{a.out}/rejected/{n}")
            print(json.dumps({"coerced_cells": coerced}, indent=1))
        sources = load_sources(spark, landed, "parquet")
    elif a.bucketed:
        sources = load_bucketed(spark, a.bucketed)
    else:
        sources = load_sources(spark, a.parquet, "parquet")
    if a.land:
        land_bucketed(spark, sources, a.land, a.buckets)
        sources = load_bucketed(spark, a.land)
    print(json.dumps(run_batch(spark, sources, a.out, a.format, months=a.months), default=str, indent=1))
    drop_checkpoints(spark)


if __name__ == "__main__":
    main()

"""Readers for the eight logical sources and the three data products."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.broadcast import row_counts
from basketlens.sources.release import product
from basketlens.sources.schemas import (CSV_SCHEMAS, MASTER_TYPES, MISSING_TEXTS, ORDER_TIMESTAMPS, REQUIRED,
                                        RFM_TYPES)


class MissingInput(RuntimeError):
    """A required file or column is absent; raised before any job runs."""


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingInput(f"{what}: missing column(s) {missing}")
    return df


# ``yyyy-MM-dd HH:mm:ss``: the only accepted timestamp text.
TIMESTAMP_TEXT = r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})$"


def parse_timestamp(c: str | Column) -> Column:
    """Coercing parse to a zone-less timestamp: text that is not exactly
    ``yyyy-MM-dd HH:mm:ss`` (junk, date-only text) or is not a valid time
    (e.g. February 30) becomes NULL instead of failing the job.

    Built from the fields with ``try_make_timestamp_ntz``, so no session time
    zone is involved (a zone round trip would move wall-clock times inside a
    daylight-saving gap).
    """
    col = F.col(c) if isinstance(c, str) else c

    def part(i):
        return F.regexp_extract(col, TIMESTAMP_TEXT, i).cast("int")

    return F.when(col.rlike(TIMESTAMP_TEXT),
                  F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6)))


def _path(base: str, name: str, ext: str) -> str:
    p = os.path.join(base, name if name.endswith(f".{ext}") else f"{name}.{ext}")
    if ":/" not in base and not os.path.exists(p):
        raise MissingInput(f"input not found: {p}")
    return p


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file by its header, all columns as text; cells that say a value is
    missing (``MISSING_TEXTS``) are NULL."""
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", multi_line).csv(path))
    return df.select(*[F.when(~_column(c).isin(MISSING_TEXTS), _column(c)).alias(c) for c in df.columns])


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _typed(name: str, kind: T.DataType) -> Column:
    """A text column in its type; text that does not fit becomes NULL."""
    if isinstance(kind, T.StringType):
        return _column(name)
    if isinstance(kind, T.TimestampNTZType):
        return parse_timestamp(_column(name)).alias(name)
    return _column(name).try_cast(kind).alias(name)


def read_csv_by_header(spark: SparkSession, path: str, types: dict[str, T.DataType],
                       multi_line: bool = False) -> DataFrame:
    """A CSV file by its header: listed columns get their type (text that does
    not fit becomes NULL), all others stay text, missing-value texts are NULL."""
    df = read_csv_text(spark, path, multi_line)
    return df.select(*[c if isinstance(types.get(n, T.StringType()), T.StringType)
                       else c.try_cast(types[n]).alias(n) for n, c in ((n, _column(n)) for n in df.columns)])


def source_types(name: str) -> dict[str, T.DataType]:
    """Column types of a logical source; the orders' timestamps are parsed."""
    types = {f.name: f.dataType for f in CSV_SCHEMAS[name].fields}
    return types | ({c: T.TimestampNTZType() for c in ORDER_TIMESTAMPS} if name == "orders" else {})


def _csv_text(spark: SparkSession, base: str, name: str, file_name: str | None) -> DataFrame:
    df = read_csv_text(spark, _path(base, file_name or name, "csv"), name == "order_reviews")
    return require_columns(df, REQUIRED[name], name)


def read_csv_source(spark: SparkSession, base: str, name: str,
                    file_name: str | None = None) -> DataFrame:
    """One logical source from a CSV file with a header row; columns that the
    analytics do not know are kept as text.

    Quoted fields may hold newlines (review texts), hence ``multiLine``; such
    files are not splittable, so land them to Parquet once with
    :func:`land_csv_sources` and read the Parquet copy afterwards.
    """
    df = _csv_text(spark, base, name, file_name)
    types = source_types(name)
    return df.select(*[_typed(c, types.get(c, T.StringType())) for c in df.columns])


def bad_cells(df: DataFrame, types: dict[str, T.DataType]) -> Column:
    """Of a row of text: the columns whose text does not fit their type."""
    checked = [c for c in df.columns if not isinstance(types.get(c, T.StringType()), T.StringType)]
    return F.filter(F.array(*[F.when(_column(c).isNotNull() & _typed(c, types[c]).isNull(), F.lit(c)) for c in checked],
                            F.lit(None).cast("string")), lambda c: c.isNotNull())


def read_parquet_source(spark: SparkSession, base: str, name: str) -> DataFrame:
    return require_columns(spark.read.parquet(_path(base, name, "parquet")), REQUIRED[name], name)


def load_sources(spark: SparkSession, base: str, fmt: str = "parquet",
                 file_names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All eight logical sources as lazy DataFrames (no job runs here)."""
    file_names = file_names or {}
    if fmt == "csv":
        return {n: read_csv_source(spark, base, n, file_names.get(n)) for n in REQUIRED}
    if fmt == "parquet":
        return {n: read_parquet_source(spark, base, n) for n in REQUIRED}
    raise ValueError(f"unknown source format {fmt!r}")


def land_csv_sources(spark: SparkSession, csv_dir: str, parquet_dir: str,
                     file_names: dict[str, str] | None = None) -> dict[str, dict]:
    """Convert the CSV sources to Parquet once (splittable, columnar,
    predicate pushdown) so that later runs read the Parquet copy.

    Gives, per source, ``rows`` and ``coerced``: how many cells of each column
    did not fit their type and became NULL, observed while the source is
    written.  Sources that have any get a table ``_rejected/NAME`` with the
    rows as they stood in the file and ``bad_columns``.
    """
    log, file_names = {}, file_names or {}
    for name in REQUIRED:
        text, types = _csv_text(spark, csv_dir, name, file_names.get(name)), source_types(name)
        bad = bad_cells(text, types)
        checked = [c for c in text.columns if not isinstance(types.get(c, T.StringType()), T.StringType)]
        seen = Observation(f"landed {name}")
        marked = text.select(*[_typed(c, types.get(c, T.StringType())) for c in text.columns], bad.alias("_bad"))
        counts = [F.count_if(F.array_contains("_bad", c)).alias(f"bad{i}") for i, c in enumerate(checked)]
        (marked.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).drop("_bad")
         .write.mode("overwrite").parquet(os.path.join(parquet_dir, f"{name}.parquet")))
        got = seen.get or {}
        log[name] = {"rows": got.get("rows") or 0,
                     "coerced": {c: got[f"bad{i}"] for i, c in enumerate(checked) if got.get(f"bad{i}")}}
        if log[name]["coerced"]:
            (text.withColumn("bad_columns", bad).where(F.size("bad_columns") > 0)
             .write.mode("overwrite").parquet(os.path.join(parquet_dir, "_rejected", name)))
    return log


def source_counts(sources: dict[str, DataFrame]) -> dict[str, int]:
    """Row count per source (the load log), in one job."""
    return row_counts(sources)


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-read the order master.  The month and year columns are derived only
    where the file has none: a written partition column stays as it is, so
    month filters prune partitions."""
    df = product(spark, path, lambda p: read_csv_by_header(spark, p, MASTER_TYPES) if fmt == "csv"
                 else spark.read.parquet(p))
    require_columns(df, ["order_id", "customer_unique_id", "order_status",
                         "order_purchase_timestamp"], "master")
    return with_period(df)


def with_period(master: DataFrame) -> DataFrame:
    """With the month and year columns, as they are where both are there."""
    from basketlens.operators.delivery import with_order_period
    return master if {"order_month", "order_year"} <= set(master.columns) else with_order_period(master)


def read_rfm(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = product(spark, path, lambda p: read_csv_by_header(spark, p, RFM_TYPES) if fmt == "csv"
                 else spark.read.parquet(p))
    return require_columns(df, ["customer_unique_id", "Segment", "RFM_total"], "rfm")


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its path does not exist (in any store
    that Spark reads)."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_coefficients(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the coefficient table, tolerating an index column and untidy
    headers: drop ``Unnamed*`` columns, strip names, and name a two-column
    file ``Feature, Coefficient``."""
    df = product(spark, path, lambda p: spark.read.option("header", True).option("inferSchema", True).csv(p)
                 if fmt == "csv" else spark.read.parquet(p))
    keep = [c for c in df.columns if not c.startswith("Unnamed") and not c.startswith("_c")]
    df = df.select(*keep).toDF(*[c.strip() for c in keep])
    if "Coefficient" not in df.columns and len(df.columns) == 2:
        df = df.toDF("Feature", "Coefficient")
    return require_columns(df, ["Feature", "Coefficient"], "coefficients")

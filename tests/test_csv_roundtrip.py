"""What the CSV round trip writes."""

import glob
import os

from basketlens.functions.lineage import checkpoint_root
from basketlens.plans.catalog import QUERIES
from basketlens.plans.marts import marts_for
from basketlens.sources.readers import read_csv_text
from basketlens.sources.sinks import write_table
from conftest import SF_SMALL


def test_compressed_csv_reads_back(spark, tmp_path):
    rows = [("a, b", "1"), ('say "x"', "2"), (None, "3")]
    path = str(tmp_path / "t.csv")
    write_table(spark.createDataFrame(rows, "note string, n string"), path, "csv", compression="gzip")
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")
    assert sorted(map(tuple, read_csv_text(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_the_round_trip_is_compressed_and_builds_one_master(spark, tmp_path):
    where = os.path.join(str(tmp_path), "tables")
    os.symlink(SF_SMALL, where)  # a folder of its own: no mart is there yet
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/csv-*"))
    assert QUERIES["csv_roundtrip_master"](spark, where).count() > 0
    written = set(glob.glob(f"{root}/csv-*")) - before
    parts = [p for base in written for p in glob.glob(f"{base}/*.csv/part-*")]
    assert parts and all(p.endswith(".csv.gz") for p in parts)
    assert "master" not in vars(marts_for(spark, where))

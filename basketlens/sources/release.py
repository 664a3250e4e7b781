"""Data products that are replaced as a whole.

A run writes each product into a folder of its own, ``NAME/version=V``, beside
the one in use.  What readers use is named by one small file, ``_CURRENT``,
which is replaced in a single rename after everything has been written and
checked.  A run that dies before that leaves the old products as they were, all
of them from one run; the next run removes what it left.

A partitioned product may be replaced in part: only the partitions named are
written, and ``_CURRENT`` then lists, partition by partition, which version's
folder holds it.

There is one writer per folder at a time.  The versions of the run before stay
until the next one, for readers that have opened them.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basketlens.sources.sinks import write_table

POINTER = "_CURRENT"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    at = _path(spark, path)
    fs = _fs(spark, at)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in place in one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fresh, at = _path(spark, f"{path}.{time.time_ns()}"), _path(spark, path)
    fs = _fs(spark, fresh)
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(fresh), fs.makeQualified(at), how)


def sizes_of(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the data files in a folder."""
    at = _path(spark, path)
    return [s.getLen() for s in _fs(spark, at).listStatus(at) if not s.getPath().getName().startswith(("_", "."))]


def manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """What ``_CURRENT`` says: per product its format, schema and folders.  None
    where no run has been finished."""
    text = read_text(spark, f"{out_dir.rstrip('/')}/{POINTER}")
    return None if text is None else json.loads(text)


def product(spark: SparkSession, path: str, read) -> DataFrame:
    """The product ``path`` = folder/NAME as ``_CURRENT`` in the folder names
    it.  ``read`` takes the folders of a product without partitions.  A folder
    without ``_CURRENT``, or one that does not name the product, is read as
    it is."""
    out_dir, name = path.rstrip("/").rpartition("/")[::2]
    known = (manifest(spark, out_dir) or {}).get(name) if out_dir else None
    return read(path) if known is None else _read(spark, path.rstrip("/"), known, read)


def _read(spark: SparkSession, path: str, known: dict, read) -> DataFrame:
    folders = [f"{path}/{x}" for x in known["folders"]]
    if not known["partitioned"]:
        return read(folders[0])
    if not folders:
        return spark.createDataFrame([], T.StructType.fromJson(known["schema"]))
    return spark.read.option("basePath", path).parquet(*folders).drop("version")


class Release:
    """One run's products in ``out_dir``; nothing is seen before ``commit``."""

    def __init__(self, spark: SparkSession, out_dir: str) -> None:
        self.spark, self.out_dir = spark, out_dir.rstrip("/")
        self.before = manifest(spark, self.out_dir) or {}
        self.now = dict(self.before)
        self.version = time.time_ns() // 1000

    def write(self, df: DataFrame, name: str, fmt: str = "parquet", partition_by: list[str] | None = None,
              cluster_by: list[str] | None = None, observe=None, replace: list[str] | None = None) -> None:
        """Write a product beside the one in use.  ``replace`` names the only
        partitions to be replaced (``column=value``); ``df`` holds their new
        rows and no others.  One without rows goes."""
        folder = f"version={self.version}"
        write_table(df, f"{self.out_dir}/{name}/{folder}", fmt, partition_by, cluster_by, observe)
        folders = [folder]
        if partition_by:
            folders = [f"{folder}/{p}" for p in self._partitions(name, folder)]
        if replace is not None:
            old = self.before.get(name)
            if not partition_by or old is None or not old["partitioned"]:
                raise ValueError(f"{name}: only a partitioned product can be replaced in part")
            new = {x.partition("/")[2] for x in folders}
            if new - set(replace):
                raise ValueError(f"{name}: rows outside the partitions to replace: {sorted(new - set(replace))}")
            folders += [x for x in old["folders"] if x.partition("/")[2] not in replace]
        self.now[name] = {"format": fmt, "partitioned": bool(partition_by), "folders": sorted(folders),
                          "schema": json.loads(df.schema.json())}

    def _partitions(self, name: str, folder: str) -> list[str]:
        """Folders of the (first) partition column: few, by the choice of it."""
        at = _path(self.spark, self.out_dir, name, folder)
        return sorted(s.getPath().getName() for s in _fs(self.spark, at).listStatus(at) if s.isDirectory())

    def read(self, name: str, read) -> DataFrame:
        """A product of this run, before the commit too."""
        return _read(self.spark, f"{self.out_dir}/{name}", self.now[name], read)

    def commit(self) -> None:
        """Switch readers to this run's products in one rename, then remove
        versions that neither this run nor the one before uses."""
        write_text(self.spark, f"{self.out_dir}/{POINTER}", json.dumps(self.now, indent=1))
        self._remove_unused(_fs(self.spark, _path(self.spark, self.out_dir)))

    def _remove_unused(self, fs) -> None:
        for name in self.now:
            used = {x.partition("/")[0] for m in (self.now, self.before) if name in m for x in m[name]["folders"]}
            at = _path(self.spark, self.out_dir, name)
            for s in fs.listStatus(at) if fs.exists(at) else []:
                folder = s.getPath().getName()
                if folder.startswith("version=") and folder not in used and int(folder[8:]) < self.version:
                    fs.delete(s.getPath(), True)

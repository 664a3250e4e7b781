"""The stratified split against a plain ranking, on skewed and tiny classes."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from basketlens.functions import stratified
from basketlens.functions.stratified import stratified_split


def plain_sizes(counts, up=1, down=5):
    n = sum(counts.values())
    want = -(-n * up // down)
    sizes = {c: want * k // n for c, k in counts.items()}
    rest = sorted(counts, key=lambda c: (-(want * counts[c] % n), c))
    for c in rest[:want - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def plain(rows):
    """Ids of the test rows."""
    by_class = {}
    for i, c in rows:
        if c is not None:
            by_class.setdefault(c, []).append(hashlib.md5(str(i).encode()).hexdigest() + f" {i}")
    sizes = plain_sizes({c: len(v) for c, v in by_class.items()})
    return {int(x.split()[1]) for c, v in by_class.items() for x in sorted(v)[:sizes[c]]}


def got(rows, df, **kw):
    split = stratified_split(df, "label", "id", **kw)
    return {r.id for r in df.where(split.is_test()).collect()}, split


CASES = {"hot class": [(i, 0 if i % 50 else 1) for i in range(7000)],
         "three classes": [(i, "abc"[min(2, i % 7)]) for i in range(5000)],
         "tiny": [(1, 0), (2, 0), (3, 1)], "one class": [(i, 7) for i in range(11)],
         "one row": [(5, 1)], "nulls": [(i, [0, None, 1][i % 3]) for i in range(100)]}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("width,bound", [(4, 10_000), (1, 3)])
def test_against_plain(spark, name, width, bound):
    """In one pass, and by narrow prefixes with many passes."""
    rows = CASES[name]
    kind = "string" if name == "three classes" else "int"
    df = spark.createDataFrame(rows, f"id long, label {kind}").repartition(5)
    ids, _ = got(rows, df, width=width, bound=bound)
    assert ids == plain(rows)


def test_sizes_are_exact(spark):
    """ceil(n / 5) rows in all, within one of a fifth of every class."""
    df = spark.range(0, 10_007).select("id", (F.col("id") % 13 == 0).cast("int").alias("label"))
    split = stratified_split(df, "label", "id")
    sizes = {(r.label, r.t): r.n for r in df.groupBy("label", split.is_test().alias("t")).agg(F.count("id").alias("n")).collect()}
    assert sizes[0, True] + sizes[1, True] == math.ceil(10_007 / 5)
    for c in (0, 1):
        n = sizes[c, True] + sizes[c, False]
        assert abs(sizes[c, True] - n / 5) < 1


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "id long, label int")
    assert stratified_split(none, "label", "id").bounds == ()
    same = spark.createDataFrame([(1, 0)] * 40, "id long, label int")
    split = stratified_split(same, "label", "id", bound=3)
    assert {r.t for r in same.select(split.is_test().alias("t")).collect()} == {True}


def test_no_sort_of_all_rows(spark, monkeypatch):
    """What is ranked is one prefix of the digests, not the class."""
    seen = []
    inside = stratified._inside

    def watched(keyed, found):
        seen.append({c: r["n"] for c, r in found.items()})
        return inside(keyed, found)

    monkeypatch.setattr(stratified, "_inside", watched)
    df = spark.range(0, 40_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    stratified_split(df, "label", "id", width=2, bound=500)
    assert seen and all(n <= 500 for n in seen[-1].values())

"""An exact stratified split by distributed selection.

A row is a test row if its id's digest is among the smallest of its class: the
k-th smallest digest of the class is the class's bound, and the test rows are
those at or below it.  The number k of each class is that of a stratified
split: ``ceil(share * n)`` test rows in all, dealt over the classes in
proportion, the rows that are left going to the classes with the largest
remainders (ties: the smaller label).

The bound is found without sorting the rows.  The digests' first ``WIDTH``
hexadecimal digits are counted per class (map-side, at most 16^WIDTH rows); the
prefix that holds the k-th digest is the only one looked at further, with
``WIDTH`` more digits, until it holds at most ``BOUND`` rows, which are ranked.
A billion rows take three passes.  What reaches the driver is one row per
class and pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.broadcast import one_row

WIDTH = 4
BOUND = 10_000
MOST_CLASSES = 1_000


@dataclass(frozen=True)
class Split:
    """Per class the largest digest of a test row (no entry: no test row)."""

    label: str
    id_col: str
    bounds: tuple[tuple[object, str], ...]

    def is_test(self) -> Column:
        """Whether a row is a test row; false for rows of no known class."""
        digest = F.md5(F.col(self.id_col).cast("string"))
        found = F.lit(False)
        for value, bound in self.bounds:
            found = F.when(F.col(self.label) == F.lit(value), digest <= F.lit(bound)).otherwise(found)
        return F.coalesce(found, F.lit(False))


def test_sizes(counts: DataFrame, label: str, share: tuple[int, int]) -> DataFrame:
    """``(label, k)``: the test rows of each class, from ``(label, n)``."""
    up, down = share
    total = counts.agg(F.sum("n").alias("_all"))
    want = F.expr(f"(_all * {up} + {down - 1}) div {down}")  # ceil, in integers
    dealt = (counts.crossJoin(one_row(total)).withColumn("_want", want)
             .withColumn("_base", F.expr("(_want * n) div _all"))
             .withColumn("_rest", F.expr("(_want * n) % _all")))
    # One row per class, which the caller bounds.
    every = Window.partitionBy(F.lit(0))
    by_rest = every.orderBy(F.desc("_rest"), F.col(label))
    left = F.col("_want") - F.sum("_base").over(every)
    return dealt.select(label, (F.col("_base") + (F.row_number().over(by_rest) <= left).cast("long")).alias("k"))


def stratified_split(rows: DataFrame, label: str, id_col: str, share: tuple[int, int] = (1, 5),
                     width: int = WIDTH, bound: int = BOUND) -> Split:
    """The split of ``rows`` (ids unique, labels not null) with ``share`` =
    numerator and denominator of the test share.  Runs one job per pass.
    Equal ids are on one side; a table with repeated ids may so have more test
    rows than its share."""
    keyed = rows.where(F.col(label).isNotNull()).select(
        F.col(label).alias("c"), F.md5(F.col(id_col).cast("string")).alias("d"))
    counts = keyed.groupBy("c", F.substring("d", 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sizes = test_sizes(counts.groupBy("c").agg(F.sum("n").alias("n")), "c", share)
    found = {r["c"]: r for r in _holding(counts.join(F.broadcast(sizes), "c")).limit(MOST_CLASSES + 1).collect()}
    if len(found) > MOST_CLASSES:
        raise ValueError(f"stratified split: more than {MOST_CLASSES} classes")
    digits, bounds = width, {}
    while found:
        small = {c: r for c, r in found.items() if r["n"] <= bound or digits >= 32}
        large = {c: r for c, r in found.items() if c not in small}
        if small:
            ranked = _inside(keyed, small).withColumn(
                "r", F.row_number().over(Window.partitionBy("c").orderBy("d")))  # at most ``bound`` rows a class
            bounds |= {r["c"]: r["d"] for r in ranked.where(F.col("r") == F.col("k")).select("c", "d").collect()}
        if not large:
            break
        digits = min(32, digits + width)
        finer = (_inside(keyed, large).groupBy("c", "k", F.substring("d", 1, digits).alias("p"))
                 .agg(F.count(F.lit(1)).alias("n")))
        found = {r["c"]: r for r in _holding(finer).collect()}
    return Split(label, id_col, tuple(sorted(bounds.items(), key=lambda x: str(x[0]))))


def _holding(counts: DataFrame) -> DataFrame:
    """Per class the prefix with its k-th digest, its rows, and the rank left
    inside it.  At most 16^WIDTH rows a class are ordered."""
    w = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("_end", F.sum("n").over(w)).withColumn("_start", F.col("_end") - F.col("n"))
    return (run.where((F.col("_start") < F.col("k")) & (F.col("k") <= F.col("_end")))
            .select("c", "p", "n", (F.col("k") - F.col("_start")).alias("k")))


def _inside(keyed: DataFrame, found: dict) -> DataFrame:
    """The rows of each class under its prefix, with the rank wanted there."""
    here, rank = F.lit(False), F.lit(None).cast("long")
    for value, r in found.items():
        mine = F.col("c") == F.lit(value)
        here = here | (mine & F.col("d").startswith(r["p"]))
        rank = F.when(mine, F.lit(r["k"])).otherwise(rank)
    return keyed.where(here).withColumn("k", rank.cast("long"))

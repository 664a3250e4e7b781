"""Uniform sharding by a hypergeometric communication matrix, in DataFrame
operations only.

A uniform random shuffle of a table into shards of exact sizes, by parts:

1. The rows fall into source parts by a hash of all their columns.  The parts'
   sizes (one number per part) go to the driver.
2. The driver draws how many rows of each part go to each shard.  In a uniform
   random assignment these counts follow the multivariate hypergeometric
   distribution with the parts' sizes and the shards' sizes as margins, and so
   they are drawn, exactly, from a seed.  Shard sizes differ by one at most.
3. Every part is permuted locally (ordered by a keyed hash) and cut into the
   drawn counts: the rows of each cut know their shard.
4. The rows are exchanged to their shards and permuted again by a second keyed
   hash, which gives the slot.

Parts and shards are permuted in cells: the hash's top picks the cell, the
cells' sizes give each cell its first place, and a cell is ordered by itself, so
no task orders a whole part or shard.  So the parts need not grow in number with
the table: parts times shards, what the driver draws and the plan holds, is
``MATRIX`` at the most, at any size of table and cluster.

Everything follows from the rows' contents and the seed, never from where rows
happen to lie, so a repeated task gives the same result.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import quoted, without

SHARDS = 40
SEED = 20240607
CELLS = 8            # of a shard, at the least
CELL_ROWS = 1 << 20  # rows of a cell, about: larger parts and shards have more cells
MATRIX = 1 << 16     # numbers of the communication matrix (but one part at the least)


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(k: int, mean: float) -> float:
    """k log(k / mean) + mean - k, without cancellation near the mean."""
    if abs(k - mean) < 0.1 * (k + mean):
        v = (k - mean) / (k + mean)
        total, term, j = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            nxt = total + term / (2 * j + 1)
            if nxt == total:
                return total
            total, j = nxt, j + 1
    return k * math.log(k / mean) + mean - k


def binomial(k: int, n: int, p: float, q: float) -> float:
    """Probability of k hits in n draws, to about double precision at any
    size: the large parts of the factorials cancel in the formula, not in the
    arithmetic."""
    if k in (0, n):
        return math.exp(n * (math.log1p(-p) if k == 0 else math.log1p(-q)) if p < 1 and q < 1 else
                        (0.0 if (p >= 1) == (k == n) else -math.inf))
    log = (_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
           - _deviance(k, n * p) - _deviance(n - k, n * q))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``draws`` draws without replacement from ``total`` items hit
    one of ``good`` of them.  Inversion outwards from the mode: the expected
    number of steps is about the standard deviation, at any size."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p, q = draws / total, (total - draws) / total
    top = binomial(mode, good, p, q) * binomial(draws - mode, total - good, p, q) / binomial(draws, total, p, q)
    u = rng.random() - top
    if u < 0:
        return mode
    left, right, p_left, p_right = mode, mode, top, top
    while left > low or right < high:
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (total - good - draws + right + 1))
            right += 1
            u -= p_right
            if u < 0:
                return right
        if left > low:
            p_left *= left * (total - good - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u < 0:
                return left
    return mode  # the probabilities' rounding error was drawn


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts per part and shard whose sums over shards are ``parts`` and over
    parts ``shards``, drawn as a uniform assignment has them."""
    rng = random.Random(seed)
    left = list(shards)
    matrix = []
    for size in parts:
        total, row = sum(left), []
        for k, room in enumerate(left):
            take = hypergeometric(rng, room, total, size)
            row.append(take)
            total -= room
            size -= take
            left[k] -= take
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _keyed(seed: int, salt: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{seed}/{salt}"), *columns)


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, parts: int | None = None,
               cells: int | None = None, part_cells: int | None = None) -> DataFrame:
    """The rows of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, from
    0, gapless in the shard): uniform over all assignments with shard sizes
    that differ by one at most.

    ``parts``: number of source parts, by default four per shuffle partition as
    far as ``MATRIX`` allows.  ``cells``: cells that a shard is permuted in, by
    default as many as keep them at about ``CELL_ROWS`` rows; ``part_cells``:
    the same of a part.
    Rows are told apart by all their columns; rows that agree in all of them
    are interchangeable and still get places of their own.  Nulls are values
    like others.  An input column named like an output one is replaced.  An
    empty table gives an empty result, and shards may be empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = df.sparkSession
    parts = parts or max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MATRIX // shards))
    kept = without(df, "shard", "slot")
    values = [F.to_json(F.struct(quoted(c))) if _nested(df, c) else quoted(c) for c in df.columns]
    rows = df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"),
                     *[_keyed(seed, k, values).alias(f"h{k}") for k in range(2)])
    part = F.pmod("h0", F.lit(parts)).cast("int")
    rows = rows.withColumn("part", part)

    found = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbers = sorted(found)
    total = sum(found.values())
    cells = cells or max(CELLS, -(-total // (shards * CELL_ROWS)))
    part_cells = part_cells or max(1, -(-total // (parts * CELL_ROWS)))
    matrix = communication_matrix([found[p] for p in numbers], shard_sizes(total, shards), seed)
    # One row per part: the last local position of each shard.  The table holds
    # parts x shards numbers, which bounds what a broadcast of it moves.
    text = json.dumps([{"part": p, "ends": list(accumulate(row))} for p, row in zip(numbers, matrix)])
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<part:int,ends:array<long>>>")))

    # Permute locally, cut.  A part's number fixes the residue of h0, so the
    # order by the whole hash is as random as the hash.
    keyed = rows.withColumn("key", _keyed(seed, 2, [F.col("h0"), F.col("h1")]))
    cut = _places(keyed, "part", part_cells, ["key", "h1"]).join(ends, "part")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    placed = cut.select("row", shard.alias("shard"), _keyed(seed, 3, [F.col("h0"), F.col("h1")]).alias("key"))

    # Exchange, permute again.
    ordered = _places(placed, "shard", cells, ["key"])
    return ordered.select(*[F.col("row")[c].alias(c) for c in kept], "shard", F.col("place").alias("slot"))


def _places(rows: DataFrame, group: str, cells: int, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (long, from 0, gapless): their order by ``key``'s
    cell, then ``order``, in their group."""
    rows = rows.withColumn("cell", F.pmod(F.shiftright("key", 32), F.lit(cells)).cast("int"))
    own = (F.row_number().over(Window.partitionBy(group, "cell").orderBy(*order)) - 1).cast("long")
    if cells == 1:
        return rows.withColumn("place", own)
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy(group, "cell").agg(F.count(F.lit(1)).alias("n"))
             .select(group, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return rows.withColumn("own", own).join(first, [group, "cell"]).withColumn("place", F.col("first") + F.col("own"))


def _nested(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()

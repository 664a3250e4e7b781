import math
import contextlib
import io
import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from basketlens.llm import sharding
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents


@pytest.mark.parametrize("good,total,draws", [(7, 20, 6), (1, 50, 25), (19, 20, 6), (30, 60, 30)])
def test_hypergeometric(good, total, draws):
    rng, n = random.Random(1), 30000
    got = Counter(sharding.hypergeometric(rng, good, total, draws) for _ in range(n))
    chi = 0.0
    for k in range(max(0, draws - total + good), min(good, draws) + 1):
        want = n * comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
        if want > 5:
            chi += (got[k] - want) ** 2 / want
    assert chi < 40
    assert sharding.hypergeometric(rng, 10 ** 9, 3 * 10 ** 10, 10 ** 9) == pytest.approx(10 ** 9 / 30, rel=1e-3)


def test_matrix_margins():
    parts, shards = [5, 0, 17, 100, 3], sharding.shard_sizes(125, 7)
    m = sharding.communication_matrix(parts, shards, 3)
    assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == shards
    assert m == sharding.communication_matrix(parts, shards, 3) != sharding.communication_matrix(parts, shards, 4)


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    n = len(rows)
    assert sorted(sizes.get(k, 0) for k in range(shards)) == sorted(sharding.shard_sizes(n, shards))
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_exact_sizes_and_repeatable(spark):
    docs = table(spark, SF, "documents")
    a = sharding.shard_rows(docs, 40, parts=11).collect()
    check(a, 40)
    assert sorted(r.doc_id for r in a) == sorted(r.doc_id for r in docs.collect())
    b = sharding.shard_rows(docs.repartition(7), 40, parts=11).collect()  # where rows lie does not matter
    key = lambda rows: {r.doc_id: (r.shard, r.slot) for r in rows}
    assert key(a) == key(b) != key(sharding.shard_rows(docs, 40, seed=1, parts=11).collect())


def test_uniform(spark):
    """Over many seeds every row falls into each shard and slot alike."""
    rows = documents(spark, [(k, "t") for k in range(6)]).cache()
    got = Counter()
    for seed in range(60):
        for r in sharding.shard_rows(rows, 2, seed=seed, parts=2, cells=2, part_cells=2).collect():
            got[r.doc_id, r.shard, r.slot] += 1
    chi = sum((got[i, s, p] - 10) ** 2 / 10 for i in range(6) for s in range(2) for p in range(3))
    assert chi < 65  # 25 degrees of freedom


def test_edges(spark):
    docs = documents(spark, EDGES + [(5, "one")] * 30)
    got = sharding.shard_rows(docs, 4).collect()
    check(got, 4)
    assert len(got) == len(EDGES) + 30
    assert sharding.shard_rows(documents(spark, []), 4).count() == 0
    check(sharding.shard_rows(documents(spark, [(1, "a")]), 40).collect(), 40)
    clash = docs.withColumnRenamed("source", "Shard")
    assert sharding.shard_rows(clash, 4).columns == [c for c in clash.columns if c != "Shard"] + ["shard", "slot"]


def test_plan_is_native(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        sharding.shard_rows(table(spark, SF, "documents")).explain("formatted")
    assert "Python" not in buf.getvalue() and "Pandas" not in buf.getvalue() and "Arrow" not in buf.getvalue()


def test_binomial_at_any_size():
    """Against exact fractions, and against sums of logarithms where they are
    too large."""
    from fractions import Fraction
    for n, hits, draws, total in ((5, 2, 3, 10), (40, 13, 100, 300), (900, 450, 1, 2), (700, 10, 999, 70_000)):
        p = Fraction(draws, total)
        want = Fraction(math.comb(n, hits)) * p ** hits * (1 - p) ** (n - hits)
        assert sharding.binomial(hits, n, float(p), float(1 - p)) == pytest.approx(float(want), rel=1e-12)
    # Near the mode of 10^15 draws: neighbours' ratio is (n - k) p / ((k + 1) q).
    n, k, p = 10 ** 15, 25 * 10 ** 13 + 12345, 0.25
    a, b = (sharding.binomial(x, n, p, 1 - p) for x in (k, k + 1))
    assert b / a == pytest.approx((n - k) * p / ((k + 1) * (1 - p)), rel=1e-9)
    assert a == pytest.approx(1 / math.sqrt(2 * math.pi * n * p * (1 - p)) * math.exp(-12345 ** 2 / (2 * n * p * (1 - p))), rel=1e-6)


def test_draws_from_very_many_rows():
    """10^13 rows: the draws' mean and deviation."""
    rng = random.Random(2)
    good, total, draws = 10 ** 13 // 40, 10 ** 13, 6 * 10 ** 7
    mean = draws * good / total
    deviation = math.sqrt(mean * (1 - good / total))
    found = [sharding.hypergeometric(rng, good, total, draws) for _ in range(300)]
    assert abs(sum(found) / 300 - mean) < 5 * deviation / math.sqrt(300)
    assert 0.8 < math.sqrt(sum((x - mean) ** 2 for x in found) / 300) / deviation < 1.2


def test_cells_follow_the_counts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 40)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    placed = sharding.shard_rows(rows, shards=3)
    got = {r.shard: r for r in placed.groupBy("shard").agg(F.count("slot").alias("n"), F.countDistinct("slot").alias("d"),
                                                           F.max("slot").alias("top")).collect()}
    assert sorted(r.n for r in got.values()) == [1333, 1333, 1334]
    assert all(r.n == r.d == r.top + 1 for r in got.values())


def test_matrix_is_bounded_and_parts_go_in_cells(spark, monkeypatch):
    """However many parts are asked for by the cluster, the matrix has
    ``MATRIX`` numbers at the most, and a part is ordered cell by cell."""
    drawn = []
    real = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda *a: drawn.append(real(*a)) or drawn[-1])
    monkeypatch.setattr(sharding, "MATRIX", 24)
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_rows(rows, shards=8).collect()
    check(got, 8)
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert sum(map(len, drawn[0])) <= 24
    # Neighbours in a shard are strangers in the table.
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) < 10 for a, b in zip(order, order[1:])) < 60

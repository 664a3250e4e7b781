import random

import pytest
import xxhash

from basketlens.llm import simhash
from basketlens.llm.common import table
from basketlens.llm.components import components
from .helpers import EDGES, SF, documents, prose, words


def plain(text):
    ws = words(text)
    if not ws:
        return 0
    k = min(3, len(ws))
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + k]), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_groups(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    ids = sorted(want)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (want[a] ^ want[b]).bit_count() <= 2]
    groups = union_find(pairs, ids)
    got = simhash.near_duplicate_groups(docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == groups
    assert any(k != v for k, v in groups.items())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(groups.values())


@pytest.mark.parametrize("longest,bits,batch", [(32, 2, 10000), (2, 2, 3), (3, 2, 7), (5, 1, 4), (2, 0, 3)])
def test_links_connect_all_near_pairs(spark, longest, bits, batch):
    rng = random.Random(longest * 10 + bits)
    points = set()
    for _ in range(6):  # dense clusters: many share a segment
        centre = rng.getrandbits(64)
        points |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(40)}
    points |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = [(r.a, r.b) for r in simhash.links(fps, bits, longest).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= bits for a, b in found)
    near = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1:] if ((a ^ b) & mask).bit_count() <= bits]
    assert union_find(found, signed) == union_find(near, signed)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1090)]
    nodes = sorted({x for e in edges for x in e})
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(edges, nodes)
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(documents(spark, EDGES)).collect()}
    # no words: fingerprint 0, one group; equal texts one group; a null id names none with an id
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)} <= got
    kept = sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(documents(spark, EDGES)).collect())
    assert kept == ["1", "4", "6", "7", "8", "9", "None"]
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0


def test_one_group_of_a_third(spark):
    rng = random.Random(4)
    base = prose(rng, 200, 5000).split()
    rows = [(k, " ".join(base)) for k in range(60)]
    rows += [(100 + k, " ".join(base[:k] + ["new"] + base[k + 1:])) for k in range(60)]
    rows += [(300 + k, prose(rng, 80, 5000)) for k in range(60)]
    docs = documents(spark, rows)
    want = {i: plain(t) for i, t in rows}
    ids = sorted(want)
    groups = union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
                         if (want[a] ^ want[b]).bit_count() <= 2], ids)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()} == groups

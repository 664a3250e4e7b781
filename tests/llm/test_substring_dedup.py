import hashlib
import random

import pytest

from basketlens.llm import substring_dedup
from .helpers import EDGES, documents


def plain(rows, window=20):
    """Kept words per row of ``(id, text)``, ids unique and not null."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        ws = (text or "").encode().split()
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out[i] = (len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode())
    return out


def corpus(seed, docs=60, alphabet=300):
    """Documents that share passages of all lengths, cut at any place, with
    copies, self-repeats and near copies."""
    rng = random.Random(seed)
    new = lambda n: [f"v{rng.randrange(alphabet)}" for _ in range(n)]
    pool = [new(rng.randrange(15, 140)) for _ in range(8)]
    rows = []
    for i in range(docs):
        ws = new(rng.randrange(0, 60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            ws += p[a:a + rng.randrange(1, len(p) + 1)] + new(rng.randrange(3))
        if rng.random() < 0.2:
            ws += ["same"] * rng.randrange(70)
        if rows and rng.random() < 0.2:
            ws = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(3)):
                if ws:
                    ws[rng.randrange(len(ws))] = "changed"
        rows.append((i, " ".join(ws)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,window,anchor", [(1, 10000, 20, 8), (2, 5, 20, 8), (3, 3, 20, 8), (4, 4, 6, 3), (5, 2, 20, 20)])
def test_against_plain(spark, seed, batch, window, anchor):
    rows = corpus(seed, alphabet=300 if seed != 4 else 6)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: r for r in substring_dedup.dedup_substrings(documents(spark, rows, 5), window, anchor).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain(rows, window)
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == want
    assert sum(n for _, n, _ in want.values()) > 500
    texts = {i: t.split() for i, t in rows}
    for i, r in got.items():
        covered = set()
        for f in r.factors:  # a factor's words stand at its source, which starts earlier
            assert texts[i][f.start:f.start + f.words] == texts[f.source][f.source_start:f.source_start + f.words]
            assert f.words >= window and (f.source, f.source_start) < (i, f.start)
            covered |= set(range(f.start, f.start + f.words))
        assert len(covered) == r.n_removed


def test_edges(spark):
    rows = [(i, t) for i, t in EDGES if i not in (5, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in
           substring_dedup.dedup_substrings(documents(spark, rows)).collect()}
    assert got == plain(rows)
    assert got[8][1] == 20000 - 20 + 20 - 1 or got[8][1] == 19999
    assert substring_dedup.dedup_substrings(documents(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(40))
    other = " ".join(f"u{k}" for k in range(40))
    rows = [(None, text), (7, text), (7, text), (8, other), (8, other + " more"), (9, other)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in
                 substring_dedup.dedup_substrings(documents(spark, rows)).collect())
    # a null id comes first; equal ids hold equal places, so neither makes the other go
    assert got == [("7", 40, 40), ("7", 40, 40), ("8", 40, 0), ("8", 41, 0), ("9", 40, 40), ("None", 40, 0)]


def test_digest_column(spark):
    rows = [(1, "a b"), (2, None)]
    from pyspark.sql import functions as F
    got = {r.doc_id: r.s for r in substring_dedup.dedup_substrings(documents(spark, rows))
           .select("doc_id", F.sha2(F.col("kept").cast("binary"), 256).alias("s")).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}

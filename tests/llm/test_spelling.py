"""Spelling variants against a plain comparison of deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import queries, spelling
from basketlens.llm.common import table

from .helpers import EDGES, SF, documents

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, damage=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_groups(words):
    """Candidates share a deletion variant (or one is the other's); each is
    then compared letter by letter."""
    shared = defaultdict(set)
    for w in words:
        shared[w].add(w)
        for i in range(len(w)):
            shared[w[:i] + w[i + 1:]].add(w)
    others = defaultdict(set)
    for group in shared.values():
        for a in group:
            others[a] |= {b for b in group if near(a, b)}
    out = {}
    for w, n in words.items():
        best = min(others[w], key=lambda v: (-words[v], v), default=None)
        out[w] = best if best is not None and words[best] >= 2 * n else None
    full = {}
    for w in words:
        root = w
        while out[root] is not None:
            root = out[root]
        full[w] = (out[w], root, words[w], len(others[w]), words[out[w]] if out[w] else None)
    return full


def got(df):
    found = df.collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def test_query_against_plain(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain_groups(plain_words(rows))
    assert sum(v[3] > 0 for v in want.values()) > 100
    assert got(queries.op11_spelling(spark, SF)) == want


def variants(rng, n):
    """Words of few letters, so that anagrams and near words abound."""
    out = set()
    while len(out) < n:
        w = "".join(rng.choice("abcdeé") for _ in range(rng.choice([5, 6, 6, 6, 7, 8])))
        out.add(w)
    return {w: rng.choice([3, 4, 8, 20, 100]) for w in sorted(out)}


@pytest.mark.parametrize("cell", [16, 64, 4096])
def test_dense_words_over_many_cells(spark, cell, monkeypatch):
    """Cells of a few words up to one per length, fitted on a small sample."""
    monkeypatch.setattr(spelling, "CELL", cell)
    words = variants(random.Random(cell), 1500) | {"a" * 300: 5, "a" * 301: 50, "a" * 299 + "b": 9, "b" * 50_000: 4,
                                                  "b" * 50_001: 3}
    docs = documents(spark, [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], 6)
    assert got(spelling.group_variants(docs, damage=None)) == plain_groups(words)


def test_edge_rows(spark):
    rows = EDGES + [(20, "Straße straße STRAßE Straßen straßen"), (21, "Ärger Ärger Ärger ärger ärger ärger ×÷×÷×"),
                    (None, "houses houses houses house house house house house house house")] * 2
    assert got(spelling.group_variants(documents(spark, rows, 3), damage=spelling.DAMAGE)) == plain_groups(
        plain_words(rows))
    assert got(spelling.group_variants(documents(spark, rows, 3))) == plain_groups(plain_words(rows, None))
    assert spelling.group_variants(documents(spark, [(1, "x")]).where("false")).collect() == []


def test_chains_lead_to_their_last_word(spark):
    words = {"a" * 5 + "b" * k: 3 * 2 ** k for k in range(9)}
    docs = documents(spark, [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())])
    found = got(spelling.group_variants(docs))
    assert {v[1] for v in found.values()} == {"aaaaabbbbbbbb"} and found["aaaaa"][0] == "aaaaab"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", min_size=5, max_size=7), min_size=1, max_size=30))
def test_boxes_never_leave_out_a_near_word(words):
    letters = spelling.letter_rows(words)
    vectors = spelling.letter_bits(letters)
    for tight in (True, False):
        tree = spelling.KdTree(vectors, 2, tight)
        home = tree.home(vectors)
        for leaf, members in enumerate(tree.leaves):
            assert (home[members] == leaf).all()
        reach = defaultdict(set)
        for leaf, active in tree.visit(vectors, 2):
            for q in active:
                reach[q] |= set(tree.leaves[leaf].tolist())
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                distance = int(spelling.popcount(vectors[i] ^ vectors[j]))
                if near(a, b):
                    assert distance <= 2
                if distance <= 2:
                    assert j in reach[i]
    assert isinstance(vectors, np.ndarray)

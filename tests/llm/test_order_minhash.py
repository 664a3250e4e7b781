import hashlib
import random

import numpy as np

from basketlens.llm import order_minhash as omh
from .helpers import EDGES, documents, prose


def slow_pieces(text):
    out = []
    for word in text.split(" "):
        for part in word.replace("\t", "\n").split("\n"):
            out += [(k == 0, part[k:k + omh.PIECE]) for k in range(0, len(part), omh.PIECE)]
    return out


def test_pieces_are_exact():
    texts = ["", " ", "ab abcdefg  x\ty\nzzzz", "日本語テキスト ünï 🙂🙂🙂🙂"]
    seen = {}
    for t in texts:
        codes, want = omh.pieces(t).tolist(), slow_pieces(t)
        assert len(codes) == len(want)
        for c, w in zip(codes, want):
            assert seen.setdefault(c, w) == w
    assert len(set(seen.values())) == len(seen)


def test_selection_matches_a_plain_one():
    """The tuple of each function: the L smallest elements, in text order."""
    rng = random.Random(1)
    text = prose(rng, 300, 12)
    part = omh.mix64(omh.pieces(text))
    n = len(part) - omh.K + 1
    grams = sum((part[i:i + n] * omh._STEPS[i % 3] + np.uint64(i) for i in range(omh.K)), np.zeros(n, np.uint64))
    grams = omh.mix64(grams)
    count, elements = {}, []
    for g in grams.tolist():
        k = count[g] = count.get(g, -1) + 1
        elements.append(int(omh.mix64(np.array([g], np.uint64) + np.uint64(k) * omh._STEPS[1])[0]))
    assert len(set(elements)) == n > len(set(grams.tolist()))  # occurrence numbers tell repeats apart
    by, plus = omh._functions(omh.M)
    want = []
    for f in range(omh.M):
        v = np.array(elements, np.uint64) * by[f] + plus[f]
        v ^= v >> np.uint64(29)
        v *= omh._STEPS[2]
        t = np.zeros(1, np.uint64)
        for i, at in enumerate(sorted(np.argsort(v, kind="stable")[:omh.L].tolist())):
            t = omh.mix64(t * omh._STEPS[0] + grams[at] + np.uint64(i + 1))
        want.append(int(t[0] >> np.uint64(32)))
    assert omh.fingerprint(text).tolist() == want


def test_blocks_do_not_matter(monkeypatch):
    text = prose(random.Random(2), 500, 50)
    whole = omh.fingerprint(text).tolist()
    monkeypatch.setattr(omh, "_BLOCK", 7)
    assert omh.fingerprint(text).tolist() == whole


def test_sensitive_to_order_and_edits():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    a = omh.fingerprint(" ".join(words))
    few = words[:]
    for _ in range(4):
        few[rng.randrange(400)] = "edit"
    moved = words[200:] + words[:200]
    near = omh.likeness(a, omh.fingerprint(" ".join(few)))
    turned = omh.likeness(a, omh.fingerprint(" ".join(moved)))
    assert near > 0.8 and turned < 0.7 and near > turned
    assert omh.likeness(a, omh.fingerprint(" ".join(words))) == 1.0
    assert omh.likeness(a, omh.fingerprint(prose(rng, 400, 10 ** 6))) < 0.05


def expected(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        changed = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        f, e, n = (omh.fingerprint(x) for x in (t, changed, following))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f.tolist(), e.tolist(),
                    float(np.mean(f == e)), float(np.mean(f == n))))
    return out


def test_next_documents(spark):
    rng = random.Random(4)
    rows = [(3 * k - 50, prose(rng, rng.randrange(0, 40), 30)) for k in range(70)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(EDGES[:4] + EDGES[8:])]
    for parts in (1, 3, 16, 300):
        got = omh.fingerprints_and_edits(documents(spark, rows, 4), parts=parts).collect()
        assert sorted(map(tuple, got)) == sorted(expected(rows))


def test_edges(spark):
    got = omh.fingerprints_and_edits(documents(spark, EDGES)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGES)
    one = omh.fingerprints_and_edits(documents(spark, [(5, "alone here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert omh.fingerprints_and_edits(documents(spark, [])).count() == 0
    both = {(r.doc_id): r.signature for r in omh.fingerprints(documents(spark, EDGES)).collect()}
    assert both[1] == both[2] == both[3] == [0] * omh.M and both[4] == both[5]

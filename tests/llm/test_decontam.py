import pickle
import random

import numpy as np
import pytest

from basketlens.llm import decontam
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents, prose


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(index, text, threshold, overlap):
    """Every passage against every item."""
    ws = decontam.words_of(text)
    if not ws:
        return set()
    found = set()
    names = sorted(index.vocabulary)
    numbers = [index.vocabulary.get(w, 0) for w in ws]
    for s, e in zip(*decontam.passages(len(ws), index.longest)):
        query = set(ws[s:e])
        own = decontam.shingle_sets(numbers[s:e])
        for n, (item, _) in enumerate(index.items):
            score = sum(by[at == n].sum() for w in names if w in query
                        for at, by in [index.postings(index.vocabulary[w])])
            if score >= threshold - 1e-9 and all(decontam.covered(p, own) >= overlap for p in index.parts(n)):
                found.add(item)
    return found


@pytest.mark.parametrize("threshold,overlap", [(0.6, 0.8), (0.3, 0.3), (0.25, 0.0), (0.9, 1.0)])
def test_wand_is_exact(threshold, overlap):
    rng = random.Random(int(threshold * 100))
    bench = [(k, prose(rng, rng.randrange(3, 25), 30) + ". " + prose(rng, rng.randrange(1, 9), 30)) for k in range(23)]
    index = decontam.build_index([(i, t.encode(), 1) for i, t in bench])
    hits = 0
    for _ in range(60):
        text = prose(rng, rng.randrange(1, 120), 60)
        if rng.random() < 0.6:
            text += " " + rng.choice(bench)[1] + " " + prose(rng, rng.randrange(60), 60)
        got = {h[0] for h in decontam.search_text(index, text.encode(), threshold, overlap)}
        assert got == brute(index, text.encode(), threshold, overlap)
        hits += len(got)
    assert hits


def test_block_max_wand_scores():
    rng = random.Random(3)
    index = decontam.build_index([(k, prose(rng, 12, 25).encode(), 1) for k in range(30)])
    for _ in range(50):
        rows = sorted(rng.sample(range(1, len(index.vocabulary) + 1), 9))
        want = np.zeros(30)
        for r in rows:
            at, by = index.postings(r)
            want[at] += by
        for threshold in (0.2, 0.4, 0.6):
            got = dict(decontam.block_max_wand(index, rows, list(range(index.n_blocks)), threshold))
            assert set(got) == set(np.flatnonzero(want >= threshold - 1e-9))
            assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_planted_items_are_found(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.item_id, r.text) for r in bench.collect()]
    want = {(d, i) for d, t in texts.items() for i, x in rows if t and x in t}
    got = {(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()}
    assert want and want <= got
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_punctuation_around_a_copy_does_not_hide_it(spark):
    rng = random.Random(6)
    item = prose(rng, 12, 1000) + ". " + prose(rng, 3, 1000) + "."
    noisy = "***".join(item.split())
    bench = items(spark, [(1, item)])
    docs = documents(spark, [(1, f"before&&&{item}***after"), (2, f"x ({noisy})!"), (3, prose(rng, 40, 1000))])
    assert sorted(r.doc_id for r in decontam.search(docs, bench).collect()) == [1, 2]


def test_longest_item_across_passages(spark):
    rng = random.Random(5)
    long = prose(rng, 50, 10000)
    bench = items(spark, [(1, long), (2, prose(rng, 7, 10000))])
    docs = documents(spark, [(k, prose(rng, k, 10000) + " " + long + " " + prose(rng, 73, 10000)) for k in range(0, 140, 7)])
    assert decontam.search(docs, bench).where("item_id = 1").select("doc_id").distinct().count() == 20


def test_shards_give_the_same(spark, monkeypatch):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = {(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()}
    monkeypatch.setattr(decontam, "SHARD_BYTES", 3000)
    assert decontam.indexes(bench)[0] > 1
    assert {(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()} == whole
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in whole}


def test_index_size_follows_the_text():
    """A shard of many different words: the index is a few times its text, and
    so is what a broadcast holds."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"word{rng.randrange(40000)}" for _ in range(20)).encode(), 1) for k in range(10000)]
    index = decontam.build_index(rows)
    assert len(pickle.dumps(index)) < 5 * sum(len(t) for _, t, _ in rows)
    text = b"x " * 30 + rows[77][1] + b" y" * 5000
    assert [h[0] for h in decontam.search_text(index, text, 0.6, 0.8)] == [77]


def test_copies_of_an_item_are_one_entry(spark):
    """A third of the items are copies of one: they are counted, not dealt."""
    rng = random.Random(10)
    text = prose(rng, 15, 500)
    bench = items(spark, [(7, text)] * 40 + [(k, prose(rng, 15, 500)) for k in range(100, 180)])
    _, built = decontam.indexes(bench)
    assert sorted(c for x in built for _, c in x.items)[-2:] == [1, 40]
    docs = documents(spark, [(1, f"so {text} it is"), (2, "nothing")])
    assert [(r.doc_id, r.item_id) for r in decontam.search(docs, bench).collect()] == [(1, 7)] * 40


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    """Altered items of very different lengths: the same hits and scores in one
    shard and in many."""
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(5, 60), 60) + ". " + prose(rng, 3, 60)) for k in range(60)]
    bench = items(spark, rows)
    docs = documents(spark, [(k, prose(rng, 30, 60) + " " + " ".join(
        w for w in t.split() if rng.random() < 0.85) + " " + prose(rng, 200, 60)) for k, t in rows])

    def found():
        return {(r.doc_id, r.item_id): (r.word_start, r.words, round(r.score, 9))
                for r in decontam.search(docs, bench, 0.5, 0.1).collect()}

    whole = found()
    assert whole
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    assert decontam.indexes(bench)[0] > 2
    assert found() == whole
    blank = items(spark, [(k, "?! " * 400) for k in range(9)])
    assert list(decontam.indexes(blank)[1]) == []
    assert decontam.search(docs, blank).count() == 0 and decontam.drop_contaminated(docs, blank).count() == 60


def test_edges(spark):
    bench = items(spark, [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id at all")])
    docs = documents(spark, EDGES)
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in decontam.search(docs, bench).collect())
    assert got == [(-1, -1)] * 2 + [(4, 3)] * 2 + [(5, 3)] * 4 or got == [(-1, -1)] * 2 + [(4, 3)] + [(5, 3)] * 2
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 8, 9]
    assert decontam.search(documents(spark, []), bench).count() == 0
    empty = items(spark, [])
    assert decontam.search(docs, empty).count() == 0
    assert decontam.drop_contaminated(docs, empty).count() == len(EDGES)

import random

import numpy as np
import pytest

from basketlens.llm import toxicity
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents, words


def corpus(seed, n=400, bad=("vile", "grubby", "nastyish")):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "pa re to mi lu so".split() for b in "na ko ti du fe ga zo".split()]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 70, 300]))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(max(1, len(ws) // 25)):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(1)
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, dict(labels), docs, marks, toxicity.fit_on(docs, marks)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.start([(1, [[b"aa", b"bb", b"cc"]]), (0, [[b"bb", b"dd"]])], rng)
    names = [b"aa", b"bb", b"cc", b"dd"]
    ids = np.zeros((3, toxicity.WINDOW), dtype=np.int32)
    ids[:, :5] = rng.integers(0, 4, (3, 5))
    lengths, y = np.array([5, 3, 1]), np.array([1.0, 0.0, 1.0], dtype=np.float32)
    for part in (*net.cells, net.attention):
        for k in part:
            part[k] = part[k].astype(np.float64)
    net.out = net.out.astype(np.float64)
    x = toxicity.word_inputs(net, names)[0].astype(np.float64)
    _, cells, att, out, d_x = toxicity.gradients(net, x, ids, lengths, y)

    def slope(array, at):
        eps, old, losses = 1e-3, array[at], []
        for step in (eps, -eps):
            array[at] = old + step
            losses.append(toxicity.gradients(net, x, ids, lengths, y)[0])
        array[at] = old
        return (losses[0] - losses[1]) / (2 * eps)

    for array, grad in [(net.cells[c][k], cells[c][k]) for c in (0, 1) for k in ("W", "U", "b")] + [
            (net.attention[k], att[k]) for k in ("A", "a", "v")] + [(net.out, out), (x, d_x)]:
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(4)]:
            assert grad[at] == pytest.approx(slope(array, at), abs=2e-3, rel=0.02)


def test_held_out_accuracy(spark, trained):
    rows, y, docs, _, net = trained
    got = toxicity.score_toxicity(docs, net, keep=["doc_id"]).withColumn("out", toxicity.held_out()).collect()
    out = [r for r in got if r.out]
    assert len(out) > 80
    wrong = sum((r.score >= toxicity.THRESHOLD) != bool(y[r.doc_id]) for r in out)
    assert wrong <= 0.04 * len(out)


def test_labels_of_held_out_rows_are_not_read(spark, trained):
    _, _, docs, marks, net = trained
    from pyspark.sql import functions as F
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_on(docs, turned)
    assert np.array_equal(again.words, net.words) and np.array_equal(again.out, net.out)


def test_every_window_counts(trained):
    rows, _, _, _, net = trained
    clean = " ".join(w for w in rows[0][1].split() if w not in ("vile", "grubby", "nastyish"))
    clean = (clean + " ") * (40000 // max(1, len(clean.split())))
    ws = clean.split()
    base = toxicity.score_texts(net, [clean.encode()])[0]
    assert base < 0.5
    for at in (0, len(ws) // 2, len(ws)):
        text = " ".join(ws[:at] + ["vile", "grubby"] + ws[at:])
        assert toxicity.score_texts(net, [text.encode()])[0] > 0.7
    starts = toxicity.cut_windows(1000)
    assert starts[-1] + toxicity.WINDOW >= 1000 and set(np.diff(starts)) == {toxicity.STRIDE}


def test_batches_do_not_matter(trained, monkeypatch):
    rows, _, _, _, net = trained
    texts = [t.encode() for _, t in rows[:60]]
    whole = toxicity.text_logits(net, texts)
    monkeypatch.setattr(toxicity, "BATCH_BYTES", 100)
    monkeypatch.setattr(toxicity, "BATCH_WINDOWS", 3)
    assert np.allclose(whole, toxicity.text_logits(net, texts), atol=1e-4)


def test_all_bytes_of_a_long_word_count(spark):
    """Toxic terms behind the first 16 bytes of texts without spaces, learned
    from such texts and found in them wherever they are."""
    rows, labels = corpus(5, 600)
    joined = [(i, "_".join(t.split()) if i % 2 else t) for i, t in rows]
    net = toxicity.fit_on(documents(spark, joined), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = ["pana", "reko", "toti", "midu", "lufe", "soga"] * 60
    base = toxicity.score_texts(net, ["_".join(clean).encode()])[0]
    assert base < toxicity.THRESHOLD
    for at in (8, 100, len(clean)):
        text = "_".join(clean[:at] + ["vile", "grubby", "nastyish"] + clean[at:])
        assert text.index("vile") > 16
        assert toxicity.score_texts(net, [text.encode()])[0] > max(base + 0.1, toxicity.THRESHOLD)


def test_pieces():
    for word in ("a" * 16, "a" * 17, "abcdefghij" * 9, "слово" * 7, "日本語テキスト" * 5, "🙂" * 9, "aж日🙂" * 6):
        body = word.encode()
        found = toxicity.pieces(body)
        if len(body) <= 16:
            assert found == [body]
            continue
        cut = [found[0].partition(toxicity.JOINT)[0]] + [p[1:] for p in found[1:]]
        assert all(p[:1] == toxicity.JOINT for p in found[1:]) and all(len(p) <= 16 and p.decode() for p in cut)
        assert {body[k:k + 5] for k in range(len(body) - 4)} == {p[k:k + 5] for p in cut for k in range(len(p) - 4)}
    assert toxicity.pieces(b"x" * 20)[0] != toxicity.pieces(b"x" * 21)[0]
    assert b"".join(toxicity.pieces(b"\x80" * 40))
    marked, later = toxicity.gram_slots([b"abcdefg", toxicity.JOINT + b"abcdefg"]).tolist()
    assert set(later) < set(marked)


def test_sample_is_bounded(spark, trained):
    _, _, docs, marks, _ = trained
    got = toxicity.training_windows(docs, marks, max_docs=40, max_windows=3)
    assert len(got) == 40 and sum(y for y, _ in got) == 10 and max(len(w) for _, w in got) <= 3


def test_edges(spark, trained):
    *_, net = trained
    docs = documents(spark, EDGES)
    got = toxicity.score_toxicity(docs, net)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    scores = [(r.doc_id, r.text, r.score) for r in got.collect()]
    assert len(scores) == len(EDGES)
    assert all(s == 0.0 for _, t, s in scores if not words(t)) and all(0 <= s <= 1 for _, _, s in scores)
    assert toxicity.score_toxicity(documents(spark, []), net).count() == 0
    marks = spark.createDataFrame([(4, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    nothing = toxicity.fit_on(docs, marks)
    assert nothing is None
    assert {r.score for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}
    assert toxicity.fit_on(documents(spark, []), marks) is None


def test_on_the_given_tables(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    net = toxicity.fit_on(docs, labels)
    rows = (toxicity.score_toxicity(docs, net, keep=["doc_id"]).join(labels, "doc_id")
            .where(toxicity.held_out()).select("score", "toxic").collect())
    hit = sum(r.score >= toxicity.THRESHOLD for r in rows if r.toxic)
    false = sum(r.score >= toxicity.THRESHOLD for r in rows if not r.toxic)
    assert hit >= 0.85 * sum(r.toxic for r in rows) and false <= 0.02 * sum(1 - r.toxic for r in rows)

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from basketlens.llm import lm_scoring as lm
from basketlens.llm import mixing
from basketlens.llm.common import table
from .helpers import EDGES, documents, words


def base_scores(rows):
    tokens = [(i, words(t) + [b""]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return n, sorted((str(i), out(i), len(ws), sum(w in c for w in ws),
                      round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)


def got(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in df.collect())


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scored = lm.score_corpus(docs).cache()
    n, want = base_scores(rows)
    assert got(scored) == want
    assert {r.train_tokens for r in scored.select("train_tokens").distinct().collect()} == {n}
    sums = {r.held_out: (r.m, r.b) for r in scored.groupBy("held_out").agg(
        F.sum("score").alias("m"), F.sum("base_score").alias("b")).collect()}
    assert sums[False][0] > sums[False][1]
    assert scored.where("score >= 0 or score is null or isnan(score)").count() == 0
    low, high = scored.where("bits_per_byte is not null").agg(F.min("bits_per_byte"), F.max("bits_per_byte")).first()
    assert 0 < low < high < 12
    scored.unpersist()


def test_beats_the_base_on_held_out_text(spark):
    scored = lm.score_corpus(table(spark, "/root/testdata/sf0.1", "documents"))
    m, b = scored.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert m > b


def random_model(bits: int) -> lm.Model:
    rng = np.random.default_rng(1)
    tables = rng.normal(0, 2, (lm.CONTEXTS, lm.WORD_BITS << bits)).astype(np.float32)
    tables[2:, rng.random(lm.WORD_BITS << bits) < 0.4] = 0  # contexts that have not been seen
    model = lm.Model(tables, lm._word_mixer())
    model.mixer.weights += rng.normal(0, 0.3, model.mixer.weights.shape).astype(np.float32)
    model.mixer.refined = rng.uniform(0.01, 0.99, model.mixer.refined.shape).astype(np.float32)
    return model


def log10_of(model, classes, hashes, lengths, bits=12):
    return lm.log10_bits(model, lm._word_walk(classes, hashes, lengths, bits), len(classes))


def test_words_are_a_distribution():
    """The probabilities of all classes and places after the same text add up to one."""
    rng = np.random.default_rng(1)
    before = rng.choice([0, 1, 5, 9, lm.ESCAPE], 50).astype(np.uint8)
    hashes = rng.integers(0, 1 << 32, 51, dtype=np.uint32)
    model, total = random_model(12), 0.0
    for c in [*range(28), lm.ESCAPE, lm.END]:
        for place in range(1 << lm.PLACE_BITS if c < lm.ESCAPE else 1):
            hashes[-1] = place << 32 - lm.PLACE_BITS
            total += 10 ** log10_of(model, np.append(before, np.uint8(c)), hashes, np.array([51]))[-1]
    assert total == pytest.approx(1, abs=1e-3)


def plain_log10(model, texts, bits):
    """Per token, one bit after the other with Python's integers and floats.
    ``texts``: lists of (class, hash)."""
    mask = (1 << 64) - 1

    def slot(context, k, node):
        x = (context * 8 + k) * 0x9E3779B97F4A7C15 & mask
        x = ((x ^ x >> 29) >> 16) + node * 0x9E3779B1 & 0xFFFFFFFF
        return ((x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - bits

    def cost(contexts, node, gate, second, region, bit):
        inputs = [float(model.tables[k][(region << bits) + slot(c & mask, k, node)]) for k, c in enumerate(contexts)]
        gate = gate * 4 + (inputs[2] != 0) + 2 * (inputs[3] != 0)
        mixed = min(7.99, max(-7.99, sum(float(model.mixer.weights[k, gate]) * x for k, x in enumerate(inputs))))
        low = int((mixed + 8) * 2)
        part = (mixed + 8) * 2 - low
        a, b = (float(model.mixer.refined[second * 33 + low + j]) for j in (0, 1))
        p = min(1 - 1e-5, max(1e-5, (1 / (1 + math.exp(-mixed)) + a + (b - a) * part) / 2))
        return math.log10(p if bit else 1 - p)

    found = []
    for text in texts:
        seen = [0] * 8
        for t, (c, h) in enumerate(text):
            (c1, h1), (c2, h2), (c3, h3) = (text[t - k] if t >= k else (lm.NONE, 0) for k in (1, 2, 3))
            top, lead = max(seen[:7]), seen.index(max(seen[:7])) if max(seen[:7]) else 0
            sure = 0 if top == 0 else 1 + (4 * top >= 3 * max(1, t)) + (top >= 8)
            pair = (h1 << 32 | h2) * 0xD6E8FEB86659FD93 & mask
            triple = (pair ^ pair >> 32) + h3 & mask
            total = 0.0
            for depth in range(5 if c < 28 else 4):
                node = c >> 5 - depth | 1 << depth
                total += cost(((lead * 4 + sure) * 8 + (c1 >> 2), (c1 * 32 + c2) * 32 + c3, h1, pair),
                              node, node, c1 >> 2, depth, c >> 4 - depth & 1)
            place = h >> 32 - lm.PLACE_BITS
            for depth in range(lm.PLACE_BITS if c < 28 else 0):
                node = c << lm.PLACE_BITS | place >> lm.PLACE_BITS - depth | 1 << depth
                total += cost((c, h1, pair, triple), node, 32 + depth, 8 + (c & 3), 5 + depth,
                              place >> lm.PLACE_BITS - 1 - depth & 1)
            found.append(total)
            seen[c >> 2] += 1
    return found


def test_plain_scorer():
    rng = random.Random(5)
    model = random_model(12)
    vocabulary = [(rng.choice([0, 2, 3, 7, 11, 27, lm.ESCAPE]), rng.getrandbits(32)) for _ in range(40)]
    texts = [[*(rng.choice(vocabulary) for _ in range(n)), (lm.END, 99)] for n in (0, 1, 2, 3, 40, 200)]
    flat = [w for t in texts for w in t]
    got_ = log10_of(model, np.array([c for c, _ in flat], np.uint8), np.array([h for _, h in flat], np.uint32),
                    np.array([len(t) for t in texts]))
    assert got_ == pytest.approx(plain_log10(model, texts, 12), abs=2e-3)


def test_learning_counts_every_bit():
    """A block's bits are counted where the walk looks them up; the next block
    is predicted from them."""
    classes, hashes = np.array([3, 7, 3, lm.END] * 50, np.uint8), np.array([9, 1 << 31, 9, 5] * 50, np.uint32)
    lengths = np.full(50, 4)
    walks = lambda _: (lm._word_walk(classes, hashes, lengths, 12) for _ in range(3))
    parts = list(lm._learn(walks, (lm.WORD_BITS, 12), lm._word_mixer)(None))
    merged = {b.column(0)[0].as_py(): lm._values(b.column(0)[0].as_py(), b.column(1)[0].as_py())
              for b in lm._merge(parts + parts)}
    values = merged.pop(-1)
    counts = {}
    for _ in range(3):
        for _, places, _, _, bit in lm._word_walk(classes, hashes, lengths, 12):
            for k, x in enumerate(places):
                for s, one in zip(x.tolist(), bit.tolist()):
                    counts.setdefault(k * (lm.WORD_BITS << 12) + s, [0, 0])[one] += 1
    found = {}
    for number, body in merged.items():
        pairs = body.reshape(-1, 2)
        for x in np.flatnonzero(pairs.any(axis=1)).tolist():
            found[number * (lm.SLICE // 2) + x] = (pairs[x] // 2).tolist()  # the task came twice
    assert found == counts
    mixer = lm._word_mixer().load(values[:-1] / values[-1])
    assert (mixer.weights != 0.25).any()


def test_counts_of_a_task_travel_in_32_bits():
    classes, hashes = np.array([3, 7, 3, lm.END] * 50, np.uint8), np.array([9, 1 << 31, 9, 5] * 50, np.uint32)
    walks = lambda _: [lm._word_walk(classes, hashes, np.full(50, 4), 12)]
    parts = list(lm._learn(walks, (lm.WORD_BITS, 12), lm._word_mixer)(None))
    for rows, width in ((parts, 4), (lm._merge(parts), 8)):
        sizes = {len(zstandard.decompress(b.column(1)[0].as_py())) for b in rows if b.column(0)[0].as_py() >= 0}
        assert sizes == {width * lm.SLICE}


def test_split_gives_lower_cased_words_and_the_end():
    texts = [(t or "").encode() for _, t in EDGES] + [b"", b" ", b"\n", b"a", b" a", b"a ", b" A  b\x0b\x0c\r\tC\n"]
    texts += [chr(c).encode() * 2 + b"A" + chr(c).encode() + b"b" + chr(c).encode() for c in range(0x250)]
    assert lm._split(pa.array(texts, pa.binary())).cast(pa.list_(pa.binary())).to_pylist() == [words(t.decode()) + [b""] for t in texts]


def test_chunks_keep_words_of_groups_apart(spark):
    rows = spark.createDataFrame([(1, False, "x", b"A b a"), (2, True, "x", b"b c"), (3, False, "y", b"a"), (4, None, None, None)],
                                 "doc_id int, held_out boolean, grp string, body binary").coalesce(1)
    chunk, = rows.na.fill({"held_out": False}).withColumn("body", F.coalesce("body", F.lit(b""))).mapInArrow(
        lm._chunks(["x", "y"]), "chunk long, words array<binary>, group array<int>, trained array<long>, doc_id array<int>,"
        " held_out array<boolean>, length array<long>, bytes array<long>, codes binary").collect()
    codes = np.frombuffer(zstandard.decompress(bytes(chunk.codes)), "<u4").tolist()
    entries = list(zip(map(bytes, chunk.words), chunk.group))
    assert len(set(entries)) == len(entries)
    assert [entries[c] for c in codes] == [(b"a", 0), (b"b", 0), (b"a", 0), (b"", 0), (b"b", 0), (b"c", 0), (b"", 0),
                                           (b"a", 1), (b"", 1), (b"", lm.GROUPS)]
    assert dict(zip(entries, chunk.trained)) == {(b"a", 0): 2, (b"b", 0): 1, (b"", 0): 1, (b"c", 0): 0, (b"a", 1): 1,
                                                 (b"", 1): 1, (b"", lm.GROUPS): 1}
    assert (chunk.doc_id, chunk.held_out, chunk.length, chunk.bytes) == (
        [1, 2, 3, 4], [False, True, False, False], [4, 3, 2, 1], [5, 3, 1, 0])


def test_order_of_words_counts(spark):
    """A text costs less in an order that was learned than in another one,
    whether its words are of one class or not."""
    rng = random.Random(6)
    names = [f"word{k}" for k in range(40)]
    follows = {w: rng.sample(names, 2) for w in names}

    def text():
        found = [rng.choice(names)]
        while len(found) < 60:
            found.append(rng.choice(follows[found[-1]]))
        return found

    rows = [(k, " ".join(text())) for k in range(600)]
    rows += [(1000 + k, " ".join(t)) for k in range(20) for t in [text()]]
    rows += [(2000 + i - 1000, " ".join(t.split()[::-1])) for i, t in rows[-20:]]
    scores = {r.doc_id: r.score for r in lm.score_corpus(documents(spark, rows, 2), out=F.col("doc_id") >= 1000).collect()}
    for k in range(20):
        assert scores[1000 + k] > 0.75 * scores[2000 + k]


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(2)
    model = lm.Model(rng.normal(0, 2, (lm.CONTEXTS, 1 << lm.SPELL_BITS)).astype(np.float32), lm._spell_mixer())
    # the next byte after "ab", terminator included
    one = 10 ** lm.spell(model, [b"ab"])[0]
    stem = 0.0
    for b in range(256):
        data, first = np.frombuffer(b"ab" + bytes([b]), np.uint8), np.array([0])
        bits = lm.log10_bits(model, lm._spell_walk(data, first), 3)
        stem += 10 ** bits[2]
        if b == 32:
            assert 10 ** bits.sum() == pytest.approx(one, rel=1e-5)
    assert stem == pytest.approx(1, abs=1e-3)
    alone = lm.spell(model, [b"xyz"])[0]
    many = lm.spell(model, [b"q" * 300000, b"xyz", b"ab"])
    assert many[1] == pytest.approx(alone) and 10 ** many[2] == pytest.approx(one, rel=1e-5)


def test_blocks_and_chunks_do_not_change_counts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(60)))) for k in range(80)]
    whole = got(lm.score_corpus(documents(spark, rows, 3)))
    for chunk in (1, 300):
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        assert got(lm.score_corpus(documents(spark, rows, 3))) == whole == base_scores(rows)[1]


def test_mixer_learns_the_better_input():
    rng = np.random.default_rng(4)
    mixer = mixing.Mixer(2, 1, 1)
    for _ in range(200):
        bit = rng.random(500) < 0.5
        good = np.where(bit, 1.5, -1.5).astype(np.float32) * np.where(rng.random(500) < 0.82, 1, -1)
        bad = rng.normal(0, 2, 500).astype(np.float32)
        gate = np.zeros(500, dtype=np.intp)
        p, kept = mixer.predict([good.astype(np.float32), bad], gate, gate)
        mixer.learn([good, bad], gate, bit, kept, 0.1)
    assert mixer.weights[0, 0] > 0.8 and abs(mixer.weights[1, 0]) < 0.1
    assert -np.log2(np.where(bit, p, 1 - p)).mean() < 0.75


def test_edges(spark):
    scored = lm.score_corpus(documents(spark, EDGES))
    assert got(scored) == base_scores(EDGES)[1]
    per_text = {}
    for r in scored.where("doc_id in (4, 5)").collect():
        per_text.setdefault("one", set()).add((r.base_score, r.score))
    assert len(per_text["one"]) == 1  # equal texts score alike
    assert lm.score_corpus(documents(spark, [])).count() == 0
    none_to_learn = lm.score_corpus(documents(spark, [(1, "a b"), (2, "")]), out=F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in none_to_learn) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(r.score < 0 for r in none_to_learn)
    no_group = documents(spark, EDGES).drop("lang")
    assert got(lm.score_corpus(no_group)) == base_scores(EDGES)[1]

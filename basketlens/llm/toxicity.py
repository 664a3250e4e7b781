"""Toxicity: a bidirectional GRU with attention pooling over word and
character inputs, trained in numpy, scoring all overlapping windows.

A text is lower-cased (A-Z), split into words and cut into windows of
``WINDOW`` positions, one every ``STRIDE``.  A word enters the network as

* a word input: the embedding of a word that follows at least
  ``MIN_CONTEXTS`` different words in the training rows (any other word has a
  shared embedding), and
* a character input: the element-wise maximum over the embeddings of the
  word's hashed character 3- to 5-grams, with a mark before the word, and of its
  beginnings.

A word of more than ``PIECE`` bytes takes several positions, one for each of its
overlapping pieces: all its bytes count, and a text without spaces has as many
windows as its length asks for.  The first piece begins the word and has the
whole word's own word input.

A forward and a backward GRU read the window, attention pools their states
and a logistic unit gives the window's logit.  The text's score is a
calibrated logistic of its largest window logit, so every window counts and a
long text needs no cut.  Windows go through the network as they are read, a
bounded number at a time.

Training rows are a bounded sample of the labelled documents (``MAX_DOCS``, a
quarter of them toxic where there are as many, at most ``MAX_WINDOWS`` windows
of each, both documented parameters).  Labels are per document, so a toxic
document trains through its highest-scoring windows, chosen anew in every
epoch.  Embeddings start from each feature's log-odds over the training
rows in their first component (for characters also negated in the second) and
train with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import (LOWER, quoted, schema_plus, share, slices_by_bytes, text_or_empty,
                                   without)

WINDOW, STRIDE = 32, 16
MAX_DOCS, MAX_WINDOWS = 4000, 24
MIN_CONTEXTS = 3
WORD_DIM, GRAM_DIM, HIDDEN = 4, 4, 8
GRAM_SLOTS = 1 << 15
STEM = 9             # the longest beginning of a word that is a gram of its own
PIECE = 16           # bytes of a word that make one position's character inputs
OVERLAP = 4          # bytes that neighbouring pieces share at least: the longest gram less one
JOINT = b"\xff"      # not in UTF-8: begins a later piece, and parts a first piece from its word's digest
EPOCHS = 4
THRESHOLD = 0.7
BATCH_WINDOWS = 4096
BATCH_BYTES = 1 << 20
BATCH_WORDS = 1 << 14


@dataclass
class Network:
    vocabulary: dict[bytes, int]      # word -> row of ``words``; row 0: any other word
    words: np.ndarray                 # (n, WORD_DIM)
    grams: np.ndarray                 # (GRAM_SLOTS, GRAM_DIM)
    cells: list[dict[str, np.ndarray]]  # forward and backward GRU: W, U, b
    attention: dict[str, np.ndarray]  # A, a, v
    out: np.ndarray                   # (2 * HIDDEN + 1,)
    scale: float = 1.0                # calibration of the largest window logit
    shift: float = 0.0


def pieces(word: bytes) -> list[bytes]:
    """The positions of a word: itself, or its overlapping pieces, cut between
    code points.  Every five bytes in a row lie whole in one of them."""
    if len(word) <= PIECE:
        return [word]

    def border(at: int) -> int:
        for k in range(at, at - 4, -1):
            if k >= len(word) or word[k] & 0xC0 != 0x80:
                return k
        return at  # not UTF-8

    end = border(PIECE)
    found = [word[:end] + JOINT + blake2b(word, digest_size=8).hexdigest().encode()]
    while end < len(word):
        at = border(end - OVERLAP)
        end = border(min(at + PIECE, len(word)))
        found.append(JOINT + word[at:end])
    return found


def positions(text: bytes) -> list[bytes]:
    """The window positions of a text, in order."""
    found = []
    for w in text.translate(LOWER).split():
        if len(w) > PIECE:
            found += pieces(w)
        else:
            found.append(w)
    return found


def gram_slots(words: list[bytes]) -> np.ndarray:
    """Hashed character 3- to 5-grams of each word and its beginnings of up to
    ``STEM`` characters, ``(n, k)``; unused places hold the slot of the word's
    first gram.  A later piece of a word has only the grams without the mark."""
    later = np.array([w[:1] == JOINT for w in words], dtype=bool)
    own = [w if len(w) <= PIECE and not x else w[1:] if x else w.partition(JOINT)[0]
           for w, x in zip(words, later.tolist())]
    letters = np.zeros((len(words), PIECE + 5), dtype=np.uint32)
    letters[:, 0] = 1
    letters[:, 1:PIECE + 1] = np.array(own, dtype=f"S{PIECE}").view(np.uint8).reshape(len(words), PIECE)
    n = PIECE + 1
    code = letters[:, :n]
    found = []

    def add(code: np.ndarray, last: np.ndarray) -> None:
        slot = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(17)
        slot = np.where(last != 0, slot, np.uint32(GRAM_SLOTS))
        slot[later, 0] = GRAM_SLOTS
        found.append(slot)

    for k in range(1, STEM + 1):
        if k == 5:  # longer grams begin the word
            n, code = 1, code[:, :1]
        code = code * np.uint32(0x01000193) ^ letters[:, k:n + k] * np.uint32(0x9E3779B1)
        if k >= 2:
            add(code, letters[:, k:n + k])
    slots = np.concatenate(found, axis=1)
    first = np.where(later[:, None], slots[:, 1:2], slots[:, :1])
    first = np.where(first == GRAM_SLOTS, np.uint32(0), first)
    return np.where(slots == GRAM_SLOTS, first, slots).astype(np.int32)


def word_inputs(net: Network, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Inputs of distinct words, with the rows and places they came from."""
    rows = np.array([net.vocabulary.get(w, 0) for w in words], dtype=np.int32)
    x = np.empty((len(words), WORD_DIM + GRAM_DIM), dtype=np.float32)
    x[:, :WORD_DIM] = net.words[rows]
    best = np.empty((len(words), GRAM_DIM), dtype=np.int32)
    for at in range(0, len(words), BATCH_WORDS):
        cut = slice(at, at + BATCH_WORDS)
        slots = gram_slots(words[cut])
        for d in range(GRAM_DIM):
            place = net.grams[:, d][slots].argmax(axis=1)
            best[cut, d] = slots[np.arange(len(slots)), place]
    for d in range(GRAM_DIM):
        x[:, WORD_DIM + d] = net.grams[best[:, d], d]
    return x, rows, best


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(cell: dict[str, np.ndarray], gates: np.ndarray, ids: np.ndarray, live: np.ndarray,
        keep: bool = False):
    """States after each step.  ``gates``: input part of the gates per distinct
    word; ``ids``: (steps, windows) of distinct words; ``live``: 0 past the end
    of a short window, where the state stays."""
    steps, n = ids.shape
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    states = np.empty((steps, n, HIDDEN), dtype=np.float32)
    trace = []
    u_zr, u_c = cell["U"][:, :2 * HIDDEN], cell["U"][:, 2 * HIDDEN:]
    for t in range(steps):
        g = gates[ids[t]]
        zr = _sigmoid(g[:, :2 * HIDDEN] + h @ u_zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(g[:, 2 * HIDDEN:] + (r * h) @ u_c)
        step = z * (c - h) * live[t][:, None]
        if keep:
            trace.append((h, z, r, c))
        h = h + step
        states[t] = h
    return (states, trace) if keep else states


def window_logits(net: Network, ids: np.ndarray, lengths: np.ndarray, gates: list[np.ndarray]) -> np.ndarray:
    """Logits of windows: ``ids`` (windows, WINDOW), 0-padded."""
    steps = ids.T
    live = (np.arange(ids.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    ahead = gru(net.cells[0], gates[0], steps, live)
    back = gru(net.cells[1], gates[1], steps[::-1], live[::-1])[::-1]
    states = np.concatenate([ahead, back], axis=2)
    hidden = np.tanh(states @ net.attention["A"] + net.attention["a"])
    e = hidden @ net.attention["v"] + (live - 1) * 1e4
    e -= e.max(axis=0)
    w = np.exp(e)
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", w, states)
    return pooled @ net.out[:-1] + net.out[-1]


def cut_windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of ``n`` words; the last one ends at
    the last word or beyond it."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def text_logits(net: Network, texts: list[bytes]) -> np.ndarray:
    """The largest window logit of each text; minus infinity without a word."""
    result = np.full(len(texts), -np.inf, dtype=np.float64)
    for a, b in slices_by_bytes(map(len, texts), BATCH_BYTES):
        words = [positions(t) for t in texts[a:b]]
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], dtype=np.int32)
        if not len(ids):
            continue
        x, _, _ = word_inputs(net, list(number))
        gates = [x @ c["W"] + c["b"] for c in net.cells]
        starts, ends, owner, at = [], [], [], 0
        for k, ws in enumerate(words):
            if ws:
                s = cut_windows(len(ws)) + at
                starts.append(s)
                ends.append(np.minimum(s + WINDOW, at + len(ws)))
                owner.append(np.full(len(s), a + k))
                at += len(ws)
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        padded = np.concatenate([ids, np.zeros(WINDOW, dtype=np.int32)])
        for i in range(0, len(starts), BATCH_WINDOWS):
            s, e = starts[i:i + BATCH_WINDOWS], ends[i:i + BATCH_WINDOWS]
            logits = window_logits(net, padded[s[:, None] + np.arange(WINDOW)], e - s, gates)
            np.maximum.at(result, owner[i:i + BATCH_WINDOWS], logits)
    return result


# -- training ---------------------------------------------------------------

def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "toxic", max_docs: int = MAX_DOCS,
                     max_windows: int = MAX_WINDOWS) -> list[tuple[int, list[list[bytes]]]]:
    """Windows of the training sample: ``(label, windows)`` per document.

    The sample is the ``max_docs / 4`` toxic and the remaining clean documents
    with the smallest id hashes, out of the labelled rows that are not held
    out; a document with contradicting labels counts as toxic.  Of a document with more than
    ``max_windows`` windows, evenly spaced ones are taken.  At most
    ``max_docs x max_windows`` windows reach the driver.
    """
    id_type = docs.schema[id_col].dataType
    marked = (labels.select(quoted(id_col).cast(id_type).alias("i"), quoted(label_col).cast("int").alias("y"))
              .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out("i"))
              .groupBy("i").agg(F.max("y").alias("y")))
    chosen = None
    for y in (0, 1):
        part = (marked.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i")
                .limit(max_docs // 4 if y else max_docs - max_docs // 4))
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most max_docs rows of an id and a label.
    sample = (docs.select(quoted(id_col).alias("i"), text_or_empty(text_col).cast("binary").alias("body"))
              .join(F.broadcast(chosen), "i").select("i", "y", "body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ys, found = [], [], []
            for i, y, body in zip(batch.column("i"), batch.column("y").to_pylist(), batch.column("body")):
                words = positions(body.as_py())
                starts = cut_windows(len(words))
                if len(starts) > max_windows:
                    starts = starts[np.linspace(0, len(starts) - 1, max_windows).astype(int)]
                keys.append(i)
                ys.append(y)
                found.append([b" ".join(words[s:s + WINDOW]) for s in starts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(k) for k in keys], pa.string()), pa.array(ys, pa.int32()),
                 pa.array(found, pa.list_(pa.binary()))], names=["i", "y", "windows"])

    found = sample.mapInArrow(run, "i string, y int, windows array<binary>").toArrow()
    shared: dict[bytes, bytes] = {}  # equal words are one object
    rows = []
    for k in sorted(range(found.num_rows), key=lambda k: (found["i"][k].as_py(), found["y"][k].as_py(),
                                                         found["windows"][k].as_py())):
        rows.append((found["y"][k].as_py(), [[shared.setdefault(w, w) for w in text.split()]
                                             for text in found["windows"][k].as_py()]))
    return rows


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed log-odds of a feature's counts, drawn to 0 as far as
    chance explains them (signed root of the likelihood ratio)."""
    odds = np.log((pos + 0.2) / (n_pos + 0.4)) - np.log((neg + 0.2) / (n_neg + 0.4))
    total, share = pos + neg, n_pos / (n_pos + n_neg)
    ratio = (pos * np.log(np.maximum(pos, 1e-9) / np.maximum(total * share, 1e-9))
             + neg * np.log(np.maximum(neg, 1e-9) / np.maximum(total * (1 - share), 1e-9)))
    trust = np.clip((np.sqrt(np.maximum(0, 2 * ratio)) - 2.5) / 2.5, 0, 1)
    return (odds * trust).astype(np.float32)


def start(docs: list[tuple[int, list[list[bytes]]]], rng: np.random.Generator) -> Network:
    names, ids, lengths = _number([w for _, windows in docs for w in windows])
    label = np.repeat([y for y, _ in docs], [len(windows) for _, windows in docs])
    # A word counts once per word before it, so that what copies of a document
    # repeat counts once.
    before = np.concatenate([np.full((len(ids), 1), len(names), dtype=np.int64), ids[:, :-1]], axis=1)
    pairs = before << 32 | ids
    inside = np.arange(WINDOW) < lengths[:, None]
    counts = np.stack([np.bincount(np.unique(pairs[(label == y)[:, None] & inside]) & 0xFFFFFFFF, minlength=len(names))
                       for y in (0, 1)], axis=1).astype(float)
    n_neg, n_pos = np.maximum(1, counts.sum(axis=0))
    slots = np.zeros((2, GRAM_SLOTS))
    for at in range(0, len(names), BATCH_WORDS):
        places = np.sort(gram_slots(names[at:at + BATCH_WORDS]), axis=1)
        once = np.concatenate([np.ones((len(places), 1), bool), places[:, 1:] != places[:, :-1]], axis=1)
        for y in (0, 1):
            np.add.at(slots[y], places[once], np.repeat(counts[at:at + BATCH_WORDS, y], once.sum(axis=1)))
    often = np.flatnonzero(counts.sum(axis=1) >= MIN_CONTEXTS)
    known = [names[k] for k in often]
    table = counts[often]
    words = rng.normal(0, 0.1, (len(known) + 1, WORD_DIM)).astype(np.float32)
    words[0] = 0
    words[1:, 0] = _log_odds(table[:, 1], table[:, 0], n_pos, n_neg)
    grams = rng.normal(0, 0.1, (GRAM_SLOTS, GRAM_DIM)).astype(np.float32)
    # The largest and the smallest of a word's grams both reach the network.
    grams[:, 0] = _log_odds(slots[1], slots[0], n_pos, n_neg)
    grams[:, 1] = -grams[:, 0]
    size = WORD_DIM + GRAM_DIM

    def weights(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    cells = [{"W": weights(size, 3 * HIDDEN), "U": weights(HIDDEN, 3 * HIDDEN),
              "b": np.zeros(3 * HIDDEN, np.float32)} for _ in range(2)]
    return Network({w: k + 1 for k, w in enumerate(known)}, words, grams, cells,
                   {"A": weights(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32),
                    "v": weights(HIDDEN)}, np.append(weights(2 * HIDDEN), np.float32(0)))


def _cell_gradient(cell, trace, steps, live, d_states, n_words):
    """Gradients of one GRU through time, and of the gates per distinct word."""
    grad = {k: np.zeros_like(v) for k, v in cell.items()}
    d_gates = np.zeros((n_words, 3 * HIDDEN), dtype=np.float32)
    u_zr, u_c = cell["U"][:, :2 * HIDDEN], cell["U"][:, 2 * HIDDEN:]
    dh = np.zeros_like(trace[0][0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, c = trace[t]
        dh = dh + d_states[t]
        alive = live[t][:, None]
        d_step = dh * alive
        dc = d_step * z * (1 - c * c)
        dz = d_step * (c - h) * z * (1 - z)
        d_rh = dc @ u_c.T
        dr = d_rh * h * r * (1 - r)
        d_zr = np.concatenate([dz, dr], axis=1)
        grad["U"][:, :2 * HIDDEN] += h.T @ d_zr
        grad["U"][:, 2 * HIDDEN:] += (r * h).T @ dc
        g = np.concatenate([d_zr, dc], axis=1)
        np.add.at(d_gates, steps[t], g)
        dh = dh - d_step * z + d_rh * r + d_zr @ u_zr.T
    grad["b"] = d_gates.sum(axis=0)
    return grad, d_gates


def gradients(net: Network, x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray):
    """Mean logistic loss of windows and its gradients."""
    steps = np.ascontiguousarray(ids.T)
    live = (np.arange(ids.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    gates = [x @ c["W"] + c["b"] for c in net.cells]
    ahead, trace_a = gru(net.cells[0], gates[0], steps, live, keep=True)
    back, trace_b = gru(net.cells[1], gates[1], steps[::-1], live[::-1], keep=True)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    hidden = np.tanh(states @ net.attention["A"] + net.attention["a"])
    e = hidden @ net.attention["v"] + (live - 1) * 1e4
    e = e - e.max(axis=0)
    w = np.exp(e)
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", w, states)
    logit = pooled @ net.out[:-1] + net.out[-1]
    p = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d_logit = ((p - y) / len(y)).astype(np.float32)
    g_out = np.append(pooled.T @ d_logit, d_logit.sum()).astype(np.float32)
    d_pooled = d_logit[:, None] * net.out[:-1]
    d_w = np.einsum("nd,tnd->tn", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    d_hidden = d_e[:, :, None] * net.attention["v"] * (1 - hidden * hidden)
    g_att = {"v": np.einsum("tn,tnh->h", d_e, hidden),
             "A": np.einsum("tnd,tnh->dh", states, d_hidden, optimize=True),
             "a": d_hidden.sum(axis=(0, 1))}
    d_states = w[:, :, None] * d_pooled + d_hidden @ net.attention["A"].T
    g_a, dg_a = _cell_gradient(net.cells[0], trace_a, steps, live, d_states[:, :, :HIDDEN], len(x))
    g_b, dg_b = _cell_gradient(net.cells[1], trace_b, steps[::-1], live[::-1],
                               d_states[::-1, :, HIDDEN:], len(x))
    g_a["W"], g_b["W"] = x.T @ dg_a, x.T @ dg_b
    d_x = dg_a @ net.cells[0]["W"].T + dg_b @ net.cells[1]["W"].T
    return loss, [g_a, g_b], g_att, g_out, d_x


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v, t = self.seen.get(name, (np.zeros_like(value), np.zeros_like(value), 0))
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        self.seen[name] = (m, v, t)
        value -= self.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


def _number(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    number: dict[bytes, int] = {}
    ids = np.zeros((len(words), WINDOW), dtype=np.int32)
    for k, ws in enumerate(words):
        ids[k, :len(ws)] = [number.setdefault(w, len(number)) for w in ws]
    return list(number), ids, np.array([len(w) for w in words], dtype=np.int64)


def fit(docs: list[tuple[int, list[list[bytes]]]], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """A trained network, or None when a label has no document with a word."""
    docs = [(y, [w for w in windows if w]) for y, windows in docs]
    docs = [d for d in docs if d[1]]
    if len({y for y, _ in docs}) < 2:
        return None
    rng = np.random.default_rng(seed)
    net = start(docs, rng)
    flat = [w for _, windows in docs for w in windows]
    names, ids, lengths = _number(flat)
    first = np.concatenate([[0], np.cumsum([len(windows) for _, windows in docs])])
    y_doc = np.array([y for y, _ in docs])
    owner = np.repeat(np.arange(len(docs)), np.diff(first))

    def logits() -> np.ndarray:
        x, _, _ = word_inputs(net, names)
        gates = [x @ c["W"] + c["b"] for c in net.cells]
        return np.concatenate([window_logits(net, ids[i:i + BATCH_WINDOWS], lengths[i:i + BATCH_WINDOWS], gates)
                               for i in range(0, len(ids), BATCH_WINDOWS)])

    x, _, _ = word_inputs(net, names)
    evidence = x[:, 0] + x[:, WORD_DIM]
    rank = np.where(np.arange(WINDOW) < lengths[:, None], evidence[ids], -np.inf).max(axis=1)
    adam = _Adam(0.02)
    # Every fifth document is kept from the updates to calibrate by.
    aside = np.arange(len(docs)) % 5 == 4
    for epoch in range(epochs):
        if epoch:
            rank = logits()
        chosen, target = [], []
        for d, (y, _) in enumerate(docs):
            if aside[d]:
                continue
            own = np.arange(first[d], first[d + 1])
            best = own[np.argsort(-rank[own], kind="stable")[:3]]
            if y:
                chosen += [best[0]]
            else:
                chosen += [*best, rng.choice(own)]
        chosen = rng.permutation(np.array(chosen))
        target = y_doc[owner[chosen]].astype(np.float32)
        for at in range(0, len(chosen), 64):
            pick = chosen[at:at + 64]
            used, place = np.unique(ids[pick], return_inverse=True)
            x, rows, best = word_inputs(net, [names[k] for k in used])
            _, g_cells, g_att, g_out, d_x = gradients(net, x, place.reshape(len(pick), WINDOW).astype(np.int32),
                                                      lengths[pick], target[at:at + 64])
            for c, g in enumerate(g_cells):
                for k in g:
                    adam.step(f"cell{c}{k}", net.cells[c][k], g[k])
            for k in g_att:
                adam.step(f"att{k}", net.attention[k], g_att[k])
            adam.step("out", net.out, g_out)
            np.add.at(net.words, rows, -0.1 * d_x[:, :WORD_DIM] * (rows > 0)[:, None])
            for d in range(GRAM_DIM):
                np.add.at(net.grams[:, d], best[:, d], -0.1 * d_x[:, WORD_DIM + d])
    top = np.full(len(docs), -np.inf)
    np.maximum.at(top, owner, logits())
    aside |= len(set(y_doc[aside].tolist())) < 2  # too few documents to keep some aside
    net.scale, net.shift = calibrate(top[aside], y_doc[aside])
    return net


def calibrate(top: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic over the documents' largest logits,
    each label weighing the same; two made-up rows per label at the labels'
    means, one of them with the other label, keep the slope finite."""
    means = [top[y == k].mean() for k in (0, 1)]
    x = np.concatenate([top, means, means])
    t = np.concatenate([y, [0, 1], [1, 0]]).astype(float)
    share = 1 / max(20, len(y))
    weight = np.concatenate([np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), [share] * 2, [share / 4] * 2])
    a, b = 0.1, -0.1 * float(np.mean(means))
    for _ in range(rounds):
        p = _sigmoid(a * x + b)
        r, s = weight * (p - t), weight * p * (1 - p)
        g = np.array([(r * x).sum(), r.sum()])
        h = np.array([[(s * x * x).sum() + 1e-9, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        d = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = float(a - 0.5 * d[0]), float(b - 0.5 * d[1])
    return max(a, 1e-3), b


# -- scoring ----------------------------------------------------------------

def score_texts(net: Network | None, texts: list[bytes]) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    top = text_logits(net, texts)
    return np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(net.scale * np.where(np.isfinite(top), top, 0)
                                                               + net.shift, -500, 500))), 0.0)


def score_toxicity(docs: DataFrame, net: Network | None, text_col: str = "text",
                   score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, by default all) with ``score``
    from 0 to 1.

    A text that is null or has no word scores 0.  Without a network (training
    rows of one label only, or none) every text scores 0.5.  An input column
    named like the score is replaced.  Repeated rows get equal scores; an
    empty table gives an empty result.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c in without(docs, score_col)]
    rows = docs.select(*[quoted(c) for c in kept], text_or_empty(text_col).cast("binary").alias("__body"))
    shared = share(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            last = batch.num_columns - 1
            scores = score_texts(own, batch.column(last).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(scores, pa.float64())],
                                             names=[*kept, score_col])

    return rows.mapInArrow(run, schema_plus(docs, kept, f"`{score_col}` double"))


def fit_on(docs: DataFrame, labels: DataFrame, **options) -> Network | None:
    return fit(training_windows(docs, labels, **options))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")

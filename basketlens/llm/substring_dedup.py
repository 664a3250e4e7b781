"""Substring dedup by relative Lempel-Ziv parsing.

A window of ``WINDOW`` consecutive words goes when the same words also start
earlier in the table (smaller id, or earlier in the same document); a word is
removed when such a window covers it.

Reference blocks.  The ``ANCHOR``-word gram with the smallest hash inside a
window is its anchor.  The consecutive windows with the same anchor occurrence
make a block, some 26 words long, whose extent depends on its own words, so the
same passage falls into the same blocks in every document.  The index of the
reference has one entry per distinct block (anchor hash and block hash, 128
bits), with its first occurrence in the table.

Parsing.  A document is read left to right as its blocks.  A block that the
index holds from an earlier place is copied from there: all its windows start
earlier.  Copies that continue each other in document and source join greedily
into factors.

Factor boundaries.  Where a copied passage begins or ends inside a block, the
block is new although some of its windows are not.  Those blocks share their
anchor with a different block, so exactly the blocks whose anchor has more than
one distinct block are checked window by window against the index.  Together
this marks every window that starts earlier and no other (hashes of 96 bits or
more stand for the words).

Blocks are deduplicated inside a batch before they are shuffled, and the sorted
runs of an anchor are read as a stream with one block held, so a hot passage
needs no memory of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import (Powers, hash_words, mix64, quoted, range_hashes, slices_by_bytes,
                                   text_or_empty)

WINDOW, ANCHOR = 20, 8
BATCH_BYTES = 4 << 20
_START = (1 << 40) - 1       # a place is a word number and, above it, a tag of the text
_NO_ID = -(1 << 63)          # stands for a null id: before all others
_OUT = "doc long, place long, windows int, kind int, from_doc long, from_start long"
_COPY, _CHECK = 1, 2


def blocks(codes: np.ndarray, window: int, anchor: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """``(anchor hash, block hash, first window, windows)`` of a text's blocks."""
    n = len(codes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    at = np.arange(len(codes) - anchor + 1)
    grams = range_hashes(codes, at, at + anchor, powers)
    span = window - anchor + 1
    chosen = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    place = chosen[first]
    whole = range_hashes(codes, first, first + count + window - 1, powers)
    return grams[place], mix64(whole + (place - first).astype(np.uint64)), first, count


def _first_in_batch(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray):
    """Order by key and occurrence; per row the position of its key's first
    occurrence, and whether the row comes after it."""
    order = np.lexsort([place & _START, doc, *reversed(keys)])
    new = np.ones(len(order), dtype=bool)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    new[1:] = ~same
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[lead]) | ((place[order] & _START) != (place[lead] & _START))
    return order, lead, new, later


def _rows(key1, key2, doc, place, windows, from_doc=None, from_start=None) -> pa.RecordBatch:
    n = len(doc)
    fill = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(doc, pa.int64()),
         pa.array(place, pa.int64()), pa.array(windows, pa.int32()), fill(from_doc), fill(from_start)],
        names=["key1", "key2", "doc", "place", "windows", "from_doc", "from_start"])


_KEYED = "key1 long, key2 long, doc long, place long, windows int, from_doc long, from_start long"


def _keyed(key1, key2, doc, place, windows) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle: the first occurrence of a key as itself; a later
    one as a copy of it, which is settled and so goes to any task."""
    if not len(doc):
        return
    order, lead, _, later = _first_in_batch([key1, key2], doc, place)
    one, two = order[~later], order[later]
    # rows at the same id and word number repeat one another; all go on
    yield _rows(key1[one], key2[one], doc[one], place[one], windows[one])
    if len(two):
        src = lead[later]
        spread = mix64((doc[two] ^ place[two]).view(np.uint64))
        yield _rows(spread, spread, doc[two], place[two], windows[two], doc[src], place[src] & _START)


def _emit_blocks(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2)
            for a, b in slices_by_bytes((len(t.as_buffer()) for t in texts), BATCH_BYTES):
                found = []
                for k in range(a, b):
                    h, u, first, count = blocks(hash_words(texts[k].as_py(), powers), window, anchor, powers)
                    if len(h):
                        found.append((h, u, np.full(len(h), docs[k]), first + tags[k], count))
                if found:
                    yield from _keyed(*(np.concatenate(c) for c in zip(*found)))
    return run


def _read_runs(check: bool):
    """Reads rows sorted by ``key1, key2, doc, word number``.  Later rows of a
    key come out as copies of its first; with ``check``, the first rows of keys
    that share ``key1`` with another key come out to be checked."""
    def batch_of(doc, place, windows, kind, from_doc, from_start) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(windows, pa.int32()),
             pa.array(np.full(n, kind, np.int32)),
             pa.nulls(n, pa.int64()) if from_doc is None else pa.array(from_doc, pa.int64()),
             pa.nulls(n, pa.int64()) if from_start is None else pa.array(from_start, pa.int64())],
            names=["doc", "place", "windows", "kind", "from_doc", "from_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None      # key1, key2, doc and start of the open key's first row
        pending = None   # that row, if it is the only key of its key1 so far
        for batch in batches:
            cols = [batch.column(k) for k in range(7)]
            copied = cols[5].is_valid().to_numpy(zero_copy_only=False)
            if copied.any():
                took = [c.filter(pa.array(copied)).to_numpy(zero_copy_only=False) for c in cols[2:]]
                yield batch_of(took[0], took[1], took[2], _COPY, took[3], took[4])
                cols = [c.filter(pa.array(~copied)) for c in cols]
            k1, k2, doc, place, windows = (c.to_numpy(zero_copy_only=False) for c in cols[:5])
            if not len(doc):
                continue
            start = place & _START
            new1, new2 = np.ones(len(doc), bool), np.ones(len(doc), bool)
            new1[1:] = k1[1:] != k1[:-1]
            if last is not None:
                new1[0] = k1[0] != last[0]
                new2[0] = new1[0] or k2[0] != last[1]
            new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
            lead = np.maximum.accumulate(np.where(new2, np.arange(len(doc)), -1))
            lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
            lead_start = np.where(lead >= 0, start[lead], last[3] if last else 0)
            later = ~new2 & ((doc != lead_doc) | (start != lead_start))
            if later.any():
                yield batch_of(doc[later], place[later], windows[later], _COPY, lead_doc[later], lead_start[later])
            if check:
                # Keys per run of key1; the first run may go on from before.
                run1 = np.cumsum(new1) - new1[0]
                keys = np.bincount(run1[new2], minlength=run1[-1] + 1) if new2.any() else np.zeros(run1[-1] + 1, int)
                if not new1[0] and last is not None:
                    keys[0] += 1 if pending is not None else 2
                    if keys[0] > 1 and pending is not None:
                        yield batch_of(*pending, _CHECK, None, None)
                        pending = None
                else:
                    pending = None
                crowded = (keys > 1)[run1]
                # a row at the same id and word number as its key's first row
                # (another row of the table) is checked like it
                take = crowded & ~later
                if take.any():
                    yield batch_of(doc[take], place[take], windows[take], _CHECK, None, None)
                if keys[-1] > 1:
                    pending = None
                elif run1[-1] > 0 or new1[0]:
                    own = (run1 == run1[-1]) & ~later
                    pending = (doc[own], place[own], windows[own])
                elif pending is not None:
                    own = ~later
                    pending = tuple(np.concatenate([p, x[own]]) for p, x in zip(pending, (doc, place, windows)))
            last = (k1[-1], k2[-1], lead_doc[-1], lead_start[-1])
    return run


def _emit_windows(window: int):
    """The windows of the blocks to check, keyed by two hashes of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            texts, spans = batch.column(2), batch.column(3)
            for a, b in slices_by_bytes((len(t.as_buffer()) for t in texts), BATCH_BYTES // 2):
                found = []
                for k in range(a, b):
                    codes = hash_words(texts[k].as_py(), powers)
                    own = spans[k].values.flatten()
                    first, count = (own[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    at = np.unique(at)
                    one = range_hashes(codes, at, at + window, powers)
                    two = range_hashes(mix64(codes ^ np.uint64(0x5DEECE66D)), at, at + window, powers)
                    found.append((one, two & np.uint64(0xFFFFFFFF), np.full(len(at), docs[k]), at + tags[k],
                                  np.ones(len(at), np.int32)))
                if found:
                    yield from _keyed(*(np.concatenate(c) for c in zip(*found)))
    return run


def factors(first: np.ndarray, count: np.ndarray, from_doc: np.ndarray, from_start: np.ndarray,
            window: int) -> list[tuple[int, int, int, int]]:
    """Copied spans joined left to right as long as document and source go on
    together: ``(start, words, source id, source start)``."""
    found: list[list[int]] = []
    for k in np.lexsort([-count, first]):
        s, e, d, f = int(first[k]), int(first[k] + count[k]) + window - 1, int(from_doc[k]), int(from_start[k])
        if found and found[-1][2] == d and found[-1][3] - found[-1][0] == f - s and s <= found[-1][1]:
            found[-1][1] = max(found[-1][1], e)
        else:
            found.append([s, e, d, f])
    return [(s, e - s, d, f) for s, e, d, f in found]


def _rewrite(window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()),
                               ("source_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for body, copied in zip(batch.column(1), batch.column(2)):
                words = body.as_py().split()
                own: list[tuple[int, int, int, int]] = []
                if copied.is_valid:
                    cols = [c.to_numpy(zero_copy_only=False) for c in copied.values.flatten()]
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(gone, cols[0], 1)
                    np.add.at(gone, np.minimum(cols[0] + cols[1] + window - 1, len(words)), -1)
                    stays = np.cumsum(gone[:-1]) == 0
                    own = factors(*cols, window)
                    left = [w for w, s in zip(words, stays.tolist()) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append([dict(zip(("start", "words", "source", "source_start"), x)) for x in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_removed", "kept", "factors"])
    return run


def copied_windows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(doc, place, windows, from_doc, from_start)``: runs of windows that
    start earlier, with the place of an earlier occurrence."""
    def sorted_runs(keyed: DataFrame) -> DataFrame:
        return keyed.repartition("key1").sortWithinPartitions(
            "key1", "key2", "doc", F.col("place").bitwiseAND(F.lit(_START)))

    keyed = rows.select("doc", "tag", "body").mapInArrow(_emit_blocks(window, anchor), _KEYED)
    parsed = table_checkpoint(sorted_runs(keyed).mapInArrow(_read_runs(True), _OUT), "rlz-blocks")
    checks = (parsed.where(F.col("kind") == _CHECK)
              .groupBy("doc", (F.col("place") - F.col("place").bitwiseAND(F.lit(_START))).alias("tag"))
              .agg(F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(_START)).alias("first"),
                                           "windows")).alias("spans")))
    bodies = rows.dropDuplicates(["doc", "tag"]).join(checks, ["doc", "tag"]).select("doc", "tag", "body", "spans")
    edges = bodies.mapInArrow(_emit_windows(window), _KEYED)
    checked = table_checkpoint(sorted_runs(edges).mapInArrow(_read_runs(False), _OUT), "rlz-windows")
    return (parsed.where(F.col("kind") == _COPY).unionByName(checked)
            .select("doc", "place", "windows", "from_doc", "from_start"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept, factors``.

    ``kept`` has the words that stay, joined by one space; ``factors`` the
    copied spans with the place they are copied from.  Windows are judged on
    the input, not on what is left.  A null text has no words.  Ids are whole
    numbers; a null id comes before all others.  Rows that share an id hold the
    same places: none of them makes a window at the same word number of another
    one go.  An empty table gives an empty result.
    """
    rows = docs.select(
        quoted(id_col).alias("doc_id"),
        F.coalesce(quoted(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.shiftleft(F.xxhash64(quoted(text_col)).bitwiseAND(F.lit((1 << 22) - 1)), 40).alias("tag"),
        text_or_empty(text_col).cast("binary").alias("body"))
    copied = copied_windows(rows.select("doc", "tag", "body"), window, anchor)
    place = F.col("place")
    spans = (copied.groupBy("doc", (place - place.bitwiseAND(F.lit(_START))).alias("tag"))
             .agg(F.collect_list(F.struct(place.bitwiseAND(F.lit(_START)).alias("first"), "windows",
                                          "from_doc", "from_start")).alias("copied")))
    joined = rows.join(spans, ["doc", "tag"], "left").select("doc_id", "body", "copied")
    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(
        _rewrite(window), f"doc_id {id_type}, n_words long, n_removed long, kept string, factors array<struct<"
        "start:long,words:long,source:long,source_start:long>>")

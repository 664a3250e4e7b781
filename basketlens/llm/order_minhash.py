"""Order MinHash: document fingerprints that follow the edit distance.

A text is read as pieces: words are cut into at most ``PIECE`` code points from
the word's start, so a text without spaces has pieces too.  The k-mers of
``K`` consecutive pieces are numbered by occurrence (the second time the same
k-mer appears it counts as another element).  Each of ``M`` hash functions
selects the ``L`` elements with the smallest hashes; the selected k-mers are
put back into text order and the tuple is hashed.  The fingerprint is the list
of the ``M`` tuple hashes, and the likeness of two fingerprints the share of
equal entries.  Two texts agree in an entry only if they share the selected
k-mers and have them in the same order, which bounds the edit distance from
both sides, unlike a plain MinHash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import mix64, quoted, text_or_empty

PIECE, K, L, M = 3, 3, 2, 64
_BLOCK = 1 << 15           # elements that are hashed by all functions at a time
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions."""
    seeds = mix64(np.arange(1, 2 * m + 1, dtype=np.uint64) * _STEPS[0])
    return seeds[:m, None] | np.uint64(1), seeds[m:, None]


def pieces(text: str) -> np.ndarray:
    """The pieces of a text, each as one exact number (three code points of 21
    bits and whether it begins a word)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (points == 32) | (points >= 9) & (points <= 13)
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    begins = np.empty(len(at), dtype=bool)
    begins[0] = True
    begins[1:] = at[1:] != at[:-1] + 1
    start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    inside = np.arange(len(at)) - start
    lead = np.flatnonzero(inside % PIECE == 0)
    codes = points[at].astype(np.uint64) + np.uint64(1)
    value = codes[lead].copy()
    for step in range(1, PIECE):
        nxt = lead + step
        ok = nxt < len(at)
        ok[ok] = inside[nxt[ok]] == inside[lead[ok]] + step
        value[ok] |= codes[nxt[ok]] << np.uint64(21 * step)
    return value | begins[lead].astype(np.uint64) << np.uint64(63)


def _occurrences(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    run = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    found = np.empty(len(x), dtype=np.uint64)
    found[order] = run.astype(np.uint64)
    return found


def fingerprint(text: str, k: int = K, l: int = L, m: int = M) -> np.ndarray:  # noqa: E741
    """``m`` 32-bit tuple hashes.  A text with fewer than ``k`` pieces is one
    k-mer of what it has; one without pieces has all entries 0."""
    part = mix64(pieces(text))
    if not len(part):
        return np.zeros(m, dtype=np.uint32)
    n = max(1, len(part) - k + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(part))):
        grams += part[i:i + n] * _STEPS[i % 3] + np.uint64(i)
    grams = mix64(grams)
    elements = mix64(grams + _occurrences(grams) * _STEPS[1])
    by, plus = _functions(m)
    best = best_at = None
    for a in range(0, n, _BLOCK):
        values = elements[None, a:a + _BLOCK] * by + plus
        values ^= values >> np.uint64(29)
        values *= _STEPS[2]
        take = min(l, values.shape[1])
        found = np.empty((m, take), dtype=np.int64)
        kept = np.empty((m, take), dtype=np.uint64)
        rows = np.arange(m)
        for i in range(take):
            at = values.argmin(axis=1)
            found[:, i], kept[:, i] = at + a, values[rows, at]
            values[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if best is not None:
            kept, found = np.concatenate([best, kept], axis=1), np.concatenate([best_at, found], axis=1)
            order = np.argsort(kept, axis=1, kind="stable")[:, :l]
            kept, found = np.take_along_axis(kept, order, axis=1), np.take_along_axis(found, order, axis=1)
        best, best_at = kept, found
    chosen = grams[np.sort(best_at, axis=1)]  # text order
    tuples = np.zeros(m, dtype=np.uint64)
    for i in range(chosen.shape[1]):
        tuples = mix64(tuples * _STEPS[0] + chosen[:, i] + np.uint64(i + 1))
    return (tuples >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """``doc_id, signature`` per row: ``m`` numbers from 0 to 2^32 - 1.  Null
    texts count as empty; equal texts have equal signatures; repeated rows and
    rows with a null id stay rows of their own."""
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, k, l, m).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))],
                                             names=["doc_id", "signature"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, signature array<long>")


# -- neighbours in id order --------------------------------------------------

def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Range bounds of the ids (at most ``parts - 1`` numbers on the driver)."""
    if parts < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)
                        .alias("q")).first()["q"]
    return sorted(set(found or []))


def _with_next(docs: DataFrame, parts: int, tasks: int) -> DataFrame:
    """``(part, guard, doc_id, tag, data)`` in ranges of ids, sorted; each
    range ends with the next range's first row as its guard (the last range
    with the table's first row).  Texts travel compressed."""
    edges = np.array(_bounds(docs, parts), dtype=np.int64)

    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.to_numpy(zero_copy_only=False)).astype(np.int32))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, tags, bodies = batch.columns
            yield pa.RecordBatch.from_arrays(
                [part_of(ids), ids, tags, pa.array([coder.compress(t.as_py()) for t in bodies], pa.binary())],
                names=["part", "doc_id", "tag", "data"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([part_of(batch.column(0)), batch.column(0)], names=["part", "doc_id"])

    # The first id of every range: as many numbers as there are ranges.
    lows = {r["part"]: r["low"] for r in docs.select("doc_id").mapInArrow(number, "part int, doc_id long")
            .groupBy("part").agg(F.min("doc_id").alias("low")).collect()}
    order = sorted(lows)
    ends = docs.sparkSession.createDataFrame([(lows[p], order[k - 1]) for k, p in enumerate(order)],
                                             "low long, part int")
    kind = "part int, doc_id long, tag long, data binary"
    firsts = (docs.join(F.broadcast(ends), F.col("doc_id") == F.col("low"))
              .groupBy("part", "doc_id").agg(F.min(F.struct("tag", "body")).alias("f"))
              .select("doc_id", "f.tag", "f.body", "part"))

    def guard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, tags, bodies, own = batch.columns
            yield pa.RecordBatch.from_arrays(
                [own, ids, tags, pa.array([coder.compress(t.as_py()) for t in bodies], pa.binary())],
                names=["part", "doc_id", "tag", "data"])

    both = (docs.mapInArrow(spread, kind).withColumn("guard", F.lit(0))
            .unionByName(firsts.mapInArrow(guard, kind).withColumn("guard", F.lit(1))))
    return (both.select("part", "guard", "doc_id", "tag", "data").repartition(tasks, "part")
            .sortWithinPartitions("part", "guard", "doc_id", "tag"))


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the
    first ones of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprints_and_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           parts: int | None = None) -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256, signature, edited_signature,
    near_edited, near_next``: the text against its edit by, and against, the
    next document in ascending id order (after the last comes the first).

    Ids are whole numbers.  Rows that share an id follow one another in the
    order of their texts' hashes, repeated rows as documents of their own.
    Rows with a null id come first.  A single document follows itself.  Null
    texts count as empty; two texts without pieces have likeness 1.
    """
    null_id = -(1 << 63)
    # More ranges than tasks, so that their hashes fill the tasks evenly.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 8 * tasks
    rows = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit(null_id)).alias("doc_id"),
                       F.xxhash64(quoted(text_col)).alias("tag"),
                       text_or_empty(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        held = None  # the row before: part, id, text, signature
        for batch in batches:
            out = []
            for part, guard, doc_id, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                text = reader.decompress(data).decode()
                mine = fingerprint(text)
                if held and held[0] == part:
                    changed = edit(held[2], text)
                    theirs = fingerprint(changed)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(),
                                held[3].tolist(), theirs.tolist(), likeness(held[3], theirs),
                                likeness(held[3], mine)))
                held = None if guard else (part, doc_id, text, mine)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                         pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["doc_id", "n_chars", "edited_sha256", "signature", "edited_signature",
                           "near_edited", "near_next"])

    found = _with_next(rows, parts, tasks).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, signature array<long>, "
        "edited_signature array<long>, near_edited double, near_next double")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(null_id)))

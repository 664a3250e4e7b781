"""SimHash near-duplicates: fingerprints and groups of linked fingerprints.

A fingerprint bit is 1 when more than half of the document's shingle hashes
(XXH64, seed 42) have it.  Two documents are linked when their fingerprints
differ in at most two bits; a group is everything reachable over links.

Links by deletion variants.  The 64 bits are cut into two segments of 32, so
of two fingerprints at distance two or less one segment differs in at most
one bit.  Each distinct fingerprint is indexed under every segment with one
bit taken out (2 x 32 keys); two segments that differ in at most one bit
share such a key.  The fingerprints that share a key are compared and
verified by their full distance.

Only distinct fingerprints are indexed, so copies cost one row.  A key can
still be shared by many distinct fingerprints, whose pairs would grow with
the square.  Keys shared by more than ``RUN`` fingerprints therefore emit no
pairs; their fingerprints go to an exact second index: each is filed under
itself and its 64 one-bit neighbours.  Two fingerprints are at distance two
or less exactly when they share such a point, everything filed under a point
is within distance two of everything else there, and no point has more than
65 entries.  So one link from each entry to the point's smallest entry is
enough, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import LOWER, quoted, text_or_empty
from basketlens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
RUN = 32
_BLOCK = 1 << 15  # hashes whose bits are unpacked at a time


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned 64-bit number (no word: 0)."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    shingles = words if k == 1 else map(b" ".join, zip(*(words[i:] for i in range(k))))
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` per row; ``fp`` is the fingerprint's 64 bits
    as a signed long, ``text_hash`` tells rows with the same id apart."""
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"),
                       text_or_empty(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle_words)
                              for t in batch.column("body")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"),
                                              pa.array(found)], names=["doc_id", "text_hash", "fp"])

    return slim.mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _flip(fp: Column, bits: range) -> list[Column]:
    return [fp.bitwiseAND(F.lit(~(1 << b) if b < 63 else 0x7FFFFFFFFFFFFFFF)) for b in bits]


def _variants(fps: DataFrame) -> DataFrame:
    """``(slot, part, fp)``: each segment with one bit taken out; ``slot``
    names that bit, ``part`` is what is left of the segment."""
    fp = F.col("fp")
    masks = [0xFFFFFFFF, 0xFFFFFFFF << 32]
    keys = []
    for b in range(64):
        mask = masks[b // 32] & ~(1 << b)
        keys.append(F.struct(F.lit(b).alias("slot"),
                             fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.slot", "k.part", "fp")


def _runs(max_bits: int, longest: int):
    """Verified pairs inside runs of equal keys (rows come sorted by key).  A
    run of more than ``longest`` rows gives no pair: its rows come out with
    ``b`` null instead.  At most one run's start is held between batches."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(a, b, known=True):
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b) if known else pa.nulls(len(a), pa.int64())], schema=out)

    def handle(slot, part, fp, open_run):
        """Rows of whole runs (the last may go on: ``open_run`` rows of it were
        given out as belonging to a long run before)."""
        if not len(fp):
            return
        first = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (part[1:] != part[:-1])]))
        length = np.diff(np.concatenate([first, [len(fp)]]))
        length_at = np.repeat(length, length)
        if open_run:
            length_at[:length[0]] = longest + 1
        long = length_at > longest
        if long.any():
            yield emit(fp[long], None, False)
        left = length_at - (np.arange(len(fp)) - np.repeat(first, length))
        left[long] = 0
        for step in range(1, longest):
            at = np.flatnonzero(left > step)
            if not len(at):
                break
            a, b = fp[at], fp[at + step]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
            if near.any():
                yield emit(a[near], b[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        open_run = False  # the first run continues one already known to be long
        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)])
                    for i, h in enumerate(held)]
            slot, part, fp = cols
            same = (slot == slot[-1]) & (part == part[-1])
            cut = len(fp) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from handle(slot[:cut], part[:cut], fp[:cut], open_run)
                open_run = False
            if len(fp) - cut > longest or (open_run and cut == 0):
                # The open run is long: give its rows out, keep its key alone.
                yield emit(fp[cut:], None, False)
                open_run = True
                held = [slot[-1:], part[-1:], fp[-1:]]
            else:
                held = [slot[cut:], part[cut:], fp[cut:]]
        yield from handle(*held, open_run)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, longest: int = RUN) -> DataFrame:
    """``(a, b)`` links between the distinct values of ``fp``: a set of pairs
    at distance ``max_bits`` (at most 2) or less that connects everything such
    pairs connect."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one bit taken out cover at most two differing bits")
    keyed = _variants(fps).repartition("slot", "part").sortWithinPartitions("slot", "part", "fp")
    found = table_checkpoint(keyed.mapInArrow(_runs(max_bits, longest), "a long, b long"), "simhash-runs")
    pairs = found.where(F.col("b").isNotNull()).select("a", "b")
    crowded = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if max_bits < 2:
        # Points at distance one from both would join fingerprints two bits
        # apart, so each is compared with the members one bit away only.
        near = crowded.select(F.col("fp").alias("a"), F.explode(F.array(
            *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64 if max_bits else 0)]
            or [F.col("fp")])).alias("b"))
        stars = near.join(crowded.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b")
    else:
        points = crowded.select("fp", F.explode(F.array(
            F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("z"))
        stars = (points.groupBy("z").agg(F.collect_list("fp").alias("near"))  # 65 entries at most
                 .where(F.size("near") > 1)
                 .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
                 .where(F.col("a") != F.col("b")))
    return pairs.unionByName(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicate_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                          max_bits: int = MAX_BITS, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_hash, fp, component_id, keeper_hash``.

    ``component_id`` is the smallest id in the row's group and ``keeper_hash``
    the text hash of the row that carries it.  Null texts count as empty and
    all texts without a word share fingerprint 0.  Rows with a null id take
    part, and name a group only when no row in it has an id.  Repeated rows
    fall into one group.  An empty table gives an empty result.
    """
    prints = table_checkpoint(fingerprints(docs, shingle_words, id_col, text_col), "simhash-prints")
    # Copies collapse map-side into one row per fingerprint.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = prints.groupBy("fp").agg(first.alias("first"))
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    label = (rooted.join(named, "root")
             .select("fp", F.col("keeper.doc_id").alias("component_id"),
                     F.col("keeper.text_hash").alias("keeper_hash")))
    return prints.join(label, "fp").select("doc_id", "text_hash", "fp", "component_id", "keeper_hash")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                         max_bits: int = MAX_BITS, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The input with one row of each near-duplicate group: the one with the
    group's smallest id.  All columns stay as they are.  Rows that agree in id
    and text count once."""
    groups = near_duplicate_groups(docs, shingle_words, max_bits, id_col, text_col)
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash"))
    drop = groups.where(~keeps).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"),
                       quoted(id_col).alias("i"), F.xxhash64(quoted(text_col)).alias("h"))
    kept = rows.join(drop, rows["i"].eqNullSafe(drop["i"]) & (rows["h"] == drop["h"]), "left_anti")
    return kept.dropDuplicates(["i", "h"]).select("row.*")

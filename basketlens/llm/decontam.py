"""Benchmark decontamination: BM25 over test items, block-max WAND, then
question and answer overlap.

The test items make an inverted index: per word the items that hold it, with
their BM25 impact, in blocks that know their largest impact.  An item's
impacts are divided by its own total, so an item that a passage holds whole
scores 1 and one threshold serves items of any length.

Every document is cut into overlapping passages, twice as long as the longest
item and one item length apart, so a copy of an item lies whole in one of
them.  Each passage is a query and retrieves every item that reaches the
threshold.  The search is exact and bounded twice:

* the items are cut into blocks; the sum of a block's largest impacts over a
  passage's distinct words bounds all its items, and blocks whose bound stays
  below the threshold are skipped for the passage (all passages of a document
  at once);
* in the blocks left, block-max WAND walks the posting lists of the passage's
  words in item order: the pivot is the first list at which the summed bounds
  reach the threshold, and only items that may reach it are scored.

A retrieved item is verified by its word shingles (five words; fewer if it is
shorter): the passage must hold at least ``OVERLAP`` of the question's and of
the answer's.  The answer is the item's last sentence or line, the question
what stands before; an item of one sentence is all question.

The index is bounded: items are dealt into shards of about ``SHARD_BYTES`` of
text, and the documents are read once per shard.  Postings, block maxima and
the items' words are flat arrays with one entry per posting, block of a posting
list and word, so an index is a few times as large as its items' text, whatever
their words.  One shard's index exists at a time: with several shards, what one
finds is written before the next is built.  Rows that agree in id and text are
one entry with a number of copies.  Item count, mean and largest length and
document frequencies are those of the whole benchmark, so scores do not depend
on the number of shards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import LOWER, quoted, schema_plus, share, sharing, text_or_empty

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK_ITEMS = 4
SHARD_BYTES = 4 << 20
_CELLS = 1 << 20  # passages x blocks that are bounded at once
_ANSWER = re.compile(rb"(?<=[.!?\n])\s+(?=\S)|\n+(?=\S)")


# Lower-cases A-Z and turns every other ASCII character but digits into a space.
_PLAIN = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation, so that what stands next to a
    copied item cannot change its first and last word."""
    return text.translate(_PLAIN).split()


def shingles(words: list) -> set[tuple]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in (words_of(x) for x in _ANSWER.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Index:
    """Words are numbered from 1; number 0 stands for all others.  ``lists``,
    ``posts`` and ``texts`` are offsets: the blocks of word ``w`` are
    ``lists[w]:lists[w + 1]``, the postings of the ``e``-th of them
    ``posts[e]:posts[e + 1]``."""

    items: list[tuple[int, int]]        # id and copies of the items, in block order
    vocabulary: dict[bytes, int]
    lists: np.ndarray                   # (words + 2)
    blocks: np.ndarray                  # per block of a list: its number
    largest: np.ndarray                 # ... and its largest impact
    posts: np.ndarray
    at: np.ndarray                      # per posting: item number
    by: np.ndarray                      # ... and impact
    texts: np.ndarray                   # (items + 1), offsets of the items' words
    words: np.ndarray
    question: np.ndarray                # per item: words before the answer
    longest: int                        # words of the longest item

    @property
    def n_blocks(self) -> int:
        return -(-len(self.items) // BLOCK_ITEMS)

    def postings(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.posts[self.lists[word]], self.posts[self.lists[word + 1]]
        return self.at[a:b], self.by[a:b]

    def parts(self, item: int) -> tuple[set, set]:
        """Shingles of the item's question and answer."""
        ws = self.words[self.texts[item]:self.texts[item + 1]].tolist()
        return shingles(ws[:self.question[item]]), shingles(ws[self.question[item]:])


@dataclass
class Collection:
    """What scores need to know of the whole benchmark (``df``: at least of the
    words of the items to index)."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]


def build_index(rows: list[tuple[int, bytes, int]], whole: Collection | None = None) -> Index | None:
    """Items ``(id, text, copies)`` without a word are left out; None when none
    is left.  ``rows`` are a part of the collection ``whole``, by default all
    of it."""
    known = [(i, sum(question_and_answer(t), []), len(question_and_answer(t)[0]), c) for i, t, c in rows]
    known = sorted((x for x in known if x[1]), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[1]))
    if not known:
        return None
    if whole is None:
        n = sum(c for _, _, _, c in known)
        df: Counter = Counter()
        for _, ws, _, c in known:
            for w in set(ws):
                df[w] += c
        whole = Collection(n, sum(len(ws) * c for _, ws, _, c in known) / n, max(len(ws) for _, ws, _, _ in known), df)
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws, _, _ in known for w in ws}))}
    rarity = np.zeros(len(vocabulary) + 1)
    for w, k in vocabulary.items():
        rarity[k] = np.log1p((whole.n - whole.df[w] + 0.5) / (whole.df[w] + 0.5))
    words = [np.fromiter(map(vocabulary.__getitem__, ws), dtype=np.int32, count=len(ws)) for _, ws, _, _ in known]
    held, at, by = [], [], []
    for number, ws in enumerate(words):
        own, tf = np.unique(ws, return_counts=True)
        impact = rarity[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / whole.mean))
        held.append(own)
        at.append(np.full(len(own), number, dtype=np.int32))
        by.append(impact / impact.sum())
    held, at, by = np.concatenate(held), np.concatenate(at), np.concatenate(by)
    order = np.argsort(held, kind="stable")  # by word, then item
    held, at, by = held[order], at[order], by[order]
    block = at // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]) | (block[1:] != block[:-1])]))
    # float32 bounds must not fall below the doubles they bound
    largest = (np.maximum.reduceat(by, first) * (1 + 1e-4)).astype(np.float32)
    return Index([(i, c) for i, _, _, c in known], vocabulary,
                 np.searchsorted(held[first], np.arange(len(vocabulary) + 2)), block[first], largest,
                 np.append(first, len(at)), at, by, np.concatenate([[0], np.cumsum([len(ws) for ws in words])]),
                 np.concatenate(words), np.array([q for _, _, q, _ in known], dtype=np.int32), whole.longest)


def block_bounds(index: Index, passage: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """``(n, blocks)``: per passage and block the sum of the block's largest
    impacts over the passage's words, which are given as pairs."""
    first, sizes = index.lists[word], index.lists[word + 1] - index.lists[word]
    ends = np.cumsum(sizes)
    entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
    cells = np.repeat(passage * index.n_blocks, sizes) + index.blocks[entry]
    return np.bincount(cells, index.largest[entry], n * index.n_blocks).reshape(n, index.n_blocks)


def block_max_wand(index: Index, words: list[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items of ``blocks`` whose summed impact over the query's distinct
    ``words`` reaches the threshold, with their scores."""
    found = []
    spans = [(a, b, index.blocks[a:b]) for a, b in ((index.lists[w], index.lists[w + 1]) for w in words) if a < b]
    for block in blocks:
        lists = []
        for a, b, own in spans:
            e = a + int(own.searchsorted(block))
            if e < b and index.blocks[e] == block:
                p, q = index.posts[e], index.posts[e + 1]
                lists.append([index.at[p:q].tolist(), index.by[p:q].tolist(), 0, float(index.largest[e])])
        while True:
            lists = [x for x in lists if x[2] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[2]])
            total, pivot = 0.0, None
            for x in lists:
                total += x[3]
                if total >= threshold:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][2]] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[2]] != pivot:
                        break
                    score += x[1][x[2]]
                    x[2] += 1
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for x in lists:
                    if x[0][x[2]] >= pivot:
                        break
                    while x[2] < len(x[0]) and x[0][x[2]] < pivot:
                        x[2] += 1
    return found


def passages(n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, max(1, n - longest), longest)
    return starts, np.minimum(starts + 2 * longest, n)


def search_text(index: Index, text: bytes, threshold: float, overlap: float) -> list[tuple]:
    """``(item, word start, words, score, question, answer)`` of each verified
    item, its best passage."""
    words = words_of(text)
    if not words:
        return []
    get = index.vocabulary.get
    rows = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
    starts, ends = passages(len(words), index.longest)
    step = max(1, min(256, _CELLS // index.n_blocks))
    best: dict[int, tuple] = {}
    for k0 in range(0, len(starts), step):
        s, e = starts[k0:k0 + step], ends[k0:k0 + step]
        base = int(s[0])
        near = rows[base:int(e[-1])]
        held = np.flatnonzero(near)
        if not len(held):
            continue
        # distinct words of each passage, as (passage, word) keys
        first, last = np.searchsorted(held, s - base), np.searchsorted(held, e - base)
        which = np.repeat(np.arange(len(s)), last - first)
        within = np.arange(len(which)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        keys = np.unique(which.astype(np.int64) << 32 | near[held[np.repeat(first, last - first) + within]])
        which, row = keys >> 32, keys & 0xFFFFFFFF
        hot = block_bounds(index, which, row, len(s)) >= threshold
        for p in np.flatnonzero(hot.any(axis=1)).tolist():
            a, b = np.searchsorted(which, [p, p + 1])
            own = None
            for item, score in block_max_wand(index, row[a:b].tolist(), np.flatnonzero(hot[p]).tolist(), threshold):
                if own is None:
                    own = shingle_sets(rows[s[p]:e[p]].tolist())
                q, r = (covered(part, own) for part in index.parts(item))
                if q >= overlap and r >= overlap:
                    hit = (index.items[item][0], int(s[p]), int(e[p] - s[p]), score, q, r)
                    if item not in best or (score, -hit[1]) > (best[item][3], -best[item][1]):
                        best[item] = hit
    return [best[k] for k in sorted(best) for _ in range(index.items[k][1])]


def shingle_sets(words: list) -> list[set]:
    """Shingles of one to five words: an item's part of fewer than five words
    is one shingle of all its words."""
    return [set(zip(*(words[i:] for i in range(k)))) for k in range(1, SHINGLE + 1)]


def covered(part: set[tuple], own: list[set]) -> float:
    """Share of an item part's shingles that the passage holds (1 if the part
    has none)."""
    if not part:
        return 1.0
    have = own[len(next(iter(part))) - 1]
    return sum(x in have for x in part) / len(part)


def item_words(items: DataFrame) -> DataFrame:
    """``(n, copies, terms)`` per item with a word: its words' number, its
    copies and its distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(body.as_py()) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(ws) for ws in found], pa.int64()), batch.column(1),
                 pa.array([sorted(set(ws)) for ws in found], pa.list_(pa.binary()))], names=["n", "copies", "terms"])

    return (items.select("body", "copies").mapInArrow(run, "n long, copies long, terms array<binary>")
            .where("n > 0"))


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[Index]]:
    """The number of item shards and their indexes, each built when it is asked
    for: the driver holds one shard of about ``SHARD_BYTES`` of text at a time."""
    items = (benchmark.groupBy(quoted(id_col).cast("long").alias("i"),
                               text_or_empty(text_col).cast("binary").alias("body"))
             .agg(F.count(F.lit(1)).alias("copies")))
    size = items.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    shards = 1 + size // SHARD_BYTES

    def build() -> Iterator[Index]:
        dealt = items
        if shards > 1:
            dealt = table_checkpoint(items, "decontam-items")
            counted = item_words(dealt)
            copies = F.col("copies")
            sums = counted.agg(F.sum(copies).alias("n"), F.sum(F.col("n") * copies).alias("words"),
                               F.max("n").alias("longest")).first()
            if not sums["n"]:
                return  # no item has a word
            frequencies = table_checkpoint(counted.select(F.explode("terms").alias("w"), "copies").groupBy("w")
                                           .agg(F.sum("copies").alias("df")), "decontam-frequencies")
        for k in range(shards):
            own, whole = dealt, None
            if shards > 1:
                own = dealt.where(F.pmod(F.xxhash64("i", "body"), F.lit(shards)) == k)
                # No more words than the shard's text has.
                met = item_words(own).select(F.explode("terms").alias("w")).distinct().join(frequencies, "w").collect()
                whole = Collection(sums["n"], sums["words"] / sums["n"], sums["longest"],
                                   {bytes(r["w"]): r["df"] for r in met})
            index = build_index([(r["i"], bytes(r["body"]), r["copies"]) for r in own.collect()], whole)
            if index:
                yield index

    return shards, build()


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item it holds: ``doc_id, item_id,
    word_start, words, score, question_overlap, answer_overlap`` (the item's
    best passage in the document; ties go to the first).

    Null and empty texts, and items without a word, give no row.  Repeated
    documents and repeated items each give their rows.  Empty tables give an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    names = ("item_id", "word_start", "words", "score", "question_overlap", "answer_overlap")
    ddl = "item_id long, word_start long, words long, score double, question_overlap double, answer_overlap double"
    schema = schema_plus(rows, ["doc_id"], ddl)

    def run(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        for batch in batches:
            at, hits = [], []
            for k, body in enumerate(batch.column(1)):
                found = search_text(index, body.as_py(), threshold, overlap)
                at += [k] * len(found)
                hits += found
            if hits:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)),
                     *(pa.array(c, t) for c, t in zip(zip(*hits), kinds))], names=["doc_id", *names])

    return _by_shard(spark, benchmark, lambda shared: rows.mapInArrow(partial(run, shared), schema),
                     spark.createDataFrame([], schema), "decontam-hits")


def _by_shard(spark, benchmark: DataFrame, apply, none: DataFrame, name: str) -> DataFrame:
    """Union of ``apply`` of every shard's index; of several shards each result
    is written before the next index is built."""
    shards, built = indexes(benchmark)
    found = []
    for index in built:
        if shards == 1:
            return apply(share(spark, index))
        with sharing(spark, index) as shared:
            found.append(table_checkpoint(apply(shared), name))
    return reduce(DataFrame.unionByName, found) if found else none


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                      overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns.

    Rows with a null or empty text stay, and so do all rows when no item has a
    word.  Rows with equal texts stay or go together; ids play no part.  The
    name of the text column is matched as Spark does.  With one item shard the
    documents are filtered as they are read; with several, every shard gives
    the digests of the texts that it finds, and the documents meet them once.
    """
    spark = docs.sparkSession
    digest = F.sha2(text_or_empty(text_col).cast("binary"), 256)
    bodies = docs.select(text_or_empty(text_col).cast("binary").alias("body"), digest.alias("d"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def clean(shared, column: int, kept: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        for batch in batches:
            texts = (t.encode() if isinstance(t, str) else t or b"" for t in batch.column(column).to_pylist())
            yield batch.filter(pa.array([(not search_text(index, t, threshold, overlap)) == kept for t in texts],
                                        pa.bool_()))

    shards, built = indexes(benchmark)
    if shards == 1:
        index = next(built, None)
        return docs if index is None else docs.mapInArrow(partial(clean, share(spark, index), at, True), docs.schema)
    found = _by_shard(spark, benchmark, lambda shared: bodies.mapInArrow(partial(clean, shared, 0, False), bodies.schema)
                      .select("d").distinct(), spark.createDataFrame([], "d string"), "decontam-texts")
    return docs.join(found.distinct(), digest == F.col("d"), "left_anti")

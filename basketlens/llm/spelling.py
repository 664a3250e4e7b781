"""Grouping of spelling variants by k-d trees over letter counts.

A word is a vector of letter counts.  One replaced letter moves it by an L1
distance of two at the most, one inserted or deleted letter by one, so the near
words of a word are found by range searches in k-d trees: for every pair of
lengths (the word's own, and one more) a search of radius two or one, in which
a subtree is left out when its box is farther away.  What a search finds is
verified by the order of the letters.

Counts are kept in unary, as bits "this letter occurs at least c times"
(``BITS``): the L1 distance of two vectors is the number of differing bits.
Counts beyond the kept ones are cut, which can only lower a distance, so nothing
is missed and the verification decides.  A k-d split is one such bit, a box is
the AND and the OR of its vectors, and the distance from a vector to a box is
``popcount(low & ~v) + popcount(v & ~high)``.

The trees are distributed.  For every length with more words than a cell takes,
an upper tree is fitted on the driver on a sample (``SAMPLE`` words per cell of
that length, all of them by a hash, ``SAMPLE_WORDS`` in total at the most).  Its
leaves are cells; its boxes are the bits on the path, so they hold for all
words, sampled or not.  Every word goes to its one cell, and as a query to all
cells within the radius.  A task then builds the lower tree of one cell, with
tight boxes, and runs the cell's queries through it.  Few cells are within
reach of a query: with depth D, at most D paths differ in one bit from its own
and D * D / 2 in two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import quoted, share, text_or_empty

LEAST_LENGTH = 5
LEAST_COUNT = 3
DAMAGE = 97
RATIO = 2
CELL = 4096            # words of a cell, fewer where words are long
CELL_BYTES = 1 << 22
LEAF = 32              # words of a lower tree's leaf
SAMPLE, SAMPLE_WORDS = 128, 1 << 20
PAIR_BYTES = 1 << 24
RUN = "[A-Za-zÀ-ÿ]"


def _bits() -> tuple[np.ndarray, np.ndarray]:
    """The bits by letter: a to z up to four times, the others up to twice."""
    letters = [(c, n) for c in range(97, 123) for n in range(1, 5)]
    letters += [(c, n) for c in range(0xC0, 0x100) for n in range(1, 3)]
    return np.array([c for c, _ in letters]), np.array([n for _, n in letters])


BIT_LETTER, BIT_COUNT = _bits()
LANES = 4


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """Words as rows of Latin-1 codes (0 after the end) to unary counts, four
    64-bit lanes per word."""
    n = len(letters)
    counts = np.zeros((n, 256), dtype=np.uint32)
    for column in letters.T:  # as many steps as the words have letters
        counts[np.arange(n), column] += 1
    flags = counts[:, BIT_LETTER] >= BIT_COUNT
    packed = np.packbits(flags, axis=1, bitorder="little")
    padded = np.zeros((n, LANES * 8), dtype=np.uint8)
    padded[:, :packed.shape[1]] = packed
    return padded.view(np.uint64)


def letter_rows(words: list[str]) -> np.ndarray:
    """Words of at most one length range as a matrix of Latin-1 codes."""
    raw = [w.encode("latin-1") for w in words]
    width = max(map(len, raw), default=1)
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), dtype=np.uint8).reshape(len(raw), width)


def popcount(lanes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(lanes).sum(axis=-1, dtype=np.int64)


class KdTree:
    """A k-d tree over letter bits.  Leaves are numbered in order; ``tight``
    boxes bound the vectors given, the others hold for all vectors that the
    splits send there."""

    def __init__(self, vectors: np.ndarray, leaf: int, tight: bool) -> None:
        self.split: list[int] = []          # bit, or -1 - leaf number
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []  # members of the leaves
        self.tight, self.size = tight, leaf
        free = np.zeros(LANES, dtype=np.uint64)
        self._build(vectors, np.arange(len(vectors)), free, ~free)

    def _build(self, vectors: np.ndarray, members: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
        mine = vectors[members]
        node = len(self.split)
        if self.tight and len(members):
            low, high = np.bitwise_and.reduce(mine), np.bitwise_or.reduce(mine)
        self.split.append(-1)
        self.low.append(low)
        self.high.append(high)
        self.children.append((-1, -1))
        bit = self._best_bit(mine) if len(members) > self.size else None
        if bit is None:
            self.split[node] = -1 - len(self.leaves)
            self.leaves.append(members)
            return node
        lane, mask = bit >> 6, np.uint64(1 << (bit & 63))
        has = (mine[:, lane] & mask) != 0
        without, having = high.copy(), low.copy()
        without[lane] &= ~mask
        having[lane] |= mask
        self.split[node] = bit
        self.children[node] = (self._build(vectors, members[~has], low, without),
                               self._build(vectors, members[has], having, high))
        return node

    @staticmethod
    def _best_bit(mine: np.ndarray) -> int | None:
        """The bit that parts the vectors most evenly; None if all are equal."""
        flags = np.unpackbits(np.ascontiguousarray(mine).view(np.uint8), axis=1, bitorder="little")
        ones = flags.sum(axis=0, dtype=np.int64)
        side = np.minimum(ones, len(mine) - ones)
        best = int(side.argmax())
        return best if side[best] else None

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf numbers, each with the queries whose ball meets its box."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, active = todo.pop()
            q = queries[active]
            near = popcount(self.low[node] & ~q) + popcount(q & ~self.high[node]) <= radius
            active = active[near]
            if not len(active):
                continue
            if self.split[node] < 0:
                yield -1 - self.split[node], active
            else:
                todo += [(c, active) for c in self.children[node]]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that the splits send each vector to."""
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, active = todo.pop()
            bit = self.split[node]
            if bit < 0:
                out[active] = -1 - bit
                continue
            has = (vectors[active, bit >> 6] & np.uint64(1 << (bit & 63))) != 0
            todo += [(self.children[node][0], active[~has]), (self.children[node][1], active[has])]
        return out


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             damage: int | None = DAMAGE) -> DataFrame:
    """``(word, n)``: the distinct runs of letters, A to Z in lower case, of at
    least ``least_length`` letters, and how often they occur.

    ``damage``: where it divides the CRC-32 of ``<id>:<run>``, the run loses
    the letter at that number modulo its length (None: no run does).  A null id
    reads ``null``, a null text has no words.
    """
    found = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("i"),
                        F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"{RUN}{{{least_length},}}"),
                                                       F.lit(0))).alias("run"))
    # Runs without capitals, by far the most, are taken as they are.
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                          "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run"))
    found = found.withColumn("run", run)
    if damage:
        h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        found = found.select(F.when(h % damage == 0, F.concat(F.substring(F.col("run"), F.lit(1), at),
                                                              F.substring(F.col("run"), at + 2, F.length("run"))))
                             .otherwise(F.col("run")).alias("run"))
        found = found.where(F.length("run") >= least_length)
    return found.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def cell_words(length: int) -> int:
    return max(16, min(CELL, CELL_BYTES // length))


def fit_cells(words: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> dict[int, KdTree]:
    """The upper trees of all lengths with more words than a cell takes, from
    a sample: per length ``sample`` words for each cell, by a hash, less if all
    lengths together would take more than ``sample_words``."""
    # Lengths of at least one full cell: one row for every 16 words at the most.
    room = F.greatest(F.lit(16), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.col("length"))))
    sized = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).withColumn("room", room)
    large = sized.where(F.col("words") > F.col("room"))
    total = large.agg(F.sum(F.col("words") / F.col("room")).alias("cells")).first()["cells"]
    if not total:
        return {}
    each = max(2, min(sample, int(sample_words / total)))
    drawn = (words.withColumn("length", F.length("word")).join(large, "length")
             .where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(float(1 << 30) * each) / F.col("room"))
             .select("length", "word").toPandas())  # at most about ``sample_words``
    return {int(length): KdTree(letter_bits(letter_rows(group["word"].tolist())), each, tight=False)
            for length, group in drawn.groupby("length")}


MEMBER, SAME, LONGER = range(3)


def _route(trees: Callable[[], dict[int, KdTree]]):
    """Words to their cell (MEMBER), and as queries to the other cells in
    reach of their own length (SAME) and of the next (LONGER)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees()
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            counts = batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                vectors = letter_bits(letter_rows(words[rows].tolist()))
                own, longer = known.get(int(length)), known.get(int(length) + 1)
                home = own.home(vectors) if own else np.zeros(len(rows), dtype=np.int64)
                found = [(MEMBER, home, np.arange(len(rows)))]
                if own:
                    for leaf, active in own.visit(vectors, 2):
                        active = active[home[active] != leaf]
                        found.append((SAME, np.full(len(active), leaf), active))
                if longer:
                    found += [(LONGER, np.full(len(active), leaf), active) for leaf, active in longer.visit(vectors, 1)]
                else:
                    found.append((LONGER, np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))))
                kind = np.concatenate([np.full(len(i), k, dtype=np.int8) for k, _, i in found])
                leaf = np.concatenate([x for _, x, _ in found])
                at = rows[np.concatenate([i for _, _, i in found])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(kind == LONGER, length + 1, length)), pa.array(leaf),
                     pa.array(kind), batch.column(0).take(pa.array(at)), pa.array(counts[at])],
                    names=["length", "leaf", "kind", "word", "n"])

    return run


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows ``b`` that are ``a`` with one letter put in (``b`` one longer)."""
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


class Best:
    """Per word: near words, and the one of largest count (ties: smallest)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> None:
        self.words, self.counts = words, counts
        # Larger counts first, then words in code-point order.
        order = np.lexsort((ranks, -counts))
        self.by_rank = order
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[order] = np.arange(len(words))
        self.near = np.zeros(len(words), dtype=np.int64)
        self.best = np.full(len(words), len(words), dtype=np.int64)

    def add(self, of: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.near, of, 1)
        np.minimum.at(self.best, of, self.rank[other])

    def table(self) -> pa.Table:
        has = np.flatnonzero(self.near)
        best = self.by_rank[self.best[has]]
        return pa.table({"word": pa.array(self.words[has].tolist(), pa.string()), "near": pa.array(self.near[has]),
                         "best_n": pa.array(self.counts[best]), "best": pa.array(self.words[best].tolist(), pa.string())})


def _search(table: pa.Table) -> pa.Table:
    """One cell: its members and the queries that reach it."""
    words = np.array(table.column("word").to_pylist(), dtype=object)
    counts, kind = table.column("n").to_numpy(), table.column("kind").to_numpy()
    order = np.argsort(words)
    ranks = np.empty(len(words), dtype=np.int64)
    ranks[order] = np.arange(len(words))
    best = Best(words, counts, ranks)
    members = np.flatnonzero(kind == MEMBER)
    if not len(members):
        return best.table()
    own = letter_rows(words[members].tolist())
    vectors = letter_bits(own)
    tree = KdTree(vectors, LEAF, tight=True)
    for query_kinds, radius, verify in (((MEMBER, SAME), 2, one_replaced), ((LONGER,), 1, one_more)):
        asking = np.flatnonzero(np.isin(kind, query_kinds))
        if not len(asking):
            continue
        letters = letter_rows(words[asking].tolist())
        asked = letter_bits(letters)
        for leaf, active in tree.visit(asked, radius):
            inside = tree.leaves[leaf]
            step = max(1, PAIR_BYTES // (len(inside) * (LANES * 8 + letters.shape[1])))
            for a in range(0, len(active), step):
                part = active[a:a + step]
                close = popcount(asked[part][:, None, :] ^ vectors[inside][None, :, :]) <= radius
                q, m = np.nonzero(close)
                q, m = part[q], inside[m]
                good = verify(letters[q], own[m])
                q, m = asking[q[good]], members[m[good]]
                best.add(q, m)
                if verify is one_more:
                    best.add(m, q)
    return best.table()


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of all words of ``(word, n)`` that have
    a near word: how many, and the one that occurs most (ties: the smallest in
    code-point order)."""
    trees = share(words.sparkSession, fit_cells(words))
    routed = words.select("word", "n").mapInArrow(_route(trees), "length long, leaf long, kind byte, word string, n long")
    found = routed.groupBy("length", "leaf").applyInArrow(_search, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("f"))
            .select("word", "n_near", F.col("f.w").alias("best"), (-F.col("f.m")).alias("best_n")))


def roots_of(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(word, root)`` for all of ``(word, form)``: the last word that the
    forms lead to.  Counts at least double along a chain, so it ends; every
    round halves what is left of it."""
    at = table_checkpoint(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        step = at.select(F.col("word").alias("w"), F.col("root").alias("further"))
        nxt = table_checkpoint(
            at.join(step, at["root"] == step["w"], "left")
            .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        at = nxt.select("word", "root")
    raise RuntimeError(f"spelling: chains not settled after {max_rounds} rounds")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                   least_count: int = LEAST_COUNT, damage: int | None = None, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of at least
    ``least_length`` letters that occurs ``least_count`` times.

    Two words are near if one inserted, deleted or replaced letter turns one
    into the other.  A word's ``form`` is its near word of the largest count
    (ties: the smallest in code-point order) if that is at least ``ratio``
    times its own, else null; its ``root`` is where the forms lead.

    Null and empty texts have no words; ids matter for ``damage`` only (see
    :func:`words_of`); repeated rows count as often as they stand there.  An
    empty table gives an empty result; other columns are ignored.
    """
    words = table_checkpoint(words_of(docs, id_col, text_col, least_length, damage)
                             .where(F.col("n") >= least_count), "spelling-words")
    found = near_words(words).withColumnRenamed("word", "w")
    has = F.col("best_n") >= F.col("n") * ratio
    formed = table_checkpoint(
        words.join(found, words["word"] == found["w"], "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"),
                F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = roots_of(formed.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return (formed.join(roots, formed["word"] == roots["w"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))

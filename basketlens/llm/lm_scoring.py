"""Language-model scores by online logistic context mixing.

Tokens are the lower-cased words of a text and one end token.  A token is coded
bit by bit (see ``mixing``):

* three bits for its word class's group, two for its frequency band.  A word
  seen in training belongs to the group (one of the most frequent values of a
  grouping column, by default ``lang``) that it is most frequent in.  The
  predictors' contexts are the group that leads in the text so far, the three
  classes before, the word before and the two words before;
* six bits for a known word's place in its class, the first bits of its hash.
  The contexts are the class alone, the word before, the two and the three
  words before.  A word then has its share of the words in its place;
* a word not seen in training has an escape class and is spelled in bytes with a
  terminator.  The spelling's predictors' contexts are the last two to five
  bytes of the word.

A mixing weight is chosen by the bit's node and by which of the two longest
contexts have been seen.  Every bit of a word has tables of its own, whose size
follows from the number of training tokens up to ``TABLE_BITS`` (23 MB in all,
which is what a task gets by broadcast).

Training: documents are read once into chunks of coded tokens with a dictionary
per chunk.  The dictionaries' entries meet once by word, where each learns the
word's count and group in the whole corpus, and go back to their chunk, so the
tokens themselves are never shuffled by word.  Predictors, mixing weights and
refinement maps are learned online in every task over all its chunks; bit
counts are summed over the tasks, weights and maps averaged by the bits each
task saw.  Class bits are learned with each word's count taken without the
token itself, so that escapes are learned as unseen words will need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import PIECE_BYTES, quoted, share, slices_by_bytes, text_or_empty
from basketlens.llm.mixing import Mixer, context_keys, counted, node_keys, second_gate, slots

GROUPS = 6                      # groups with a name; group 6 is any other, 7 the escape and the end
BANDS = np.array([4, 64, 2048], dtype=np.int64)  # counts at which the next band begins
ESCAPE, END, NONE = 28, 30, 31  # classes; group 7 has no band
PLACE_BITS = 6                  # bits of a known word's place in its class
CHUNK_BYTES = 16 << 20
BLOCK_TOKENS, BLOCK_LETTERS = 1 << 18, 1 << 18
TASK_WORDS = 1 << 19            # distinct words per task that learns spelling
TABLE_BITS, SPELL_BITS = 17, 19  # largest table of a bit of a word; tables of the spelling
TABLE_TOKENS = 64               # training tokens for an entry of a smaller table
CONTEXTS = 4
WORD_BITS = 5 + PLACE_BITS
SLICE = 1 << 13                 # counts that travel in a row
SLICES = "slice int, body binary"
RATE = 0.2


def class_of(count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of words by their count and group (group 7: the end token)."""
    known = group.astype(np.int64) * 4 + np.searchsorted(BANDS, count, side="right")
    return np.where(group == 7, END, np.where(count > 0, known, ESCAPE)).astype(np.uint8)


# -- chunks -------------------------------------------------------------------

def _chunks(groups: list[str]):
    """Documents to chunks: their tokens as numbers of the chunk's dictionary,
    which tells the same word in texts of different groups apart."""
    number = {g: k for k, g in enumerate(groups)}

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Ids, held-out marks, groups, bytes, numbers of tokens and tokens of some documents."""
        sizes = pc.binary_length(batch.column(3)).to_numpy().astype(np.int64)
        for a, b in slices_by_bytes(sizes.tolist(), PIECE_BYTES):
            part = batch.slice(a, b - a)
            lists = _split(part.column(3))
            group = np.array([number.get(g, GROUPS) for g in part.column(2).to_pylist()], dtype=np.int64)
            yield (part.column(0), part.column(1), group, sizes[a:b], np.diff(lists.offsets.to_numpy()).astype(np.int64),
                   lists.flatten().dictionary_encode())

    def chunk(held: list[tuple], name: int) -> pa.RecordBatch:
        ids, out, groups, sizes, lengths, words = zip(*held)
        words = pa.chunked_array(words).unify_dictionaries().chunks
        known = words[0].dictionary
        # An entry is a word in a group: first all that occur, then their numbers.
        used = np.zeros((GROUPS + 1) * len(known), dtype=bool)

        def entry(g, n, w) -> np.ndarray:
            return np.repeat(g * len(known), n) + w.indices.to_numpy()

        for piece in zip(groups, lengths, words):
            used[entry(*piece)] = True
        entries, place = np.flatnonzero(used), np.cumsum(used, dtype=np.uint32) - np.uint32(1)
        trained, codes = np.zeros(len(entries), dtype=np.int64), []
        for o, *piece in zip(out, groups, lengths, words):
            codes.append(place[entry(*piece)])
            learned = np.repeat(~pc.fill_null(o, False).to_numpy(zero_copy_only=False), piece[1])
            trained += np.bincount(codes[-1][learned], minlength=len(entries))
        row = {"chunk": pa.array([name], pa.int64()),
               "words": _one(known.take(pa.array(entries % len(known))).view(pa.binary())),
               "group": _one((entries // len(known)).astype(np.int32)), "trained": _one(trained),
               "doc_id": _one(pa.concat_arrays(ids)), "held_out": _one(pa.concat_arrays(out)),
               "length": _one(np.concatenate(lengths)), "bytes": _one(np.concatenate(sizes)),
               "codes": pa.array([zstandard.compress(np.concatenate(codes).astype("<u4"), 1)], pa.binary())}
        return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        size = 0
        for batch in batches:
            first = 0
            for k, n in enumerate(pc.binary_length(batch.column(3)).to_pylist()):
                size += n + 8
                if size >= CHUNK_BYTES:
                    held.extend(pieces(batch.slice(first, k + 1 - first)))
                    yield chunk(held, name)
                    held, size, name, first = [], 0, name + 1, k + 1
                    pa.default_memory_pool().release_unused()  # the worker's next stages need it
            held.extend(pieces(batch.slice(first)))
        if held:
            yield chunk(held, name)
        del held
        pa.default_memory_pool().release_unused()

    return run


def _split(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of texts (binary), then the end: no word is empty."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.string())))
    # Arrow splits at the six ASCII white-space bytes and finds an empty word after the last of them.
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), bare, pc.binary_join_element_wise(bare, "", " ")))


def _one(values) -> pa.ListArray:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# -- spelling -----------------------------------------------------------------

def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words with their terminators, flat, and each word's first place."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = _word_ends(words)
    return data, np.concatenate([[0], ends[:-1]])


def _word_ends(words: list[bytes]) -> np.ndarray:
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)


def _words_cut(words: list[bytes], limit: int = BLOCK_LETTERS) -> Iterator[tuple[int, int]]:
    first, ends = 0, _word_ends(words)
    while first < len(words):
        last = np.searchsorted(ends, (ends[first - 1] if first else 0) + limit)
        yield first, (first := min(int(last) + 1, len(words)))


def _spell_walk(data: np.ndarray, first: np.ndarray):
    """Per bit of the bytes: (all symbols,) table places, node, second gate, bit."""
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]])))
    context, keys = np.zeros(len(data), dtype=np.uint64), []
    for k in range(1, CONTEXTS + 2):
        before = np.zeros(len(data), dtype=np.uint64)
        before[k:] = data[:-k]
        before = (before + np.uint64(1)) * (place >= k)
        context = context * np.uint64(257) + before
        if k > 1:
            keys.append(context_keys(context * np.uint64(8) + np.uint64(k)))
    second = second_gate(np.minimum(place, 7))
    for depth in range(8):
        node = (data >> np.uint8(8 - depth) if depth else np.zeros_like(data)).astype(np.intp) | 1 << depth
        nodes = node_keys(node)
        yield None, [slots(k, nodes, SPELL_BITS) for k in keys], node, second, data >> np.uint8(7 - depth) & 1


# -- words --------------------------------------------------------------------

def table_bits(train_tokens: int) -> int:
    """Size of a bit's table for so many training tokens."""
    return min(TABLE_BITS, max(12, (train_tokens // TABLE_TOKENS).bit_length()))


def place_of(hashes: np.ndarray) -> np.ndarray:
    """Places of words in their classes: the first bits of their hashes."""
    return (hashes >> np.uint32(32 - PLACE_BITS)).astype(np.uint8)


def _before(values: np.ndarray, place: np.ndarray, k: int, none: int) -> np.ndarray:
    """The value ``k`` tokens before in the same text."""
    found = np.full(len(values), none, dtype=values.dtype)
    found[k:] = values[:-k]
    found[place < k] = none
    return found


def _leading(group: np.ndarray, first: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The group that leads in the text before each token and how surely."""
    top, lead = np.zeros(len(group), dtype=np.int32), np.zeros(len(group), dtype=np.uint64)
    for g in range(7):
        total = np.concatenate([[0], np.cumsum(group == g, dtype=np.int32)])
        seen = total[:-1] - np.repeat(total[first], lengths)
        more = seen > top
        top[more] = seen[more]
        lead[more] = g
    sure = np.where(top == 0, 0, 1 + (4 * top >= 3 * np.maximum(1, place)) + (top >= 8)).astype(np.uint64)
    return lead * np.uint64(4) + sure


def _word_walk(classes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, bits: int):
    """Per bit of the words' classes and places: symbols (None: all), table
    places, node, second gate, bit.  ``hashes`` are the words' (uint32)."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(classes), dtype=np.int32) - np.repeat(first, lengths).astype(np.int32)
    one, two, three = (_before(classes, place, k, NONE).astype(np.uint64) for k in (1, 2, 3))
    word, other, third = (_before(hashes, place, k, 0).astype(np.uint64) for k in (1, 2, 3))
    pair = (word << np.uint64(32) | other) * np.uint64(0xD6E8FEB86659FD93)
    triple = (pair ^ pair >> np.uint64(32)) + third
    group = classes >> 2

    def keyed(*contexts: np.ndarray) -> list[np.ndarray]:
        return [context_keys(c * np.uint64(8) + np.uint64(k)) for k, c in enumerate(contexts)]

    keys = keyed(_leading(group, first, lengths, place) * np.uint64(8) + (one >> np.uint64(2)),
                 (one * np.uint64(32) + two) * np.uint64(32) + three, word, pair)
    known = np.flatnonzero(classes < ESCAPE)
    cell = classes.astype(np.int64)[known]
    placed = keyed(cell.astype(np.uint64), word[known], pair[known], triple[known])
    code, second = classes, second_gate(one >> np.uint64(2))
    for depth in range(5):
        if depth == 4:  # group 7 has no fifth bit
            code, second, keys = code[known], second[known], [k[known] for k in keys]
        node = (code >> (5 - depth)).astype(np.intp) | 1 << depth
        nodes = node_keys(node)
        yield (known if depth == 4 else None, [slots(k, nodes, bits) + (depth << bits) for k in keys], node, second,
               code >> (4 - depth) & 1)
    code, second = place_of(hashes[known]), second_gate(8 + (cell & 3))
    for depth in range(PLACE_BITS):
        nodes = node_keys(cell << PLACE_BITS | code >> (PLACE_BITS - depth) | 1 << depth)
        yield (known, [slots(k, nodes, bits) + (5 + depth << bits) for k in placed],
               np.full(len(known), 32 + depth), second, code >> (PLACE_BITS - 1 - depth) & 1)


@dataclass
class Model:
    """Stretched predictions of the hashed contexts and the trained mixer."""

    tables: np.ndarray  # (contexts, entries)
    mixer: Mixer


def _gate(inputs: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Gate of a bit: its node, and which of the two longest contexts have been seen."""
    return node * 4 + (inputs[-2] != 0) + 2 * (inputs[-1] != 0)


def log10_bits(model: Model, walk, n: int) -> np.ndarray:
    """Per symbol the log10 probability of all its bits."""
    total = np.ones(n)  # eleven factors of 1e-5 at the least
    for at, places, node, second, bit in walk:
        inputs = [t.take(x) for t, x in zip(model.tables, places)]
        p, _ = model.mixer.predict(inputs, _gate(inputs, node), second)
        part = np.where(bit == 1, p, np.float32(1) - p)
        if at is None:
            total *= part
        else:
            total[at] *= part
    return np.log10(total)


def spell(model: Model, words: list[bytes]) -> np.ndarray:
    found = []
    for a, b in _words_cut(words):
        data, first = _letters(words[a:b])
        found.append(np.add.reduceat(log10_bits(model, _spell_walk(data, first), len(data)), first))
    return np.concatenate(found) if found else np.zeros(0)


# -- training in Spark ----------------------------------------------------------

def _learn(walks, tables_of: tuple[int, int], make):
    """Online training over a task's blocks; ``tables_of``: number of tables of
    a context (a bit has its own or shares the only one) and their size in bits.
    Rows ``(slice, body)``: counts of zeros and ones by slices of the tables, then
    the mixer's values by weight and the weight (slice -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, bits = tables_of
        mixer, seen = make(), 0
        counts = np.zeros((CONTEXTS, many, 2 << bits), dtype=np.int32)
        tables = np.zeros((CONTEXTS, many << bits), dtype=np.float32)
        for walk in walks(batches):
            for _, places, node, second, bit in walk:
                if not len(bit):
                    continue
                inputs = [t.take(x) for t, x in zip(tables, places)]
                gate = _gate(inputs, node)
                _, kept = mixer.predict(inputs, gate, second)
                mixer.learn(inputs, gate, bit == 1, kept, RATE)
                seen += len(bit)
                # A place holds bits of one node, so none is counted before it is predicted.
                region = int(places[0][0]) >> bits
                for k, x in enumerate(places):
                    x = x - (region << bits)
                    own, met = counts[k, region], np.zeros(1 << bits, dtype=bool)
                    np.add.at(own, x * 2 + bit, np.int32(1))
                    met[x] = True
                    changed = np.flatnonzero(met)
                    tables[k, changed + (region << bits)] = counted(own[::2][changed], own[1::2][changed])
        if not seen:
            return

        flat = counts.reshape(-1)
        for k in range(0, len(flat), SLICE):
            if flat[k:k + SLICE].any():
                yield _slice(k // SLICE, flat[k:k + SLICE])
        yield _slice(-1, np.append(mixer.flat().astype(float) * seen, float(seen)))
    return run


def _slice(number: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()),
                                       pa.array([zstandard.compress(values.tobytes(), 1)], pa.binary())],
                                      names=["slice", "body"])


def _values(number: int, body: bytes, counts=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(body), counts if number >= 0 else float)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices of the same number; a slice is held once.  A task's counts
    have 32 bits, their sums 64."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = _values(number, body.as_py(), np.int32)
            if number in sums:
                sums[number] += values
            else:
                sums[number] = values.astype(np.int64 if number >= 0 else float)
    for number, values in sums.items():
        yield _slice(number, values)


def train(rows: DataFrame, walks, tables_of: tuple[int, int], make) -> Model:
    """The model learned from all rows.  Tasks give their counts in slices, which
    are added up by their number; what reaches the driver is bounded by the
    tables' size."""
    found = (rows.mapInArrow(_learn(walks, tables_of, make), SLICES).repartition("slice")
             .mapInArrow(_merge, SLICES).toArrow())
    size, mixer = CONTEXTS * tables_of[0] << tables_of[1], make()
    tables = np.zeros(size, dtype=np.float32)
    for number, body in zip(found.column("slice").to_pylist(), found.column("body")):
        values = _values(number, body.as_py())
        if number < 0:
            mixer.load(values[:-1] / values[-1])
        else:
            first = number * (SLICE // 2)
            tables[first:first + SLICE // 2] = counted(values[::2], values[1::2])
    return Model(tables.reshape(CONTEXTS, -1), mixer)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK_TOKENS tokens."""
    first, size = 0, 0
    for k, n in enumerate(lengths.tolist()):
        size += n
        if size >= BLOCK_TOKENS:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def _word_walks(lengths: np.ndarray, classes: np.ndarray, hashes: np.ndarray, bits: int):
    at = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in _blocks(lengths):
        cut = slice(at[a], at[b])
        yield at[a], at[b], _word_walk(classes[cut], hashes[cut], lengths[a:b], bits)


def _tokens(codes, *values) -> list[np.ndarray]:
    """Values of a chunk's dictionary entries, for every token."""
    codes = np.frombuffer(zstandard.decompress(codes.as_py()), dtype="<u4")
    return [np.frombuffer(v.as_py(), dtype=kind)[codes] for v, kind in values]


def _word_rows(bits: int):
    """Walks over the training documents of coded chunks."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                out, length, codes, moved, hashes = (
                    batch.column(c)[k] for c in ("held_out", "length", "codes", "moved", "hashes"))
                length = length.values.to_numpy(zero_copy_only=False)
                keep = ~out.values.to_numpy(zero_copy_only=False)
                learned, words = (x[np.repeat(keep, length)] for x in _tokens(codes, (moved, np.uint8), (hashes, "<u4")))
                for _, _, walk in _word_walks(length[keep], learned, words, bits):
                    yield walk
    return run


def _spell_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        words = batch.column("word").to_numpy(zero_copy_only=False).tolist()
        for a, b in _words_cut(words):
            yield _spell_walk(*_letters(words[a:b]))


def _word_mixer() -> Mixer:
    return Mixer(CONTEXTS, 4 * (32 + PLACE_BITS), 12)


def _spell_mixer() -> Mixer:
    return Mixer(CONTEXTS, 4 * 256, 8)


# -- the operator ----------------------------------------------------------------

def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 7 == 2, F.lit(False))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 group_col: str | None = "lang", out=None) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, bits_per_byte``.

    ``out`` marks the rows that nothing is learned from (by default those whose
    id's CRC-32 has remainder 2 modulo 7; a null id is learned from).
    ``base_score`` is the add-one unigram score, ``score`` the model's log10
    probability of the text's tokens, ``bits_per_byte`` its cost over the bytes
    of the text (null for an empty text).  The grouping column only shapes word
    classes, from training rows; without it, or where it is null, words are in
    one group.  A null text has the end token alone.  Without training rows
    every word is spelled by untrained predictors.  Repeated rows count as often
    as they occur.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    out = held_out(id_col) if out is None else out
    grouped = group_col is not None and group_col in docs.columns
    rows = docs.select(quoted(id_col).alias("doc_id"), out.alias("held_out"),
                       (quoted(group_col).cast("string") if grouped else F.lit(None).cast("string")).alias("grp"),
                       text_or_empty(text_col).cast("binary").alias("body"))
    # The GROUPS most frequent values.
    groups = [r["grp"] for r in rows.where("not held_out and grp is not null").groupBy("grp")
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp").limit(GROUPS).collect()]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    chunks = table_checkpoint(rows.mapInArrow(
        _chunks(groups), f"chunk long, words array<binary>, group array<int>, trained array<long>, doc_id array<{id_type}>,"
        " held_out array<boolean>, length array<long>, bytes array<long>, codes binary"), "lm-chunks")

    entry = F.posexplode(F.arrays_zip("words", "group", "trained")).alias("idx", "e")
    entries = chunks.select("chunk", entry).select(
        "chunk", "idx", F.col("e.words").alias("word"), F.col("e.group").alias("grp"), F.col("e.trained").alias("n"))
    # Entries of a word: one per chunk and group.  Each learns the word's count
    # in training, the group where it is most frequent (ties: the first) and
    # whether it is the word's first entry.
    word, own = Window.partitionBy("word"), Window.partitionBy("word", "grp")
    key = F.shiftleft("chunk", 24) + F.col("idx")
    met = (entries.repartition("word").withColumn("m", F.sum("n").over(own) * 8 + (7 - F.col("grp")))
           .select("chunk", "idx", "word", F.sum("n").over(word).alias("c"), F.max("m").over(word).alias("m"), F.shiftright(F.xxhash64("word"), 32).cast("int").alias("hash"),
                   (F.min(key).over(word) == key).alias("first")))
    grp = F.when(F.length("word") == 0, 7).otherwise(7 - F.col("m") % 8).cast("int")
    met = table_checkpoint(met.select(
        F.col("chunk").alias("owner"), "idx", "c", grp.alias("grp"), "first", "hash",
        F.when(F.col("first") | (F.col("c") == 0), F.col("word")).alias("word")), "lm-words")

    band = sum((F.col("c") >= b).cast("int") for b in BANDS.tolist())
    cell = F.shiftrightunsigned("hash", 32 - PLACE_BITS)
    mass = {(r["grp"], r["band"], r["cell"]): (r["c"], r["v"]) for r in
            met.where("first and c > 0").groupBy("grp", band.alias("band"), cell.alias("cell"))
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    train_tokens = sum(c for c, _ in mass.values())
    distinct = sum(v for _, v in mass.values())
    total = np.ones((32, 1 << PLACE_BITS))
    for (g, b, x), (c, _) in mass.items():
        if g < 7:
            total[g * 4 + b, x] = c

    learners = 1 + distinct // TASK_WORDS
    spelling = share(
        spark, train(met.where("first and c > 0 and grp < 7").select("word").repartition(learners, "word")
                     .sortWithinPartitions(F.xxhash64("word"), "word"), _spell_rows, (1, SPELL_BITS), _spell_mixer))
    n_all = train_tokens + distinct + 1

    def code(chunk: pa.Table, found: pa.Table) -> pa.Table:
        """A chunk's tokens as classes, and its documents' other sums."""
        found = found.take(pa.array(np.argsort(found.column("idx").to_numpy())))
        c, g = found.column("c").to_numpy(), found.column("grp").to_numpy()
        classes = class_of(c, g)
        hashes = found.column("hash").to_numpy().astype(np.uint32)
        share = np.where(classes == END, 0.0, np.log10(np.maximum(c, 1) / total[classes, place_of(hashes)]))
        new = np.flatnonzero(classes == ESCAPE)
        share[new] = spell(spelling(), found.column("word").take(pa.array(new)).to_numpy().tolist())
        moved = class_of(np.maximum(c - 1, 0), g)
        codes = np.frombuffer(zstandard.decompress(chunk.column("codes")[0].as_py()), dtype="<u4")
        lengths = chunk.column("length")[0].values.to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sums = [np.add.reduceat(x[codes], first) for x in ((c > 0).astype(np.int64), np.log10((c + 1.0) / n_all), share)]
        return pa.table({**{k: chunk.column(k) for k in ("doc_id", "held_out", "length", "bytes", "codes")},
                         "known": pa.array([sums[0]]), "base": pa.array([sums[1]]), "share": pa.array([sums[2]]),
                         **{name: pa.array([x.tobytes()], pa.binary()) for name, x in
                            (("classes", classes), ("moved", moved), ("hashes", hashes.astype("<u4")))}})

    coded = table_checkpoint(
        chunks.select("chunk", "doc_id", "held_out", "length", "bytes", "codes").groupBy("chunk")
        .cogroup(met.select("owner", "idx", "c", "grp", "hash", F.when(F.col("c") == 0, F.col("word")).alias("word"))
                 .groupBy("owner")).applyInArrow(
            code, f"doc_id array<{id_type}>, held_out array<boolean>, length array<long>, bytes array<long>,"
            " codes binary, known array<long>, base array<double>, share array<double>, classes binary, moved binary,"
            " hashes binary"), "lm-coded")

    bits = table_bits(train_tokens)
    model = share(spark, train(coded.select("held_out", "length", "codes", "moved", "hashes"), _word_rows(bits),
                               (WORD_BITS, bits), _word_mixer))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in batches:
            for k in range(batch.num_rows):
                ids, out_, length, size, known, base, share, codes, classes, hashes = (
                    batch.column(j)[k] for j in range(10))
                n = length.values.to_numpy(zero_copy_only=False)
                symbols, words = _tokens(codes, (classes, np.uint8), (hashes, "<u4"))
                coded_bits = np.empty(len(symbols))
                for a, b, walk in _word_walks(n, symbols, words, bits):
                    coded_bits[a:b] = log10_bits(own, walk, b - a)
                score = np.add.reduceat(coded_bits, np.concatenate([[0], np.cumsum(n)[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [ids.values, out_.values, length.values, size.values, known.values, base.values,
                     pa.array(score + share.values.to_numpy(zero_copy_only=False))],
                    names=["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score"])

    scored = coded.select("doc_id", "held_out", "length", "bytes", "known", "base", "share", "codes", "classes", "hashes").mapInArrow(
        finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double,"
        " score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", F.when(F.col("n_bytes") > 0, F.col("score") * -np.log2(10).item()
                                                       / F.col("n_bytes")).alias("bits_per_byte"))

"""Token ids in ORC files.

Documents are put in ascending id order by a range partitioning, encoded by
the tasks that write them, and written with Spark's ORC writer: one row per
document, its ids as a list of integers.  ORC encodes integers in runs, keeps
minima and maxima of the document ids per file, stripe and row group of
``ROW_GROUP`` documents, and a Bloom filter on them per row group.  So

* a whole read takes the stripes of a file in as many tasks as there are
  (Spark cuts ORC files at stripes);
* :func:`find` reads only the row groups that may hold the wanted ids.

Every row also carries its file's number in id order (``part``) and the ids
before it in that file (``at``).  The documents' global starts then need one
row per file only.

The tokenizer drops white space, and nothing it does (composition, lower case,
its pattern, special names) reaches across ASCII white space.  So a document's
ids are those of its words one after another, and a worker process encodes
each distinct word once (tested against whole texts).  Texts go in batches of
``BATCH_BYTES``: Arrow splits them and numbers their distinct words, only
these are looked up, and the ids of all words are gathered at once.  A worker
holds at most ``MEMO`` words, or those of one batch if they are more; then it
starts anew.
"""

from __future__ import annotations

import itertools
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm.common import quoted, share, slices_by_bytes, text_or_empty

END = 1
STRIPE_BYTES = 16 << 20
ROW_GROUP = 1000
BLOOM_FPP = 0.01
MEMO = 500_000
BATCH_BYTES = 4 << 20


class WordEncoder:
    """Ids of words, each distinct word encoded once.

    Words of printable ASCII and Latin-1 letters need no composition; they are
    put in lower case, cut by the tokenizer's pattern, and every distinct piece
    goes through the tokenizer's model.  All other words, and those that may
    hold a special name, go through the whole tokenizer.
    """

    EASY = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
    # Fixed value: the tokenizer file's pattern, for the characters above in lower case and spaces between words.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]| |"
                        "[^ a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
    GAP = np.uint32(0xFFFFFFFF)  # stands for the space between two words; no id is as large

    def __init__(self, tokenizer_json: bytes, memo: int = MEMO) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.model, self.memo = self.tokenizer.model, memo
        # Byte-level text: printable bytes stand for themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (b for b in range(256) if b not in shown)
        self.byte_text = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[str, int] = {"": 0}  # a word's number; Arrow's split gives empty words at a text's ends
        self.ids, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)  # the words' ids in a row
        self.again = np.ones(1, dtype=bool)  # whether a word was met after the batch it was learned in
        self.pieces: dict[str, bytes] = {" ": self.GAP.tobytes()}

    def forget(self, limit: int) -> None:
        """Keep the words met again, if they are at most ``limit``, or none."""
        keep = self.again if self.again.sum() <= limit else np.arange(len(self.again)) == 0
        sizes = np.diff(self.ends, prepend=0)
        self.words = {w: k for k, w in enumerate(itertools.compress(self.words, keep.tolist()))}
        self.ids, self.ends = self.ids[np.repeat(keep, sizes)], np.cumsum(sizes[keep])
        self.again = np.arange(len(self.words)) == 0

    def piece(self, text: str) -> bytes:
        level = text if text.isascii() else "".join(map(self.byte_text.__getitem__, text.encode()))
        return array("I", [t.id for t in self.model.tokenize(level)]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words that have no number yet."""
        easy, hard = words, []
        if not all(map(self.EASY.fullmatch, words)) or "<|" in " ".join(words):
            easy, hard = [], []
            for word in words:
                (easy if "<|" not in word and self.EASY.fullmatch(word) else hard).append(word)
        if len(self.pieces) > self.memo // 2:
            self.pieces = {" ": self.GAP.tobytes()}
        cut = self.PIECES.findall("".join([w + " " for w in easy]).lower())
        for text in set(cut).difference(self.pieces):
            self.pieces[text] = self.piece(text)
        found = np.frombuffer(b"".join(map(self.pieces.__getitem__, cut)), dtype=np.uint32)
        gaps = np.flatnonzero(found == self.GAP)
        slow = [e.ids for e in self.tokenizer.encode_batch(hard, add_special_tokens=False)]
        ends = np.concatenate([gaps - np.arange(len(gaps)),
                               len(found) - len(gaps) + np.cumsum([len(x) for x in slow], dtype=np.int64)])
        self.words.update(zip(easy + hard, range(len(self.ends), len(self.ends) + len(ends))))
        self.ends = np.concatenate([self.ends, len(self.ids) + ends])
        self.again = np.concatenate([self.again, np.zeros(len(ends), dtype=bool)])
        self.ids = np.concatenate([self.ids, np.delete(found, gaps), *(np.array(x, dtype=np.uint32) for x in slow)])

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words."""
        found = list(map(self.words.get, words))
        self.again[[k for k in found if k is not None]] = True
        new = [w for w, k in zip(words, found) if k is None]
        if new:
            if len(self.words) + len(new) > self.memo:
                self.forget(min(self.memo // 2, self.memo - len(words)))
                new = [w for w in words if w not in self.words]
            self.learn(new)
            found = map(self.words.__getitem__, words)
        return np.fromiter(found, np.int64, len(words))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text after the other, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)  # splits at the six ASCII white-space bytes
        words = lists.flatten().dictionary_encode()
        number = self.numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        firsts = np.concatenate([[0], self.ends[:-1]])[number]
        at = words.indices.to_numpy()
        sizes = (self.ends[number] - firsts)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(firsts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def worker_encoder(tokenizer_json: bytes, memo: int = MEMO) -> WordEncoder:
    """This worker process's encoder: Spark gives a worker many tasks, so the
    words known from one serve the next."""
    name = f"basketlens_words_{zlib.crc32(tokenizer_json)}_{memo}"
    holder = sys.modules.setdefault(name, types.ModuleType(name))
    if not hasattr(holder, "encoder"):
        holder.encoder = WordEncoder(tokenizer_json, memo)
    return holder.encoder


def _encode_rows(tokenizer_json: Callable[[], bytes], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_json())
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices_by_bytes(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                ids, sizes = encoder.encode_all(texts[a:b])
                values = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).view(np.int32)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([part] * (b - a), pa.int32()),
                     pa.array(at + ends - sizes), pa.array(sizes), lists],
                    names=["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END, partitions: int | None = None,
                 stripe_bytes: int = STRIPE_BYTES, row_group: int = ROW_GROUP, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the ids of every document, then ``end_id``, as ORC files under
    ``path``, in ascending order of ids (null ids first; rows with equal ids
    by a hash of their text).

    A null or empty text gives the end id alone.  Every input row is a document
    of its own, repeated rows too.  An empty table gives files without rows.
    Other columns are ignored.  ``partitions``: files to write; by default as
    many as the session's shuffles have.  Many rows under one id, or without
    one, are dealt over several files by the hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with open(tokenizer, "rb") as f:
        known = share(spark, f.read())
    order = [F.col("doc_id"), F.xxhash64("body")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = ranged.mapInArrow(_encode_rows(known, end_id),
                             f"doc_id {id_type}, part int, at long, n_tokens long, ids array<int>")
    (made.write.mode("overwrite").option("compression", "zstd")
     .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(row_group))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP)).orc(path))


def _files(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return (spark.read.schema(f"doc_id {id_type}, part int, at long, n_tokens long, ids array<int>")
            .orc(path))


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files;
    ``start`` counts the ids of all documents before it."""
    files = _files(spark, path, id_type)
    totals = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    # One row per written file: bounded by the writer's partitions.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return (files.join(F.broadcast(before), "part")
            .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids"))


def find(spark: SparkSession, path: str, wanted: list, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of the documents with the given ids, by the
    files' minima, maxima and Bloom filters (no whole scan)."""
    return _files(spark, path, id_type).where(F.col("doc_id").isin(list(wanted))).select("doc_id", "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``: the CRC-32 of each document's
    ids as little-endian unsigned 32-bit numbers."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")

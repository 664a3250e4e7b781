"""Packing token sequences: bounded-space online best fit.

Every partition reads its documents once and keeps at most ``OPEN`` windows
open.  A document's ids (with the separator) are cut into whole windows, which
go out at once, and a rest.  The rest goes into the open window with the least
room that still takes it.  When none fits and no more windows may be opened,
the fullest one is emitted.  At the end the windows still open are merged:
partitions are joined ``FAN_IN`` at a time, their open windows packed into each
other by the same rule, until one group is left.  A merge handles window sizes
only, at most ``FAN_IN x OPEN`` of them, never ids.

When the fullest window is to be emitted with a room of ``CUT`` tokens or more,
the rest is cut to fill it, so an emitted window has fewer than ``CUT`` tokens
of padding.
"""

from __future__ import annotations

import base64
import importlib.util
import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import quoted, share, slices_by_bytes, text_or_empty

LENGTH = 1024
OPEN = 64
CUT = 16
FAN_IN = 32
SEPARATOR = 0
BATCH_BYTES = 1 << 20
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """The open windows of one partition, by room."""

    def __init__(self, capacity: int, limit: int, cut: int | None) -> None:
        self.capacity, self.limit, self.cut = capacity, limit, cut
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending

    def place(self, size: int) -> Iterator[tuple[int | None, int, bool]]:
        """Parts of an item in order: ``(window or None for a new one, tokens,
        whether this fills or closes the window)``."""
        while size:
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
                if room > size:
                    insort(self.rooms, (room - size, window))
                yield window, size, room == size
                return
            if len(self.rooms) < self.limit:
                yield None, size, size == self.capacity
                return
            room, window = self.rooms.pop(0)  # the fullest
            if self.cut is not None and room >= self.cut:
                yield window, room, True
                size -= room
            else:
                yield window, 0, True


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file as read on the driver (about 1 MB), for the tasks."""

    data: bytes
    pattern: str | None  # given: ``data`` holds ranks; else it is in the ``tokenizers`` format
    special: tuple[tuple[str, int], ...] = ()  # names that are one id wherever they stand in a text


def vocabulary(path: str) -> Vocabulary:
    """``path`` names a byte-level BPE in the ``tokenizers`` format.  Where the
    same vocabulary lies next to it as ranks (ending ``.tiktoken``), with its
    pattern in the module that the folder belongs to, the ranks are taken: the
    ids are the same (tested) and come several times faster."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    pattern = None
    if os.path.exists(ranks) and importlib.util.find_spec("public_tokenizers"):
        pattern = importlib.import_module("public_tokenizers").PATTERN
    special = ()
    if pattern:
        with open(path, "rb") as f:
            added = json.load(f).get("added_tokens") or []
        if all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added):
            special = tuple((t["content"], t["id"]) for t in added)
        else:
            pattern = None
    with open(ranks if pattern else path, "rb") as f:
        return Vocabulary(f.read(), pattern, special)


def encoder(known: Vocabulary):
    """A function from texts to lists of id arrays.  The name of a special
    token in a text is that token's id, as the tokenizer has it by default."""
    if known.pattern is None:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_buffer(known.data)
        return lambda texts: [np.array(e.ids, dtype="<u4")
                              for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, known.data.splitlines())}
    coder = tiktoken.Encoding("ranks", pat_str=known.pattern, mergeable_ranks=table, special_tokens={})
    ids_of = dict(known.special)
    names = re.compile("(" + "|".join(map(re.escape, sorted(ids_of, key=len, reverse=True))) + ")") if ids_of else None

    def encode(text: str) -> list[int]:
        if names is None or not any(name in text for name in ids_of):
            return coder.encode_ordinary(text)
        found: list[int] = []
        for k, piece in enumerate(names.split(text)):  # every other piece is a name
            found += [ids_of[piece]] if k % 2 else coder.encode_ordinary(piece)
        return found

    return lambda texts: [np.array(encode(t), dtype="<u4") for t in texts]


def _pack(known: Callable[[], Vocabulary], capacity: int, limit: int, cut: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(known())
        part = TaskContext.get().partitionId()
        state = OpenWindows(capacity, limit, cut)
        opened, used = part << 40, {}
        held: dict[int, list[tuple]] = {}  # pieces of the open windows

        def emit(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=id_type), *(pa.array(c, pa.int64()) for c in cols[1:3]),
                 pa.array(cols[3], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[4:7]),
                 pa.array([is_open] * len(rows))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"])

        for batch in batches:
            id_type = batch.column(0).type
            texts = batch.column(1).to_pylist()
            for a, b in slices_by_bytes(map(len, texts), BATCH_BYTES):
                done: list[tuple] = []
                for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), encode(texts[a:b])):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    n, at = len(ids), 0
                    while n - at >= capacity:
                        done.append((doc_id, at, capacity, ids[at:at + capacity].tobytes(), n, opened, 0))
                        opened, at = opened + 1, at + capacity
                    for window, size, closes in state.place(n - at):
                        if window is None:
                            window, opened = opened, opened + 1
                            used[window], held[window] = 0, []
                            insort(state.rooms, (capacity - size, window))
                        if size:
                            held[window].append((doc_id, at, size, ids[at:at + size].tobytes(), n,
                                                 window, used[window]))
                        used[window] += size
                        at += size
                        if closes:
                            done += held.pop(window)
                            del used[window]
                if done:
                    yield emit(done, False)
        left = [row for rows in held.values() for row in rows]
        if left:
            yield emit(left, True)

    return run


def _merge(capacity: int, limit: int, last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Packs hosts (windows already merged into one) into each other."""
        hosts = frame.groupby("host")["used"].first().sort_index()
        state = OpenWindows(capacity, limit, None)
        into, base, used, closed = {}, {}, {}, set()
        for host, size in sorted(hosts.items(), key=lambda x: (-x[1], x[0])):
            for window, tokens, closes in state.place(int(size)):
                if window is None:
                    window, used[host] = host, 0
                    insort(state.rooms, (capacity - tokens, host))
                if closes:
                    closed.add(window)
                if tokens:
                    into[host], base[host] = window, used[window]
                    used[window] += tokens
        out = frame.copy()
        out["base"] = frame["base"] + frame["host"].map(base)
        out["host"] = frame["host"].map(into)
        out["used"] = out["host"].map(used)
        out["open"] = [not last and h not in closed for h in out["host"]]
        return out

    return run


def merge_open(windows: DataFrame, capacity: int, limit: int, parts: int) -> DataFrame:
    """``(window, host, base)``: the window that each open window ends up in,
    and where.  ``windows`` has ``window`` (partition in the bits from 40 up)
    and ``used``; ``parts`` bounds the partition numbers."""
    state = windows.select("window", F.col("window").alias("host"), F.lit(0).cast("long").alias("base"),
                           F.col("used").cast("long"), F.lit(True).alias("open"))
    settled, span = None, 1
    while True:
        span *= FAN_IN
        grouped = state.withColumn("grp", F.floor(F.shiftright("window", 40) / F.lit(span)).cast("long"))
        merged = grouped.groupBy("grp").applyInPandas(
            _merge(capacity, limit, parts <= span),
            "window long, host long, base long, used long, open boolean, grp long")
        state = table_checkpoint(merged.drop("grp"), "pack-merge")
        done = state.where(~F.col("open")).select("window", "host", "base")
        settled = done if settled is None else settled.unionByName(done)
        if parts <= span:
            return settled
        state = state.where("open")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN,
         cut: int | None = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column as ``doc_id``, then ``start, length,
    ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    The pieces of a document cover its ids, then one separator (id 0), without
    gap or overlap; those of a sequence cover its first tokens without gap, at
    most ``length`` of them.  ``cut``: the least room that a rest is cut to
    fill when no window takes it whole; None never cuts a rest.

    Documents are taken in the order they come in; of open windows with equal
    room the older one is filled.  A null or empty text gives one piece, the
    separator.  Every input row is a
    document of its own, repeated rows and rows with a null id too.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    known = share(spark, vocabulary(tokenizer))
    placed = table_checkpoint(
        rows.mapInArrow(_pack(known, length, open_windows, cut), f"doc_id {id_type}, {PIECES}, open boolean"),
        "pack-pieces")
    whole, rest = placed.where(~F.col("open")).drop("open"), placed.where("open").drop("open")
    windows = rest.groupBy(F.col("sequence_id").alias("window")).agg(F.sum("length").alias("used"))
    top = windows.agg(F.max("window").alias("w")).first()["w"]
    if top is None:
        return whole
    merged = merge_open(windows, length, open_windows, (top >> 40) + 1)
    moved = (rest.join(merged, rest["sequence_id"] == merged["window"])
             .withColumn("sequence_id", F.col("host"))
             .withColumn("offset", F.col("offset") + F.col("base")))
    return whole.unionByName(moved.select(*whole.columns))

"""Repair of conversation structure by a checkpointed dynamic program.

A conversation's rows, in turn order, are edited at least cost so that the
initials of their roles read ``(s?(ua)+)?``.  Per row: Keep (0), Rerole to user
or assistant (2), Delete (3); anywhere: Insert a user or assistant row with an
empty text (2).  Blank and duplicate rows have to be deleted; a truncated row
that is not deleted costs 1 more.  What an Insert or Rerole gives follows from
the state (nothing yet, after s, u or a), so a script is determined by its
initials; of the cheapest scripts the ASCII-least is taken (D < I < K < R).

The cost to finish from each of the four states is a vector per position,
computed backwards.  A conversation of n rows is cut into blocks of about the
square root of n:

1. Blocks are cut along a range partitioning by conversation and turn, so a
   long conversation is spread over many tasks.  A block gives one byte per
   row and the 4 x 4 matrix of costs from its entry to its exit.
2. From the last block backwards the matrices give the vectors at block ends:
   the checkpoints, the only vectors that are stored.
3. Rows and checkpoints meet in turn order.  At each block the vectors inside
   it are computed again from its checkpoint, and the walk forward takes at
   every row the ASCII-least tight edit.

Step 3 reads a conversation as a stream: rows are handed on one by one and
nothing but one block's vectors is held.  The digest of a conversation
(:func:`digests`) is one SHA-256 and so sequential by definition; it runs on
the same stream.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import quoted

WHITE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)     # the state after an Insert or a Rerole
MADE = ("user", "user", "assistant", "user")    # and the role it gives
KEEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
DELETE_COST, OTHER_COST, TRUNCATED_COST = 3, 2, 1
END = (0, 4, 2, 0)                              # costs to finish after the last row
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = (None, "blank", "duplicate", "truncated")
LEAST_BLOCK = 64
INFINITE = 1 << 60
ROWS_OUT = 4096
EDITS = ("pos long, edit string, role string, text string, fault string, gaps long, blank long, duplicate long, "
         "truncated long, illegal long, cost long")


def code_of(initial: str, fault: int) -> int:
    """A row as one byte: which initial, which fault."""
    return ("sua".find(initial) + 1 if initial else 0) * 4 + fault


def before_row(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to finish from each state before a row, from those after it."""
    initial, fault = " sua"[code >> 2], code & 3
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    direct = []
    for state in range(4):
        best = DELETE_COST + after[state]
        if fault not in (BLANK, DUPLICATE):
            kept = KEEP.get((state, initial))
            if kept is not None:
                best = min(best, extra + after[kept])
            best = min(best, extra + OTHER_COST + after[NEXT[state]])
        direct.append(best)
    # Inserts before the row: from u and a to each other, from the others to u.
    u = min(direct[AFTER_U], OTHER_COST + direct[AFTER_A])
    a = min(direct[AFTER_A], OTHER_COST + direct[AFTER_U])
    return min(direct[START], OTHER_COST + u), min(direct[AFTER_S], OTHER_COST + u), u, a


class Backward:
    """``before_row`` on vectors less their minimum, of which there are few:
    each pair of such a vector and a row is computed once."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[tuple[int, ...], int]] = {}

    def step(self, code: int, vector: tuple[int, ...], base: int) -> tuple[tuple[int, ...], int]:
        found = self.known.get((code, vector))
        if found is None:
            full = before_row(code, vector)
            low = min(full)
            found = self.known[code, vector] = (tuple(min(x, INFINITE) - low for x in full), low)
        return found[0], base + found[1]

    def vectors(self, codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The vectors before each row and after the last one."""
        out, vector, base = [end], end, 0
        for code in reversed(codes):
            vector, base = self.step(code, vector, base)
            out.append(tuple(x + base for x in vector))
        return out[::-1]

    def matrix(self, codes: bytes) -> list[int]:
        """Costs from each entry state to each exit state, row by row."""
        columns = []
        for exit_state in range(4):
            vector, base = tuple(0 if s == exit_state else INFINITE for s in range(4)), 0
            for code in reversed(codes):
                vector, base = self.step(code, vector, base)
            columns.append([min(x + base, INFINITE) for x in vector])
        return [columns[b][a] for a in range(4) for b in range(4)]


def _cut_blocks(block: int):
    """Sorted rows ``(conv, turn, k, initial, fault, n, again)`` to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, now = TaskContext.get().partitionId() << 40, Backward()
        open_, codes = None, bytearray()  # (conv, turn, k) of the open block's first row
        done: list[tuple] = []
        types = None

        def close() -> None:
            nonlocal seq, codes
            done.append((*open_, seq, bytes(codes), now.matrix(codes)))
            seq, codes = seq + 1, bytearray()

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=["conv", "turn", "k", "seq", "codes", "matrix"])

        for batch in batches:
            types = [batch.column(0).type, batch.column(1).type, pa.string(), pa.int64(), pa.binary(),
                     pa.list_(pa.int64())]
            for conv, turn, k, initial, fault, n, again in zip(*(c.to_pylist() for c in batch.columns)):
                if codes and conv != open_[0]:
                    close()
                repeat = code_of(initial, fault if fault == BLANK else DUPLICATE)
                code = repeat if again else code_of(initial, fault)
                for _ in range(n):
                    if not codes:
                        open_ = conv, turn, k
                    codes.append(code)
                    code = repeat
                    if len(codes) == block:
                        close()
            if len(done) >= ROWS_OUT:
                yield batch_of()
        if codes:
            close()
        if done:
            yield batch_of()

    return run


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: each gets the
    vector at its end in place of its matrix."""
    at, vector = object(), END
    for batch in batches:
        ends = []
        for conv, m in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
            if conv != at:
                at, vector = conv, END
            ends.append(list(vector))
            vector = tuple(min(m[4 * a + b] + vector[b] for b in range(4)) for a in range(4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(ends, pa.list_(pa.int64()))],
                                         names=["conv", "turn", "k", "seq", "codes", "ends"])


class Walk:
    """One conversation, from its first row to its last."""

    def __init__(self, conv: object, now: Backward) -> None:
        self.conv, self.now = conv, now
        self.blocks: deque[tuple[bytes, tuple[int, ...]]] = deque()
        self.codes, self.vectors, self.i = b"", [END], 0
        self.state, self.pos, self.cost = START, 0, None
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.turns, self.first, self.last = 0, None, None

    def edit(self, edit: str, role: str | None, text: str | None, fault: str | None) -> tuple:
        self.pos += 1
        return self.conv, self.pos, edit, role, text, fault, None, None, None, None, None, None

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if self.i == len(self.codes):
            self.codes, end = self.blocks.popleft()
            self.vectors, self.i = self.now.vectors(self.codes, end), 0
        if self.cost is None:
            self.cost = self.vectors[0][START]
        code, here, after = self.codes[self.i], self.vectors[self.i], self.vectors[self.i + 1]
        self.i += 1
        fault, initial = code & 3, role[:1]
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and (self.turns == 0 or turn != self.last):
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        while True:
            state, left = self.state, here[self.state]
            kept = KEEP.get((state, initial)) if fault not in (BLANK, DUPLICATE) else None
            if left == DELETE_COST + after[state]:
                yield self.edit("D", role, text, FAULTS[fault])
                return
            if left == OTHER_COST + here[NEXT[state]]:
                self.state = NEXT[state]
                yield self.edit("I", MADE[state], "", None)
                continue
            if kept is not None and left == extra + after[kept]:
                self.state = kept
                yield self.edit("K", role, text, FAULTS[fault])
                return
            self.state = NEXT[state]
            yield self.edit("R", MADE[state], text, FAULTS[fault])
            return

    def end(self) -> Iterator[tuple]:
        while self.state not in (START, AFTER_A):
            made, self.state = MADE[self.state], NEXT[self.state]
            yield self.edit("I", made, "", None)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        yield (self.conv, self.pos + 1, None, None, None, None, gaps, *self.faults[1:], self.illegal, self.cost or 0)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids (kind 0), checkpoints (1) and rows (2) in turn order to edits."""
    now, walk, done, types, held = Backward(), None, [], None, 0

    def batch_of() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *(x.split()[0] for x in EDITS.split(", "))])

    for batch in batches:
        types = [batch.column(0).type, pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 6]
        for conv, turn, kind, codes, ends, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if walk is None or conv != walk.conv:
                if walk is not None:
                    done.extend(walk.end())
                walk = Walk(conv, now)
            if kind == 1:
                walk.blocks.append((codes, tuple(ends)))
            elif kind == 2:
                done.extend(walk.row(turn, role, text))
                held += len(text)
            if len(done) >= ROWS_OUT or held > 1 << 22:
                held = 0
                yield batch_of()
    if walk is not None:
        done.extend(walk.end())
        yield batch_of()


def _faults(rows: DataFrame) -> DataFrame:
    trimmed = F.rtrim("text", F.lit(WHITE))
    fault = (F.when(trimmed == "", BLANK)
             .when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED))
    return rows.select("conv", "turn", "k", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of every conversation, and a last row with its figures.

    Columns: the id column as ``conv_id``, ``pos`` (from 1), ``edit`` (D, I, K
    or R), ``role`` and ``text`` after the edit (of a deleted row: as they
    were), ``fault`` (blank, duplicate, truncated or null).  The last row of a
    conversation has a null edit and ``gaps, blank, duplicate, truncated,
    illegal, cost``.  A conversation is whole and in order in one partition, so
    :func:`digests` needs no further shuffle.

    Rows come by turn, null turns first; rows of one turn by a hash of role and
    text.  Null roles and texts count as one space.  Rows with a null id are
    one conversation.  Repeated rows are rows of their own (duplicates).
    ``conversations``: ids to report though they have no rows (a cost of 0).
    Empty tables give an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    known = rows.select(quoted(conv_col).alias("conv"), quoted(turn_col).cast("long").alias("turn"),
                        F.coalesce(quoted(role_col), F.lit(" ")).alias("role"),
                        F.coalesce(quoted(text_col), F.lit(" ")).alias("text"))
    known = known.withColumn("k", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    conv_type = known.schema["conv"].dataType.simpleString()

    # One narrow row per conversation, turn, role and text, with its number.
    same = _faults(known).groupBy("conv", "turn", "k", "initial", "fault").agg(F.count(F.lit(1)).alias("n"))
    same = table_checkpoint(same, "repair-rows")
    longest = (same.groupBy("conv").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first()["n"]) or 0
    block = max(LEAST_BLOCK, math.isqrt(longest) + 1)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (same.groupBy("conv", "k").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places"))
              .where("places > 1").select(F.col("conv").alias("c"), F.col("k").alias("key"), "first"))
    marked = (same.join(firsts, same["conv"].eqNullSafe(firsts["c"]) & (same["k"] == firsts["key"]), "left")
              .select("conv", "turn", "k", "initial", "fault", "n",
                      F.coalesce(place > F.col("first"), F.lit(False)).alias("again")))
    marked = table_checkpoint(marked, "repair-marked")

    order = ["conv", "turn", "k"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .mapInArrow(_cut_blocks(block), f"conv {conv_type}, turn long, k string, seq long, codes binary, "
                                              "matrix array<long>"))
    ends = (blocks.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("seq").desc())
            .mapInArrow(_checkpoints, f"conv {conv_type}, turn long, k string, seq long, codes binary, "
                                      "ends array<long>"))
    stops = ends.select("conv", "turn", "k", F.lit(1).alias("kind"), "seq", "codes", "ends",
                        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    spoken = known.select("conv", "turn", "k", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("seq"),
                          F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<long>").alias("ends"),
                          "role", "text")
    everything = stops.unionByName(spoken)
    if conversations is not None:
        ids = conversations.select(quoted(conv_col).alias("conv")).distinct()
        everything = everything.unionByName(ids.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return (everything.repartition("conv").sortWithinPartitions("conv", "turn", "k", "kind", "seq")
            .select("conv", "turn", "kind", "codes", "ends", "role", "text")
            .mapInArrow(_walk, f"conv_id {conv_type}, {EDITS}"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, said, first = [], hashlib.sha256(), True
    for batch in batches:
        found: list[tuple] = []
        columns = [c.to_pylist() for c in batch.columns]
        for conv, edit, role, text, *figures in zip(*columns):
            if edit is None:
                found.append((conv, *figures, "".join(audit), said.hexdigest()))
                audit, said, first = [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                said.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if found:
            types = [batch.column(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), types)],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       "repaired_sha256"])


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation, from the edits as :func:`repair_conversations`
    gives them: its figures, the edits' initials, and the SHA-256 of the
    repaired ``role:text`` rows joined by line feeds."""
    conv_type = edits.schema["conv_id"].dataType.simpleString()
    return edits.select("conv_id", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal",
                        "cost").mapInArrow(
        _digest, f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                 "cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv:turn`` modulo
    20: 0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``,
    3 repeats it, 4 makes its role user.  Nulls count as one space."""
    def known(name: str) -> Column:
        return F.coalesce(quoted(name).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    text, role = known(text_col), known(role_col)
    made = rows.select(
        quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"),
        F.when(what == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(what == 1, F.lit("")).when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))
    return (made.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
            .select("conv_id", "turn", "role", "text"))

"""Helpers shared by the text operators: reading tables, row keys, word
splitting and vectorised hashing.

Words are runs of bytes outside space and ``\\x09``-``\\x0D``
(``[^\\x20\\x09-\\x0D]+``).  ``bytes.split()`` splits on exactly those six
bytes, so it is used wherever the words themselves are needed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so invertible mod 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` whose name is none of ``names`` (an operator's own
    output columns replace input columns of the same name)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of an object with its class, for workers that have no copy
    of this package: a function that gives the object, to be called once per
    task."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


@contextmanager
def sharing(spark: SparkSession, value: object) -> Iterator[Callable[[], object]]:
    """As ``share``, for results that are written inside the ``with`` block:
    the broadcast is destroyed when it ends."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    try:
        yield lambda: pickle.loads(data.value)
    finally:
        data.destroy()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(quoted(c) if isinstance(c, str) else c, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it
    (also inside lambdas, where Spark shares no common expressions)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def schema_plus(df: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """Schema of the kept columns followed by the columns in ``ddl``."""
    fields = [df.schema[c] for c in keep]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]
                        + list(T.StructType.fromDDL(ddl).fields))


def arrow_rows(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()],
                                      names=list(types))


def slices_by_bytes(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``limit`` at most; a
    larger item has a range of its own."""
    first, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if i >= first:
        yield first, i + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (in place on a copy)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * (self.up[-1:] * _BASE)])
            self.down = np.concatenate([self.down, self.down * (self.down[-1:] * _INVERSE)])
            assert len(self.up) == 2 * k


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) offsets of the words in a byte array."""
    edge = np.empty(len(data) + 2, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = SPACES[data]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[0::2], turns[1::2]


def pieces_at_spaces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that end between words."""
    at = 0
    while len(text) - at > limit:
        cut = at + limit
        while cut < len(text) and not SPACES[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def hash_words(text: bytes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order: a polynomial over
    random byte codes, taken from prefix sums, then mixed."""
    found = []
    for piece in pieces_at_spaces(text):
        data = np.frombuffer(piece, dtype=np.uint8)
        starts, ends = word_bounds(data)
        if not len(starts):
            continue
        powers.need(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * powers.up[:len(data)], out=sums[1:])
        found.append(mix64((sums[ends] - sums[starts]) * powers.down[starts]
                           + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 powers: Powers) -> np.ndarray:
    """A 64-bit hash of each range ``codes[start:end]``."""
    powers.need(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers.up[:len(codes)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers.down[starts]
                 + (ends - starts).astype(np.uint64) * _INVERSE)

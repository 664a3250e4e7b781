"""Line dedup by content-defined chunks, in DataFrame operations only.

A text is split into lines.  A rolling hash over the hashes of the last
``ROLL`` lines marks a line wherever it is divisible by ``SPREAD``; a chunk
ends at a marked line that does not follow a marked one.  So the boundaries
depend on the lines just before them alone, return to the same lines after an
insertion or deletion, and no chunk inside a text has one line.  The first and
the last line of a text also bound a chunk, and a head or tail of one line
belongs to its neighbour: only a text of one line is a chunk of one line.

A chunk of at least ``MIN_LINES`` lines with text that occurs more than once
in the table keeps its first occurrence (smallest id, then earliest in the
text); the others are removed.  Chunks meet by hash, and their bytes are
compared before anything is removed: a chunk goes only if it equals the first
occurrence of its hash.  (Of different texts under one 64-bit hash, those that
equal the first one go and the others stay.)

A verified chunk grows by the lines around it: into the ``AROUND`` chunks
before it as far as they end like those before the first occurrence, and into
the ``AROUND`` chunks after it as far as they begin like those after the first
occurrence.  What stands before a passage can move one boundary in its first
``ROLL`` lines, and the end of a text one in its last two, so two chunks reach
its first and its last line: a passage that holds a repeated chunk goes whole.
Every removed line has an equal line at an earlier place, so one occurrence of
each stays.

Nothing but ids, positions and hashes is shuffled to find candidates; the
candidates are regrouped by document, and only their chunks' texts, with their
neighbours', meet again to be compared.  Copies of a hot chunk spread over a
skew join.

Texts are shuffled only where one may have to be cut: a bitmap of the hashes of
the texts in question, of ``SLOTS`` bits at any size, is broadcast, and a row
whose bit is not set stays in its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint
from basketlens.llm.common import bound, quoted, text_or_empty

ROLL = 2
SPREAD = 2
MIN_LINES = 2
AROUND = 2
SLOTS = 1 << 26
_FACTOR, _MODULUS = 31, 1_000_003


def line_hash(line: Column) -> Column:
    """A 24-bit line hash that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(line), 1, 6), 16, 10).cast("long")


def chunks_of(text: Column, roll: int = ROLL, spread: int = SPREAD) -> Column:
    """Array of structs ``first`` (line number from 1), ``lines``, ``body``."""
    lines = F.split(text, "\n", -1)

    def marked(hashes: Column, at: Column) -> Column:
        total = F.element_at(hashes, at)
        for back in range(1, roll):
            before = F.when(at > back, F.element_at(hashes, F.greatest(at - back, F.lit(1)))).otherwise(F.lit(0))
            total = total + before * F.lit(pow(_FACTOR, back, _MODULUS))
        return total % F.lit(_MODULUS) % F.lit(spread) == 0

    def ends(marks: Column) -> Column:
        n = F.size(marks)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (
            (i > 1) & (i < n - 1) & F.element_at(marks, i) & ~F.element_at(marks, F.greatest(i - 1, F.lit(1)))))

    def cut(ls: Column) -> Column:
        return bound(F.transform(ls, line_hash), lambda hs: bound(
            F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: marked(hs, i)), lambda marks: bound(
                ends(marks), lambda at: F.transform(at, lambda end, k: _chunk(ls, F.when(
                    k > 0, F.element_at(at, F.greatest(k, F.lit(1))) + 1).otherwise(F.lit(1)), end)))))

    return bound(lines, cut)


def _chunk(lines: Column, first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), (last - first + 1).alias("lines"),
                    F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("body"))


def _worth(chunk: Column, min_lines: int) -> Column:
    return (chunk["lines"] >= min_lines) & (F.length(F.regexp_replace(chunk["body"], r"\s", "")) > 0)


def common_lines(one: Column, other: Column, at_end: bool) -> Column:
    """Number of equal lines at the end (or beginning) of two texts; 0 if one is null."""
    def lines(body: Column) -> Column:
        ls = F.split(body, "\n", -1)
        return F.reverse(ls) if at_end else ls

    def count(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.get(a, j) != F.get(b, j))), n)

    return F.when(one.isNull() | other.isNull(), F.lit(0)).otherwise(
        bound(lines(one), lambda a: bound(lines(other), lambda b: count(a, b))))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(i, h, gone)``: per document (id and text hash) with lines to remove,
    the numbers of those lines, from 1 and in order."""
    keyed = docs.select(quoted(id_col).alias("i"), F.xxhash64(quoted(text_col)).alias("h"),
                        text_or_empty(text_col).alias("t"))
    # Occurrences: hashes and positions only.
    found = keyed.select("i", "h", F.explode(F.transform(
        F.filter(chunks_of(F.col("t")), lambda c: _worth(c, min_lines)),
        lambda c: F.struct(F.xxhash64(c["body"]).alias("x"), c["first"].alias("k")))).alias("c"))
    places = table_checkpoint(found.select("i", "h", "c.x", "c.k"), "line-chunks")
    # Rows that agree in id and text are one document.
    here = F.struct(F.col("i").isNull().alias("no_id"), "i", "h", "k")
    repeats = (places.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("one"))
               .where("n > 1").select("x", "one"))
    wanted = table_checkpoint(
        places.join(repeats, "x")
        .select("i", "h", F.struct("k", "x", (here == F.col("one")).alias("is_first")).alias("w"))
        .groupBy("i", "h").agg(F.collect_set("w").alias("ws")), "line-wanted")

    def with_neighbours(cs: Column) -> Column:
        return F.transform(cs, lambda c, at: F.struct(
            F.get(F.filter("ws", lambda w: w["k"] == c["first"]), F.lit(0)).alias("w"), c["lines"].alias("lines"),
            c["body"].alias("body"),
            F.when(at > 0, F.concat_ws("\n", *(F.get(cs, at - k)["body"] for k in range(AROUND, 0, -1)))).alias("before"),
            F.when(at < F.size(cs) - 1, F.concat_ws("\n", *(F.get(cs, at + k)["body"] for k in range(1, AROUND + 1))))
            .alias("after")))

    bodies = (_null_safe(_marked(keyed, wanted).where("may"), wanted).dropDuplicates(["d"])
              .select("i", "h", F.explode(F.filter(bound(chunks_of(F.col("t")), with_neighbours),
                                                   lambda c: c["w"].isNotNull())).alias("c"))
              .select("i", "h", "c.w.k", "c.w.x", "c.w.is_first", "c.lines", "c.body", "c.before", "c.after"))
    bodies = table_checkpoint(bodies, "line-bodies")
    firsts = bodies.where("is_first").select("x", F.col("body").alias("first_body"), F.col("before").alias("first_before"),
                                             F.col("after").alias("first_after"))
    same = (bodies.where(~F.col("is_first")).join(firsts, "x")
            .where(F.col("body") == F.col("first_body"))
            .select("i", "h", (F.col("k") - common_lines(F.col("before"), F.col("first_before"), True)).alias("first"),
                    (F.col("k") + F.col("lines") - 1
                     + common_lines(F.col("after"), F.col("first_after"), False)).alias("last")))
    return same.groupBy("i", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(
        F.sequence("first", "last"))))).alias("gone"))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with ``may``: whether their hash ``h`` may be among those of the
    keys (it is not where ``may`` is false)."""
    slot = F.pmod(F.col("h"), F.lit(SLOTS)) + 1
    bit = F.bitmap_bit_position(slot)
    # Dealt first: a partial bitmap per task would be far larger than the hashes.
    slots = (keys.select(F.bitmap_bucket_number(slot).alias("bucket"), bit.alias("bit")).repartition("bucket")
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(slots), "bucket", "left")
            .withColumn("may", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
            .drop("bucket", "bits"))


def _null_safe(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by ``d``, the id and hash of a text (equal structs may hold nulls).
    Both sides are shuffled at any size, as those of large tables are."""
    key = F.struct("i", "h").alias("d")
    return left.withColumn("d", key).join(right.select(key, *[c for c in right.columns if c not in "ih"]).hint("merge"),
                                          "d", how)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(row, removed, kept)`` per input row: the row itself, its runs of
    removed lines (structs ``first, lines, body``, in order) and the text
    without them.

    The lines that stay are joined by line feeds.  A null text stays null and
    an empty one empty.  Chunks without a character outside white space are
    never removed, but for blank lines that a repeated chunk grows into.  Rows
    that agree in id and text are one document and get the same result; rows
    with a null id take part, after all others.  An empty table gives an empty
    result.
    """
    found = table_checkpoint(repeated_lines(docs, min_lines, id_col, text_col), "lines-gone")
    rows = _marked(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("i"),
                               F.xxhash64(quoted(text_col)).alias("h")), found)
    cut = _null_safe(rows.where("may"), found, "left").select("row", "gone")
    whole = rows.where("NOT may").select("row", F.lit(None).cast(found.schema["gone"].dataType).alias("gone"))
    gone = F.col("gone")
    parted = cut.unionByName(whole).withColumn("t", F.col("row").getField(text_col)).select(
        "row", "t", "gone", F.when(gone.isNotNull(), F.split("t", "\n", -1)).alias("ls"))
    # The set functions of arrays keep the order of their first argument.
    runs = F.zip_with(F.array_except(gone, F.transform(gone, lambda k: k + 1)),
                      F.array_except(gone, F.transform(gone, lambda k: k - 1)),
                      lambda first, last: _chunk(F.col("ls"), first, last))
    left = F.array_except(F.sequence(F.lit(1), F.size("ls")), gone)
    return parted.select(
        "row",
        F.coalesce(runs, F.array().cast("array<struct<first:int,lines:int,body:string>>")).alias("removed"),
        F.when(gone.isNull(), F.col("t")).otherwise(
            F.array_join(F.transform(left, lambda k: F.element_at("ls", k)), "\n")).alias("kept"))

import contextlib
import hashlib
import io
import random

from pyspark.sql import functions as F

from basketlens.llm import line_dedup
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents


def line_hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:6], 16)


def chunks(text):
    """``(first line from 0, lines)`` of every chunk."""
    lines = (text or "").split("\n")
    hashes = [line_hash(x) for x in lines]
    marks = [(h + (hashes[k - 1] * 31 if k else 0)) % 1000003 % 2 == 0 for k, h in enumerate(hashes)]
    out, first = [], 0
    for k in range(len(lines)):
        if k == len(lines) - 1 or (0 < k < len(lines) - 2 and marks[k] and not marks[k - 1]):
            out.append((first, lines[first:k + 1]))
            first = k + 1
    return out


def alike(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def plain(rows):
    """Kept text per row; rows come in order of id."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        gone, own = set(), chunks(text)
        for at, (first, lines) in enumerate(own):
            if len(lines) < 2 or not "".join(lines).strip():
                continue
            before = [x for _, ls in own[max(0, at - 2):at] for x in ls]
            after = [x for _, ls in own[at + 1:at + 3] for x in ls]
            if tuple(lines) not in seen:
                seen[tuple(lines)] = before, after
                continue
            before1, after1 = seen[tuple(lines)]
            gone |= set(range(first - alike(before[::-1], before1[::-1]), first + len(lines) + alike(after, after1)))
        out[i] = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)
    return out


def kept(df):
    return {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(df).collect()}


def test_against_plain(spark):
    rng = random.Random(1)
    lines = [f"line {k} " + "ab" * rng.randrange(5) for k in range(400)]
    passage = [rng.choice(lines) for _ in range(12)]
    rows = []
    for i in range(80):
        own = [rng.choice(lines) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.5:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # copies
    got = kept(documents(spark, rows, 7))
    want = plain(rows)
    assert got == want
    assert any(want[i] != t for i, t in rows)
    assert len(rows[3][1].split("\n")) > 1 and all(want[i] == "" for i in range(100, 130))  # copies go whole


def test_no_chunk_of_one_line_inside_a_text():
    rng = random.Random(4)
    for n in range(1, 60):
        sizes = [len(ls) for _, ls in chunks("\n".join(str(rng.random()) for _ in range(n)))]
        assert sum(sizes) == n and (sizes == [1] if n == 1 else min(sizes) >= 2)


def test_passage_goes_from_its_first_to_its_last_line(spark):
    """Whole chunks find a passage, and the lines around them go with it."""
    rng = random.Random(5)

    def text(n):
        return [f"{rng.random()}" for _ in range(n)]

    rows, passages = [], {}
    for i in range(40):
        passage = text(25)
        a, b, c, d = text(9), text(7), text(8), text(11)
        rows += [(2 * i, "\n".join(a + passage + b)), (2 * i + 1, "\n".join(c + passage + d))]
        passages[2 * i + 1] = "\n".join(c + d)
    got = kept(documents(spark, rows, 5))
    assert all(got[i] == t for i, t in rows if i % 2 == 0)
    assert sum(got[i] == t for i, t in passages.items()) == 40


def test_runs_are_the_removed_lines(spark):
    text = "\n".join(f"l{k}" for k in range(30))
    found = {r.row.doc_id: r for r in line_dedup.dedup_lines(
        documents(spark, [(1, text), (2, text + "\nnew line\n" + text)])).collect()}
    assert found[1].removed == [] and found[1].kept == text
    lines = found[2].row.text.split("\n")
    for run in found[2].removed:
        assert run.body == "\n".join(lines[run.first - 1:run.first - 1 + run.lines])
    assert len(lines) - sum(r.lines for r in found[2].removed) == len(found[2].kept.split("\n"))


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [f"text {rng.random()}" for _ in range(200)]
    a = {tuple(b) for _, b in chunks("\n".join(lines))}
    b = {tuple(b) for _, b in chunks("\n".join(lines[:50] + ["something new"] + lines[50:]))}
    assert len(a - b) <= 3


def test_edges(spark):
    got = sorted((str(r.row.doc_id), r.kept, len(r.removed)) for r in
                 line_dedup.dedup_lines(documents(spark, EDGES)).collect())
    texts = sorted((str(i), t, 0) for i, t in EDGES)
    assert [g[0] for g in got] == [t[0] for t in texts]
    assert sorted(map(str, got)) == sorted(map(str, texts))  # nothing repeats over two lines
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    row = line_dedup.dedup_lines(documents(spark, [(1, "a\nb")])).select("row.*")
    assert row.columns == documents(spark, []).columns


def test_repeated_rows_and_null_ids(spark):
    text = "\n".join(f"l{k}" for k in range(30))
    got = [(r.row.doc_id, r.kept) for r in
           line_dedup.dedup_lines(documents(spark, [(5, text), (5, text), (None, text), (9, text)])).collect()]
    assert got.count((5, text)) == 2  # one document, twice
    assert (9, "") in got and (None, "") in got


def test_equal_hash_is_not_enough(spark, monkeypatch):
    """With a hash that always collides, only equal bytes go."""
    rows = [(k, f"a{k}\nb{k}\nc{k}\nd{k}") for k in range(20)] + [(50, "a3\nb3\nc3\nd3"), (51, "a0\nb0\nc0\nd0")]
    real = line_dedup.F.xxhash64

    class Colliding:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def xxhash64(*columns):
            text = str(columns[0])
            return F.lit(7).cast("long") if "body" in text else real(*columns)

    monkeypatch.setattr(line_dedup, "F", Colliding())
    got = kept(documents(spark, rows))
    for i, t in rows:
        same_as_first = {tuple(b) for _, b in chunks(t)} & {tuple(b) for _, b in chunks(rows[0][1])}
        assert got[i] == t or i != 0 and same_as_first


def test_plan_is_native(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        line_dedup.dedup_lines(table(spark, SF, "documents")).explain("formatted")
    assert "Python" not in buf.getvalue() and "Pandas" not in buf.getvalue() and "Arrow" not in buf.getvalue()


def test_only_texts_that_may_be_cut_are_shuffled(spark):
    rows = documents(spark, [(i, f"a{i}\nb{i}\nc{i}") for i in range(2000)])
    keyed = rows.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    marked = {r.i: r.may for r in line_dedup._marked(keyed, keyed.where("i % 100 = 0")).collect()}
    assert len(marked) == 2000 and all(marked[i] for i in range(0, 2000, 100)) and sum(marked.values()) < 30
    assert not any(r.may for r in line_dedup._marked(keyed, keyed.where("i < 0")).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup.dedup_lines(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [part for part in plan.split("Exchange hashpartitioning")[1:] if "text#" in part]
    assert texts and all("getbit" in part for part in texts)

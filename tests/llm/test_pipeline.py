import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketlens.llm import toxicity
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents
from .test_line_dedup import plain as plain_lines
from .test_simhash import plain as plain_print
from .test_simhash import union_find

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after every stage, each written and read again."""
    docs = table(spark, BIG, "documents")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], BIG).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_toxic_documents_go(spark, steps):
    net = toxicity.fit_on(steps[0], table(spark, BIG, "labels"))
    before = texts(steps[0])
    scores = toxicity.score_texts(net, [before[i].encode() for i in sorted(before)])
    want = {i for i, s in zip(sorted(before), scores) if s < toxicity.THRESHOLD}
    assert set(texts(steps[1])) == want and len(want) < len(before)


def test_repeated_chunks_go(steps):
    before, after = texts(steps[1]), texts(steps[2])
    want = plain_lines(sorted(before.items()))
    want = {i: t for i, t in want.items() if t == before[i] or t.strip()}
    assert after == want and after != before
    assert steps[2].where(F.col("n_chars") != F.length("text")).count() == \
        steps[2].join(steps[1].select("doc_id", F.col("text").alias("t")), "doc_id").where(
            (F.col("n_chars") != F.length("text")) & (F.col("t") == F.col("text"))).count()


def test_one_of_each_near_duplicate_group(steps):
    before, after = texts(steps[2]), texts(steps[3])
    prints = {i: plain_print(t) for i, t in before.items()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    pairs = []
    for k, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= 2)
        pairs += [(i, ids[k + 1 + n]) for n in near]
    assert set(after) == set(union_find(pairs, ids).values()) and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_leaks_go(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [r.text for r in table(spark, BIG, "benchmark").collect()]
    leaks = {i for i, t in before.items() if any(x in t for x in items)}
    assert leaks and not leaks & set(after)
    assert len(before) - len(after) <= len(leaks) * 1.2 + 2  # clean documents stay


def test_packing_covers_what_is_left(steps):
    kept = texts(steps[4])
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(kept)
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for spans in total.values():
        at = 0
        for start, n, _ in sorted(spans):
            assert start == at
            at += n
        assert at == spans[0][2]


def test_run_gives_the_stages_rows(spark, steps):
    key = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in df.collect())
    a, b = key(corpus_pipeline.run(spark, BIG)), key(steps[-1])
    whole = lambda rows: sorted((i, b"".join(x[3] for x in rows if x[0] == i)) for i in {x[0] for x in rows})
    assert whole(a) == whole(b)


def test_edges(spark):
    docs = documents(spark, EDGES)
    for df in (docs, documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df = spark.createDataFrame(df.collect(), df.schema)
    tox = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert tox.columns == docs.columns

"""Token files against the tokenizer on whole texts, and what the files hold."""

import glob
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketlens.llm import queries, token_files
from basketlens.llm.common import table

from .helpers import EDGES, SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_query_against_whole_texts(spark, plain):
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op13_token_files(spark, SF).collect()}
    assert len(got) == len(rows)
    start = 0
    for doc_id, text in rows:
        ids = plain(text)
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


WILD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 　'<|>ΣσςİÅÅ̈ͅßÿ×÷ª"),
                         st.sampled_from("abst'1A,.")), max_size=40)


@pytest.fixture(scope="module")
def encoders(plain):
    with open(PATH, "rb") as f:
        data = f.read()
    return token_files.WordEncoder(data, 50), token_files.WordEncoder(data)


@settings(max_examples=300, deadline=None)
@given(WILD, WILD)
def test_words_apart_give_the_ids_of_the_text(plain, encoders, a, b):
    for text in (a, a + " " + b, a + "<|endoftext|>" + b, a + "\n" + b.upper()):
        for e in encoders:
            assert np.frombuffer(e.encode(text), dtype="<u4").tolist() + [1] == plain(text)


def test_every_latin_character(plain, encoders):
    """Every printable character up to U+00FF, alone and between letters."""
    for c in map(chr, [*range(33, 127), *range(160, 256)]):
        for text in (c, f"a{c}b", f"{c}{c}'s", f"A{c.upper()}9{c}"):
            assert np.frombuffer(encoders[1].encode(text), dtype="<u4").tolist() + [1] == plain(text)


def test_words_are_looked_up_once_a_batch(plain, encoders):
    """However often a word occurs in a batch; words met again outlive a full memo."""
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    e = token_files.WordEncoder(encoders[0].tokenizer.to_str().encode(), 50)
    e.words = Counting(e.words)
    texts = ["one two one " * 300, "", " two\tthree " * 300]
    ids, sizes = e.encode_all(pa.array(texts)[0:])
    assert Counting.asked <= 4
    assert [x.tolist() + [1] for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in texts]
    e.encode("two one")
    for first in range(0, 200, 10):
        text = " ".join(f"w{k}" for k in range(first, first + 10))
        assert np.frombuffer(e.encode(text), "<u4").tolist() + [1] == plain(text)
        assert len(e.words) <= 50
        if first == 40:
            assert {"one", "two"} < set(e.words) and "three" not in e.words
    ids, sizes = e.encode_all(pa.array(["x y", "one", "two three one"])[1:])  # a slice with an offset
    assert (ids.tolist(), sizes.tolist()) == (plain("one")[:-1] + plain("two three one")[:-1], [len(plain("one")) - 1, len(plain("two three one")) - 1])


def test_edge_rows(spark, plain, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(documents(spark, EDGES, 3), path, PATH, partitions=4)
    got = token_files.read_tokens(spark, path).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((i or 0, plain(t)) for i, t in EDGES)
    # ids ascend with the starts, and the starts have no gap
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in EDGES], key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens


def test_empty_table_and_text_ids(spark, tmp_path, plain):
    path = str(tmp_path / "none")
    token_files.write_tokens(documents(spark, [(1, "x")]).where("false"), path, PATH)
    assert token_files.checksums(token_files.read_tokens(spark, path)).collect() == []
    named = documents(spark, [(2, "b c"), (1, "a")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    token_files.write_tokens(named, str(tmp_path / "named"), PATH)
    got = token_files.find(spark, str(tmp_path / "named"), ["d2"], "string").collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [("d2", plain("b c"))]


def _rows_from_scan(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    leaf = leaf.executedPlan() if hasattr(leaf, "executedPlan") and "Adaptive" in leaf.nodeName() else leaf
    return leaf.metrics().apply("numOutputRows").value()


def test_stripes_row_groups_and_pruning(spark, tmp_path):
    """Several stripes in a file, several read tasks, and a lookup that reads
    row groups instead of the table."""
    path = str(tmp_path / "big")
    docs = spark.range(0, 60_000, 1, 4).select((F.col("id") * 3).alias("doc_id"),
                                               F.concat_ws(" ", F.lit("some words and number"), "id").alias("text"))
    token_files.write_tokens(docs, path, PATH, partitions=2, stripe_bytes=64 << 10, row_group=1000)
    files = sorted(glob.glob(path + "/*.orc"))
    assert len(files) == 2
    assert all(pyarrow.orc.ORCFile(f).nstripes > 1 for f in files)
    with open(files[0], "rb") as f:
        assert f.read(3) == b"ORC"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert token_files._files(spark, path, "bigint").rdd.getNumPartitions() > len(files)
        assert token_files.read_tokens(spark, path).count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # minima and maxima: one row group holds the id
    assert _rows_from_scan(token_files.find(spark, path, [30_000])) <= 2_000
    assert sorted(r.doc_id for r in token_files.find(spark, path, [30_000, 90_003, 7]).collect()) == [30_000, 90_003]
    # Bloom filters: ids within the range that no document has
    assert _rows_from_scan(token_files.find(spark, path, [30_001])) == 0
    assert re.search(r"PushedFilters: \[.*doc_id", token_files.find(spark, path, [5])._jdf.queryExecution().toString())

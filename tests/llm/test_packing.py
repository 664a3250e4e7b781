from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketlens.llm import packing
from basketlens.llm.common import table
from .helpers import EDGES, SF, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(pieces, texts, plain, length):
    """Pieces cover every document's ids once; sequences have no gap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, text in texts.items():
        want = plain(text or "") + [0]
        at, got = 0, []
        for start, ids, total in sorted(by_doc[doc_id]):
            assert start == at and total == len(want)
            at += len(ids)
            got += ids
        assert got == want
    assert set(by_doc) == set(texts)
    return by_sequence


def test_whole_table(spark, plain):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack(docs, PATH).collect()
    sequences = check(pieces, texts, plain, 1024)
    tokens = sum(p.length for p in pieces)
    assert len(sequences) <= -(-tokens // 1024) * 1.03 + 1


@pytest.mark.parametrize("length,limit,cut", [(16, 2, None), (16, 2, 4), (32, 5, 1), (8, 1, None)])
def test_small_windows_and_merges(spark, plain, monkeypatch, length, limit, cut):
    monkeypatch.setattr(packing, "FAN_IN", 2)  # several rounds of merging
    docs = table(spark, SF, "documents").where("n_chars < 400").repartition(9, "doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.pack(docs, PATH, length, limit, cut).collect()
    sequences = check(pieces, texts, plain, length)
    tokens = sum(p.length for p in pieces)
    assert len(sequences) * length <= tokens * 1.6 + length


def test_edges(spark, plain):
    rows = [(i, t) for i, t in EDGES if i not in (5, None)]
    check(packing.pack(documents(spark, rows), PATH).collect(), dict(rows), plain, 1024)
    repeated = packing.pack(documents(spark, [(5, "one"), (5, "one"), (None, "one")]), PATH).collect()
    assert len(repeated) == 3 and {p.length for p in repeated} == {len(plain("one")) + 1}
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_best_fit_rule():
    state = packing.OpenWindows(10, 2, None)
    log = []
    for window, size in enumerate((6, 3, 4, 5, 6)):
        for where, tokens, closes in state.place(size):
            if where is None:
                where = window
                packing.insort(state.rooms, (10 - tokens, window))
            log.append((size, where, tokens, closes))
    # 6 -> new; 3 -> best fit behind 6; 4 -> new; 5 -> behind 4;
    # 6 fits nowhere: the fullest (9 of 10, both) goes, then a new one opens
    assert log == [(6, 0, 6, False), (3, 0, 3, False), (4, 2, 4, False), (5, 2, 5, False),
                   (6, 0, 0, True), (6, 4, 6, False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ranks_give_the_same_ids(text):
    t = Tokenizer.from_file(PATH)
    fast = packing.encoder(packing.vocabulary(PATH))
    for x in (text, text + "<|endoftext|>" + text):
        assert fast([x])[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_without_ranks(tmp_path):
    copy = tmp_path / "alone.json"
    copy.write_bytes(open(PATH, "rb").read())
    known = packing.vocabulary(str(copy))
    assert known.pattern is None
    text = "The same ids, 12 ways\n <|endoftext|>"
    assert packing.encoder(known)([text])[0].tolist() == packing.encoder(packing.vocabulary(PATH))([text])[0].tolist()


def test_special_names_are_one_id(plain):
    """With the ranks and with the tokenizer's file alone."""
    with open(PATH, "rb") as f:
        slow = packing.encoder(packing.Vocabulary(f.read(), None))
    fast = packing.encoder(packing.vocabulary(PATH))
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "a<|endoftext|>\n\n b"):
        assert fast([text])[0].tolist() == slow([text])[0].tolist() == plain(text)
    assert len(plain("a <|endoftext|> b")) == 4

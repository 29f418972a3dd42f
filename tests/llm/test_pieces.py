"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import SF, none, odd, shipped  # noqa: F401

from spanwise.llm import sentence_pieces as sp
from spanwise.llm.common import SLICE_BYTES, table
from spanwise.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sp.read_model(PATH)
PIECES = [" ", "  ", "\n", "\t", sp.MARK, "　", "'", "a", "B", "the", "tion", "é", "é", "漢", "日本", "१", "1", "!", "😀", "\0",
          "\x1c", " ", "<s>", "</s>", "<unk>", "<0x41>", "<0xE6>", "ﬁ", "ß", "﻿", "‍", "⁇", "�"]
TEXT = st.one_of(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.text(max_size=30))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def own_ids(texts, words=None):
    n, ids = (words or sp.WordTable(MODEL)).encode(texts)
    ends = [0, *n.cumsum().tolist()]
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_encoding_and_decoding_equal_the_library(library, texts):
    expected = [library.encode(t) for t in texts]
    assert own_ids(texts) == expected
    decode = sp.decoder(MODEL)
    assert [decode(x) for x in expected] == [library.decode(x) for x in expected]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262), st.just(28705)), max_size=12))
def test_any_ids_decode_as_in_the_library(library, ids):
    assert sp.decoder(MODEL)(ids) == library.decode(ids)


def test_long_words_and_a_table_that_starts_anew(library, monkeypatch):
    state = random.Random(5)
    letters = "".join(state.choice("abcdeé漢 ") for _ in range(30_000))
    texts = ["ab" * 9000, "é" * 900, " " * 3000, "漢字" * 2000, letters, letters.replace(" ", "")]
    assert own_ids(texts) == [library.encode(t) for t in texts]
    monkeypatch.setattr(sp, "TABLE_CHARACTERS", 10)
    words = sp.WordTable(MODEL)
    for text in ("one two", "two three", letters, "one two"):
        assert own_ids([text, text, ""], words) == [library.encode(text)] * 2 + [[]]


def test_each_distinct_word_is_segmented_once():
    words, seen = sp.WordTable(MODEL), []
    segment = words.segment
    words.segment = lambda w: seen.append(w) or segment(w)
    words.encode(["red blue red", "blue  red", None])
    words.encode(["red red"])
    assert sorted(seen) == sorted({"▁red", "▁blue", "▁▁red"})


def test_other_models_are_refused(tmp_path):
    def field(number, content):
        return bytes([number << 3 | 2, len(content)]) + content

    bad = tmp_path / "bad.model"
    trainer = field(2, bytes([3 << 3, 2, (35 << 3) & 127 | 128, (35 << 3) >> 7, 1]))
    rule = field(3, bytes([4 << 3, 0]))
    for content, reason in ((b"", "BPE"), (trainer, "repeated spaces"), (trainer + rule, "every byte"),
                            (field(1, field(1, "a▁b".encode())) + trainer + rule, "crosses a marker")):
        bad.write_bytes(content)
        with pytest.raises(ValueError, match=reason):
            sp.read_model(str(bad))


def test_odd_rows(spark, odd, none, library):
    done = sp.decode(sp.encode(odd, PATH), PATH)
    assert done.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids, r.decoded) for r in done.collect())
    assert got == sorted(((r.doc_id is None, r.doc_id or 0), len(e := library.encode(r.text or "")), e, library.decode(e)) for r in odd.collect())
    assert sp.decode(sp.encode(none, PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(None, 1)], "ids array<int>, decoded int")
    assert [tuple(r) for r in sp.decode(nulls, PATH).collect()] == [(None, None)]


def test_texts_longer_than_a_slice(spark, library):
    text = "Some words, 漢字 and more.\n " * (SLICE_BYTES // 20)
    docs = spark.createDataFrame([(1, "before"), (2, text), (3, "after")], "doc_id long, text string")
    assert len(text) > SLICE_BYTES and {r.doc_id: r.ids for r in sp.encode(docs, PATH).collect()} == {
        1: library.encode("before"), 2: library.encode(text), 3: library.encode("after")}


def test_query_on_whole_texts(spark, library):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {tuple(r) for r in QUERIES["op12_sentence_pieces"](spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    ids = {r.doc_id: library.encode(r.text or "") for r in docs}
    assert got == {(k, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for k, x in ids.items()}

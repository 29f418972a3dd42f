"""Token counts and byte-level encoding against the libraries."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from odd_rows import none, odd, shipped  # noqa: F401

from spanwise.llm import byte_bpe
from spanwise.llm.codepoints import rank_classes
from spanwise.llm.token_counts import count_tokens, counter, prove_whole_tokens

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
PIECES = [" ", "  ", "\n", "\t", " ", "　", "'", "'s", "'re", "'r", "'v", "'ve", "'l", "'ll", "'t", "'d", "'m", "r", "e",
          "l", "s", "a", "B", "é", "漢", "१", "1", "!", "-", "😀", "́", "\0", "\x1c", "<|endoftext|>", "՘", "ſ"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKED, SYMBOLS = byte_bpe.read_ranks(RANKS), byte_bpe.symbol_table(rank_classes())


def own_ids(texts):
    return [
        [RANKED[part] for a, b in zip(at, at[1:]) for part in byte_bpe.merge_pairs(data[a:b], RANKED)]
        for data, at in byte_bpe.pieces_of(texts, SYMBOLS)
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_encoding_equals_the_library(library, texts):
    assert own_ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(library):
    texts = ["ab" * 4000, "é" * 900, " " * 3000, "z" * 65]
    assert own_ids(texts) == [library.encode_ordinary(t) for t in texts]


def test_blocked_scan_is_a_running_product():
    state = random.Random(3)
    for n in (0, 1, 63, 64, 65, 5000):
        symbols = byte_bpe.np.array([state.randrange(12) for _ in range(n)], byte_bpe.np.int64)
        states, now = [], 0
        for s in symbols:
            now = byte_bpe._step(now, s)
            states.append(now)
        assert byte_bpe._VALUE[byte_bpe.scan(byte_bpe._OF_SYMBOL[symbols]), 0].tolist() == states


@pytest.fixture(scope="module")
def counts():
    return counter(prove_whole_tokens(JSON, public_tokenizers.PATTERN)), Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_counts_equal_the_library(counts, texts):
    own, tokenizer = counts
    assert own(texts).tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_odd_rows(spark, odd, none, library):
    tokenizer = Tokenizer.from_file(JSON)
    counted = count_tokens(odd, JSON, public_tokenizers.PATTERN, limit=4)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = sorted((r.text or "") for r in odd.collect())
    expected = sorted((len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 4) for t in texts)
    assert sorted(tuple(r)[1:] for r in counted.collect()) == expected
    coded = byte_bpe.decode(byte_bpe.encode(odd, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded).decode() for r in coded) == texts
    for r in coded:
        text = bytes(r.decoded)
        assert r.ids == library.encode_ordinary(text.decode()) and r.n_tokens == len(r.ids)
        assert [text[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(text)])] == [library.decode_single_token_bytes(i) for i in r.ids]
    assert count_tokens(none, JSON, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS), RANKS).count() == 0


def test_boundaries_of_few_texts_are_found_together(spark, shipped, library, monkeypatch):
    """Slices of the encoder hold half a megabyte of text, and the tokens do not depend on where they end."""
    bounds, whole = [], byte_bpe.map_texts
    monkeypatch.setattr(byte_bpe, "map_texts", lambda docs, i, t, start, fields, most: bounds.append(most) or whole(docs, i, t, start, fields, 100))
    rows = [(i, ("it's a text, " + PIECES[i % len(PIECES)]) * (i % 9)) for i in range(120)] + [(120, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.ids, bytes(r.decoded).decode()) for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).collect()}
    assert bounds == [byte_bpe.ENCODED_BYTES] and bounds[0] <= 500_000
    assert got == {i: (library.encode_ordinary(t or ""), t or "") for i, t in rows}

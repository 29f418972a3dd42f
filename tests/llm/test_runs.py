"""Periodic runs and suffix trees against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import SF, none, odd, shipped  # noqa: F401

from spanwise.llm import periodic_runs as pr
from spanwise.llm.common import SLICE_BYTES, table
from spanwise.llm.queries import QUERIES
from spanwise.llm.suffix_tree import RangeMinimum, SuffixTree


def runs_by_hand(words, least, exponent):
    """Runs straight from the definition: for each period the stretches in which words that far apart are equal."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                found.setdefault((i, length), p)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def own_runs(words, least=pr.MIN_WORDS, exponent=pr.MIN_EXPONENT):
    number = {}
    letters = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return [tuple(r) for r in pr.runs_of(letters, least, exponent).tolist()]


def by_period(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


BLOCK = st.lists(st.integers(0, 2), min_size=1, max_size=6)
TEXT = st.lists(st.tuples(BLOCK, st.integers(1, 7)), max_size=8).map(lambda parts: [x for block, k in parts for x in block * k])


@settings(max_examples=400, deadline=None)
@given(TEXT, st.sampled_from([(24, 3), (4, 2), (1, 2), (9, 3), (10, 4), (7, 5)]))
def test_runs_equal_the_definition(words, rule):
    assert own_runs(words, *rule) == by_period(runs_by_hand(words, *rule))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_two_letters(words):
    assert own_runs(words, 2, 2) == by_period(runs_by_hand(words, 2, 2))


def test_long_runs_of_long_periods():
    state = np.random.default_rng(4)
    for n, p in ((900, 3), (2000, 401), (1500, 7)):
        words = state.integers(0, 50, 300).tolist() + (state.integers(0, 9, p).tolist() * (n // p + 1))[:n]
        words += state.integers(0, 3, 200).tolist()
        assert own_runs(words) == by_period(runs_by_hand(words, 24, 3)) and own_runs(words)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 2500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert own_runs(fibonacci[-1], 6, 2) == by_period(runs_by_hand(fibonacci[-1], 6, 2))
    assert own_runs(["x"] * 5000) == [(0, 5000, 1)]
    assert own_runs([]) == own_runs(["x"] * 23) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=150), st.randoms(use_true_random=False))
def test_tree_orders_suffixes_and_gives_common_prefixes(letters, state):
    text = [*letters, 4]
    tree = SuffixTree(np.array(text))
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert [tree.rank[i] for i in order] == list(range(len(text)))
    pairs = [(state.randrange(len(text)), state.randrange(len(text))) for _ in range(60)]
    for (i, j), common in zip(pairs, tree.common(*np.array(pairs).T).tolist()):
        a, b = text[i:], text[j:]
        assert common == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


def test_range_minimum():
    state = np.random.default_rng(2)
    for n in (1, 31, 32, 33, 1000, 5000):
        values = state.integers(0, 1000, n).astype(np.int32)
        a, b = state.integers(0, n, 300), state.integers(0, n, 300)
        expected = [values[min(i, j) : max(i, j) + 1].min() for i, j in zip(a, b)]
        assert RangeMinimum(values)(a, b).tolist() == expected


def test_gaps_hide_only_words_outside_runs():
    words = [f"w{i}" for i in range(500)] + ["a", "b", "c"] * 10 + [f"v{i}" for i in range(500)] + ["a", "b", "c"] * 9
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    text, places = pr._skeleton(np.array([number[w] for w in words]), 16)
    assert len(text) == 30 + 27 + 3 and text[-1] == text.max() and places[-1] == len(words)
    assert own_runs(words) == [(500, 30, 3), (1030, 27, 3)]


def collapsed_by_hand(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_rows(spark, odd, none):
    got = pr.periodic_runs(odd, 1, 2)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    expected = []
    for r in odd.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        runs = by_period(runs_by_hand(words, 1, 2))
        expected.append((repr(r.doc_id), len(words), runs, collapsed_by_hand(words, runs)))
    assert sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == sorted(expected)
    assert pr.periodic_runs(none).count() == 0
    with pytest.raises(ValueError, match="twice"):
        pr.runs_of(np.zeros(50, np.int64), 24, 1)


def test_texts_longer_than_a_slice(spark):
    block = [f"word{i}" for i in range(7000)]
    text = " ".join(["start", *block * 41])
    docs = spark.createDataFrame([(1, "a b " * 20), (2, text)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(docs).collect()}
    assert len(text) > SLICE_BYTES
    assert got == {1: ([(0, 40, 2)], "a b"), 2: ([(1, 41 * 7000, 7000)], " ".join(["start", *block]))}


def test_query_on_whole_texts(spark):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got, planted = {tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}, 0
    expected = set()
    for doc in table(spark, SF, "documents").collect():
        words = [w.decode() for w in (doc.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = by_period(runs_by_hand(words, 24, 3))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        expected.add((doc.doc_id, len(runs), *four, sha(listed), sha(collapsed_by_hand(words, runs))))
    assert planted > 5 and got == expected

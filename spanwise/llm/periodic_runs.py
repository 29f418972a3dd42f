"""Operator 13. Periodic runs of words, found with suffix trees and Lyndon roots.

A run is a stretch of words that repeats with some period and cannot be extended.
Within every run stands a Lyndon word as long as the period, which is the longest
Lyndon word from its place on, in the order of the words or in the reverse order.
So each place gives at most two candidates. A candidate is extended to the right by
the longest common prefix of two suffixes, and to the left by that of two suffixes
of the reversal; both are lowest common ancestors in suffix trees of Ukkonen's
construction, answered in constant time over Euler tours.

The trees are made for each document by itself. Words that cannot be in a run are
put together first: all of a run's words lie in windows of words that recur in the
document, so a gap between such windows is one letter that occurs nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanwise.llm.common import map_texts
from spanwise.llm.suffix_tree import SuffixTree

#: Words of the shortest run, and how often the period fits into it at least.
MIN_WORDS = 24
MIN_EXPONENT = 3
#: Bytes of distinct words that a task keeps numbered; beyond it numbering starts anew with the next text.
NUMBERED_BYTES = 20_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def recurring(letters: np.ndarray, window: int) -> np.ndarray:
    """Which letters lie in a window of that many letters that recurs; by hash, so at worst too many are named."""
    n = len(letters) - window + 1
    inside = np.zeros(len(letters), bool)
    if n < 2:
        return inside
    # Hashes of windows whose lengths are powers of two make up those of any length.
    power, size, total, done = _mixed(letters.astype(np.uint64) + np.uint64(1)), 1, np.zeros(n, np.uint64), 0
    while True:
        if window & size:
            total = _mixed(total * _FACTOR + power[done : done + n])
            done += size
        if done == window:
            break
        power = _mixed(power[:-size] * _FACTOR + power[size:])
        size *= 2
    order = np.argsort(total, kind="stable")
    equal = total[order[1:]] == total[order[:-1]]
    places = np.concatenate([order[1:][equal], order[:-1][equal]])
    steps = np.zeros(len(letters) + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _skeleton(letters: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters that may be in a run, renumbered from 0, gaps as one letter of their own each, and all their places.

    The last letter, and that alone, is a gap behind the text.
    """
    inside = recurring(letters, window)
    gap_begins = ~inside & np.concatenate([[True], inside[:-1]])
    places = np.concatenate([np.flatnonzero(inside | gap_begins), [len(letters)]])
    of_gap = np.concatenate([~inside[places[:-1]], [True]])
    kept = np.zeros(len(places), np.int64)
    distinct, kept[~of_gap] = np.unique(letters[places[~of_gap]], return_inverse=True)
    kept[of_gap] = len(distinct) + np.arange(of_gap.sum())
    return kept, places


def lyndon_lengths(rank: np.ndarray) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word from each place on, by ranks of suffixes: in their order, and in its reverse.

    It ends before the next suffix that is smaller, or greater in the reverse order.
    """
    n, ranks = len(rank), rank.tolist()
    smaller, greater = [0] * n, [0] * n
    low, high = [], []
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while low and ranks[low[-1]] > r:
            low.pop()
        while high and ranks[high[-1]] < r:
            high.pop()
        smaller[i] = (low[-1] if low else n) - i
        greater[i] = (high[-1] if high else n) - i
        low.append(i)
        high.append(i)
    return smaller, greater


def runs_of(letters: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs with at least `min_words` letters and `min_exponent` periods.

    Ordered by start, then period. Letters are numbers from 0; memory grows with the
    letters in recurring windows, about 400 bytes for each.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    none = np.empty((0, 3), np.int64)
    # Places i where letters i and i + period agree: so many in a row at least.
    window = -(-min_words * (min_exponent - 1) // min_exponent)
    if len(letters) < max(min_words, min_exponent):
        return none
    text, places = _skeleton(letters, window)
    n = len(text)
    if n <= min_words:
        return none
    forward = SuffixTree(text)
    at = np.arange(n) * (n + 1)
    i, period = np.divmod(np.unique(np.concatenate([at + x for x in lyndon_lengths(forward.rank)])), n + 1)
    fits = (period * min_exponent < n) & (i + period < n)
    i, period = i[fits], period[fits]
    right = forward.common(i, i + period)
    del forward
    # The letter before place k is place n - 1 - k of the reversal, whose last letter is one of its own.
    backward = SuffixTree(np.concatenate([text[-2::-1], [text[-1]]]))
    left = np.where(i > 0, backward.common(n - 1 - i, n - 1 - i - period), 0)
    length = left + period + right
    long = (length >= min_words) & (length >= min_exponent * period)
    found = np.unique(np.stack([i - left, period, length], 1)[long], axis=0)
    return np.stack([places[found[:, 0]], found[:, 2], found[:, 1]], 1)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period; a word goes if any run drops it."""
    steps = np.zeros(n + 1, np.int64)
    start, length, period = runs.T
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns id, `n_words`, `runs` (start, length and period, by start, then period) and `collapsed`, a row per input row.

    Words are what stands between ASCII white space, numbered from 0. A run is a
    stretch of words with smallest period p and at least `min_words` words and
    `min_exponent` times p, which neither neighbour extends. `collapsed` holds the words
    joined by one blank, without those that a run repeats after its first p words. Null
    and empty texts have no words, no runs and an empty text. Whole texts are looked
    at, whatever their length. Null and repeated ids are kept; other columns are not
    read, so their names cannot clash; an empty table gives none.
    """

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        numbers: dict[bytes, int] = {}
        held = 0

        def letters(words: list[bytes]) -> np.ndarray:
            nonlocal held
            if held > NUMBERED_BYTES:
                numbers.clear()
                held = 0
            for word in set(words).difference(numbers):
                numbers[word] = len(numbers)
                held += len(word)
            return np.array(list(map(numbers.__getitem__, words)), np.int64)

        def work(texts: list[str | None]) -> list[pa.Array]:
            counts, found, collapsed = [], [], []
            for text in texts:
                words = text.encode().split() if text else []
                runs = runs_of(letters(words), min_words, min_exponent)
                if len(runs):
                    words_left = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
                else:
                    words_left = words
                counts.append(len(words))
                found.append(runs)
                collapsed.append(b" ".join(words_left).decode())
            rows = np.concatenate([np.empty((0, 3), np.int64), *found])
            steps = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
            fields = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=["start", "length", "period"])
            return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(steps, fields), pa.array(collapsed, pa.string())]

        return work

    return map_texts(docs, id_col, text_col, start, _FIELDS)

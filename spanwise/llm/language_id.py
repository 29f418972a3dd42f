"""Operator 2. Language identification, words first, with back-off to character n-grams.

A known word scores by the logarithm of its frequency in each language. A word
that is not known is scored by the longest of its character n-grams that are, and
by shorter ones only if none of that length is.

Words and n-grams are known by hashes of their letters. Those of a slice of text are
taken from one array of its code points: sums of the letters' numbers times powers of a
factor tell the hash of any stretch, so that each distinct word is looked up, split
into n-grams and scored once for all its occurrences, without a loop over words.

Frequencies are counted over all training documents. What tasks hold of them has a
bound: an entry makes up at least a given share of a language's words or n-grams, and
that share is doubled until the model fits `MODEL_ROWS`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import bounded_rows, map_texts, text_slices

#: Least share of a language's words, and of its n-grams of a length, to be kept.
WORD_SHARE = 2e-5
GRAM_SHARE = 2e-5
#: Numbers of a model at most: its entries times the languages they occur in.
MODEL_ROWS = 8_000_000
#: Lengths of n-grams.
LONGEST = 4
#: Languages that a model may have; more are refused.
MOST_LANGUAGES = 500
#: What a language's score loses for each step to shorter n-grams, as a logarithm.
STEP = 0.4
#: Counts that a training task holds before it hands them on.
HELD_COUNTS = 2_000_000
#: Characters looked at together; a longer text is cut at a blank or mark of punctuation.
PIECE = 1_000_000

UNKNOWN = "und"
_LETTER, _MARK = 1, 2
_BREAK = re.compile(r"[\s!-@\[-`{-~。、，．]")
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)
# Numbers that stand for both ends of a word.
_BEGIN, _END = 0x110000, 0x110001


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter or a mark, and a number with 64 mixed bits."""
    import regex

    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_MARK, r"\p{M}+")):
        kinds[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), np.uint32)] = kind
    return kinds, np.random.Generator(np.random.PCG64(20240601)).integers(0, 2**64, 0x110002, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least the first n powers of the factor and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(n, 1024).bit_length()
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, f, np.uint64))]) for f in (_FACTOR, _INVERSE)]
    return _POWERS


class _Hasher:
    """Hashes of stretches of an array of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_letters()[1][codes] * up[: len(codes)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """Words of some texts: letters in `codes`, places, hash, and which text each is in."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    text: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Runs of letters and marks that hold a letter, in lower case."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters()[0][codes]
    inside = np.concatenate([[False], kinds > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    letters = np.concatenate([[0], np.cumsum(kinds == _LETTER)])
    real = letters[end] > letters[start]
    start, end = start[real], end[real]
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    return Words(codes, start, end, _Hasher(codes)(start, end), np.searchsorted(text_ends, start, "right"))


def pieces(text: str) -> list[str]:
    """A long text in parts, none of which cuts a word."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the given spans, and the number of the span each belongs to."""
    before = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum())), of


def grams_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words, and the number of the word each is in. Longer ones see both ends of a word, single characters do not."""
    size = end - start
    if n == 1:
        places, of = _spans(start, size)
        return _Hasher(codes)(places, places + 1), of
    begin = np.cumsum(size + 2) - (size + 2)
    marked = np.empty(int((size + 2).sum()), np.uint32)
    marked[begin], marked[begin + size + 1] = _BEGIN, _END
    from_, of = _spans(start, size)
    marked[_spans(begin + 1, size)[0]] = codes[from_]
    places, of = _spans(begin, np.maximum(size + 3 - n, 0))
    return _Hasher(marked)(places, places + n), of


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order; for words (0) and n-grams of each length sorted hashes and their scores by language."""

    languages: tuple[str, ...]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def _found(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key in a table, -1 where it has none."""
        known = self.tables[kind][0]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def word_scores(self, words: Words, first: np.ndarray) -> np.ndarray:
        """Scores of the words numbered `first`, a row for each."""
        row = self._found(0, words.key[first])
        out = np.zeros((len(first), len(self.languages)))
        out[row >= 0] = self.tables[0][1][row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            keys, of = grams_of(words.codes, words.start[first[left]], words.end[first[left]], n)
            row = self._found(n, keys)
            of, row = of[row >= 0], row[row >= 0]
            hits = np.bincount(of, minlength=len(left))
            met = hits > 0
            for i in range(len(self.languages)):
                total = np.bincount(of, self.tables[n][1][row, i], len(left))
                out[left[met], i] = total[met] / hits[met] - STEP * (LONGEST + 1 - n)
            left = left[~met]
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and the sum of their scores by language."""
        words = words_of(texts)
        counts = np.bincount(words.text, minlength=len(texts))
        _, first, which = np.unique(words.key, return_index=True, return_inverse=True)
        scores = self.word_scores(words, first)
        sums = [np.bincount(words.text, scores[which, i], len(texts)) for i in range(len(self.languages))]
        return counts, np.stack(sums, 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and n-grams of each language, summed within a task as far as memory allows."""
    held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (language, kind), parts in held.items():
            keys, n = _summed(parts)
            columns = [pa.array([language]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(np.full(len(keys), kind, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64)), pa.array(n)], names=["language", "kind", "entry", "n"])
        held.clear()

    for part in text_slices(batches):
        by_language: dict[str, list[str]] = {}
        for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            by_language.setdefault(language, []).extend(pieces(text))
        for language, texts in by_language.items():
            words = words_of(texts)
            keys, first, n = np.unique(words.key, return_index=True, return_counts=True)
            found = {0: (keys, n)}
            for k in range(1, LONGEST + 1):
                grams, of = grams_of(words.codes, words.start[first], words.end[first], k)
                found[k] = _summed([(grams, n[of])])
            for kind, counted in found.items():
                held.setdefault((language, kind), []).append(counted)
                n_held += len(counted[0])
        if n_held > HELD_COUNTS:
            for key, parts in held.items():
                held[key] = [_summed(parts)]
            n_held = sum(len(keys) for parts in held.values() for keys, _ in parts)
            if 2 * n_held > HELD_COUNTS:
                yield from handed_on()
                n_held = 0
    yield from handed_on()


def fit_languages(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    word_share: float = WORD_SHARE,
    gram_share: float = GRAM_SHARE,
) -> LanguageModel | None:
    """Model of the languages named in `lang_col`; rows with null language are left out. None without training words.

    All training texts are counted whole. More than `MOST_LANGUAGES` languages are refused.
    """
    texts = docs.select(named(lang_col).cast("string").alias("language"), named(text_col).cast("string").alias("text"))
    texts = texts.filter("language IS NOT NULL AND text IS NOT NULL")
    counts = texts.mapInArrow(_counts, "language string, kind int, entry long, n long")
    counts = counts.groupBy("language", "kind", "entry").agg(F.sum("n").alias("n"))
    counts = counts.cache()
    try:
        found = counts.groupBy("language", "kind").agg(F.sum("n").alias("total"))
        totals = {(r.language, r.kind): r.total for r in bounded_rows(found, MOST_LANGUAGES * (LONGEST + 1), "languages")}
        languages = tuple(sorted({language for language, _ in totals}))
        if not languages:
            return None
        total = counts.sparkSession.createDataFrame([(*k, n) for k, n in totals.items()], "language string, kind int, total long")
        while True:
            share = F.when(F.col("kind") == 0, word_share).otherwise(gram_share)
            kept = counts.join(F.broadcast(total), ["language", "kind"]).filter(F.col("n") >= share * F.col("total"))
            # An entry kept for one language needs its counts in all of them.
            rows = counts.join(kept.select("kind", "entry").distinct(), ["kind", "entry"])
            rows = rows.select("kind", "entry", "language", "n").limit(MODEL_ROWS + 1).toArrow()
            if rows.num_rows <= MODEL_ROWS:
                break
            word_share, gram_share = 2 * word_share, 2 * gram_share
    finally:
        counts.unpersist()
    place = {language: i for i, language in enumerate(languages)}
    sizes = np.array([[max(totals.get((x, k), 0), 1) for x in languages] for k in range(LONGEST + 1)], float)
    kinds, entries, n = (rows.column(c).to_numpy() for c in ("kind", "entry", "n"))
    coded = rows.column("language").combine_chunks().dictionary_encode()
    of = np.array([place[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    tables = {}
    for kind in range(LONGEST + 1):
        own = np.flatnonzero(kinds == kind)
        keys, which = np.unique(entries[own].view(np.uint64), return_inverse=True)
        table = np.full((len(keys), len(languages)), 0.5)
        table[which, of[own]] += n[own]
        tables[kind] = keys, np.log(table / sizes[kind])
    return LanguageModel(languages, tables)


def predict_language(
    docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns id, `lang_pred`, `score` (0 to 1: the posterior with equal priors), one row per input row.

    Texts of any length are read whole. Texts that are null or without letters (numbers and
    numerals are none), and all texts without a model, are "und" with score 0. Ties go
    to the first language in order. Null and repeated ids are kept; other columns are
    not read, so their names cannot clash; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        fitted = shared.value

        def work(texts: list[str | None]) -> list[pa.Array]:
            if fitted is None:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
            parts = [pieces(t or "") for t in texts]
            counts, totals = _over_pieces(fitted, parts)
            best = totals.argmax(1)
            sure = 1 / np.exp(np.maximum(totals - totals[np.arange(len(best)), best][:, None], -700)).sum(1)
            names = np.where(counts > 0, np.array(fitted.languages, object)[best], UNKNOWN)
            return [pa.array(names.tolist(), pa.string()), pa.array(np.where(counts > 0, sure, 0.0))]

        return work

    return map_texts(docs, id_col, text_col, start, "lang_pred string, score double")


def _over_pieces(model: LanguageModel, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """`LanguageModel.totals` of texts given in parts, about `PIECE` characters at a time."""
    counts, totals = np.zeros(len(parts), np.int64), np.zeros((len(parts), len(model.languages)))
    waiting: list[tuple[int, str]] = []
    size = 0

    def add() -> None:
        if waiting:
            n, sums = model.totals([piece for _, piece in waiting])
            of = [i for i, _ in waiting]
            np.add.at(counts, of, n)
            np.add.at(totals, of, sums)
            waiting.clear()

    for i, pieces_ in enumerate(parts):
        for piece in pieces_:
            if size + len(piece) > PIECE:
                add()
                size = 0
            waiting.append((i, piece))
            size += len(piece)
    add()
    return counts, totals

"""Operator 12. SentencePiece encoding and decoding by a table of distinct marked words.

In such a model a space is the marker that begins the word after it. Where no piece
holds a marker behind another character, no merge can cross the place before a run
of markers, so every marked word is segmented by itself. This is proved from the
vocabulary before anything is encoded. A task numbers the marked words it meets,
segments each distinct one once, and puts the ids of all texts together by position:
one look-up per word, then a gather from the table.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import map_texts

#: Characters and ids that the table of a task holds at most; a full table starts anew after a slice of texts.
TABLE_CHARACTERS = 8_000_000
#: Words beyond this many characters are merged with a heap, and leave the table with their slice.
LONG_WORD = 64

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")

# Fixed values of the model format: numbers of fields and kinds of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_KIND = 1, 2, 3
_MODEL_TYPE, _MARK_AS_SUFFIX, _BYTE_FALLBACK, _UNKNOWN_TEXT = 3, 24, 35, 44
_CHARACTER_MAP, _DUMMY_PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 4, 5
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2


@dataclass(frozen=True)
class PieceModel:
    """Ids and scores of the pieces that merges may build, ids of bytes, what each id stands for, and whether a mark leads it."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]
    marked: tuple[bool | None, ...]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of one message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> PieceModel:
    """Read a model and prove that marked words can be segmented one by one.

    The model must merge pairs (BPE) with byte fallback, leave characters as they
    are, add the leading marker, keep repeated spaces, and no piece may hold a marker
    behind another character. Any other model is refused.
    """
    with open(path, "rb") as file:
        parts = list(_fields(file.read()))
    trainer = dict(next((_fields(v) for k, v in parts if k == _TRAINER), ()))
    rule = dict(next((_fields(v) for k, v in parts if k == _NORMALIZER), ()))
    if trainer.get(_MODEL_TYPE, 1) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_MARK_AS_SUFFIX):
        raise ValueError("a BPE model with byte fallback and leading markers is needed")
    if rule.get(_CHARACTER_MAP) or rule.get(_SQUEEZE, 1) or not rule.get(_DUMMY_PREFIX, 1) or not rule.get(_ESCAPE, 1):
        raise ValueError("a model that keeps characters and repeated spaces and adds the leading marker is needed")
    unknown = trainer.get(_UNKNOWN_TEXT, " ⁇ ".encode())
    ids, scores, of_byte, surface, marked = {}, {}, {}, [], []
    for number, piece in enumerate(v for k, v in parts if k == _PIECES):
        about = dict(_fields(piece))
        text, kind = about[_PIECE_TEXT].decode(), about.get(_PIECE_KIND, _NORMAL)
        if kind == _NORMAL:
            if MARK in text.lstrip(MARK):
                raise ValueError(f"piece {text!r} crosses a marker")
            ids[text] = number
            scores[text] = struct.unpack("<f", about.get(_PIECE_SCORE, bytes(4)))[0]
            surface.append(text.replace(MARK, " ").encode())
            marked.append(text.startswith(MARK))
        elif kind == _BYTE:
            of_byte[int(text[3:5], 16)] = number
            surface.append(bytes([int(text[3:5], 16)]))
            marked.append(False)
        elif kind in (_CONTROL, _UNKNOWN):
            surface.append(unknown if kind == _UNKNOWN else b"")
            marked.append(None if kind == _CONTROL else False)
        else:
            raise ValueError(f"piece {text!r} is of a kind that is not supported")
    if len(of_byte) != 256:
        raise ValueError("a piece for every byte is needed")
    return PieceModel(ids, scores, tuple(of_byte[b] for b in range(256)), tuple(surface), tuple(marked))


def merge_short(word: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a word: the pair with the best score is merged first, ties from the left."""
    parts, none = list(word), float("-inf")
    get = scores.get
    of_pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while of_pair:
        best = max(of_pair)
        if best == none:
            break
        i = of_pair.index(best)
        parts[i] += parts.pop(i + 1)
        of_pair.pop(i)
        if i:
            of_pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(of_pair):
            of_pair[i] = get(parts[i] + parts[i + 1], none)
    return parts


def merge_long(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """The same pieces for a word of any length, by a heap of pairs; `longest` is the length of the longest piece."""
    n = len(word)
    parts = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and len(parts[i]) + len(parts[j]) <= longest:
            pair = parts[i] + parts[j]
            if pair in scores:
                heapq.heappush(heap, (-scores[pair], i, len(pair)))

    for i in range(n):
        offer(i)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        parts[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p]


def segmenter(model: PieceModel) -> Callable[[str], list[int]]:
    """Function from a marked word to its ids; characters without a piece become the ids of their bytes."""
    ids, scores, byte_ids, longest = model.ids, model.scores, model.byte_ids, model.longest

    def segment(word: str) -> list[int]:
        parts = merge_short(word, scores) if len(word) <= LONG_WORD else merge_long(word, scores, longest)
        found: list[int] = []
        for part in parts:
            number = ids.get(part)
            if number is None:
                found += [byte_ids[b] for b in part.encode()]
            else:
                found.append(number)
        return found

    return segment


class WordTable:
    """Distinct marked words with their ids in one array: word k has `flat[start[k]:start[k] + size[k]]`."""

    def __init__(self, model: PieceModel) -> None:
        self.segment = segmenter(model)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = array("i"), array("q"), array("q")
        self.characters = 0

    def add(self, words: set[str]) -> None:
        for word in words:
            found = self.segment(word)
            self.number[word] = len(self.start)
            self.start.append(len(self.flat))
            self.size.append(len(found))
            self.flat.extend(found)
            self.characters += len(word) + len(found)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all of them one after the other."""
        of_text = [_MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        met = set().union(*of_text)
        if self.characters > TABLE_CHARACTERS:
            self.clear()
        self.add(met.difference(self.number))
        number = self.number
        at = np.array([number[w] for words in of_text for w in words], np.int64)
        flat, start, size = (np.array(x) for x in (self.flat, self.start, self.size))
        sizes = size[at] if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[at] - ends + sizes, sizes) + np.arange(total)] if total else np.empty(0, np.int32)
        words_before = np.cumsum([0, *map(len, of_text)])
        reached = np.concatenate([[0], ends])[words_before]
        if any(len(w) > LONG_WORD for w in met):
            self.clear()
        return np.diff(reached), ids


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, `n_tokens` and `ids` (array<int>), one row per input row.

    Ids equal those of the sentencepiece library for the model at `path`, without
    begin or end ids. Null and empty texts have none. A text of any length is encoded
    whole; a word of any length too, in time that grows with its length and the
    logarithm of it. Null and repeated ids are kept; other columns are not read, so their
    names cannot clash; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        table = WordTable(shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            n, ids = table.encode(texts)
            steps = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            return [pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(steps, pa.array(ids, pa.int32()))]

        return work

    return map_texts(docs, id_col, text_col, start, "n_tokens bigint, ids array<int>")


def decoder(model: PieceModel) -> Callable[[list[int]], str]:
    """Function from ids to text: the leading marker goes, bytes that form no character are each U+FFFD."""
    codecs.register_error("spanwise-bytes", lambda e: ("�" * (e.end - e.start), e.end))
    surface, marked = model.surface, model.marked

    def text(ids: list[int]) -> str:
        data = b"".join([surface[i] for i in ids])
        first = next((marked[i] for i in ids if marked[i] is not None), False)
        return (data[1:] if first else data).decode(errors="spanwise-bytes")

    return text


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add `out_col` (string): the text of the ids as the library decodes them, control ids left out.

    Null ids give null, no ids the empty text; an id that the model lacks is refused. A
    column named `out_col` is replaced, all others are kept.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = decoder(shared.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else text(x.tolist()))

    return encoded.withColumn(out_col, texts(named(ids_col)))

"""Operator 8. Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of pre-tokens come from arrays of code-point classes, not from a
regular expression. A small automaton reads the classes; what each character
does to its state is a function, functions compose associatively, and all that
can occur are numbered and their products tabled. A blocked scan over those
numbers gives the state after every character of many texts at once; a table of
(state before, state, state after) then says where a pre-token starts. Slices of
bytes between boundaries go to pair merging, whose results are cached. Offsets of
tokens are kept, so decoding can return any token's bytes and place.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.codepoints import LETTER, NUMBER, OTHER, SPACE, rank_classes
from spanwise.llm.common import map_texts

#: Entries of the cache of merged pieces in a task; a full cache starts anew.
CACHE_ENTRIES = 400_000
#: Bytes of text whose boundaries are found together; arrays over its characters take some fifty times as much.
ENCODED_BYTES = 500_000
#: Texts whose ids are unpacked together.
DECODED_TEXTS = 100
#: Pieces beyond this many bytes are merged with a heap and not cached.
LONG_PIECE = 64

# States after a character: which kind of pre-token it is in. A: an apostrophe that
# starts a pre-token; AR, AV, AL: r, v or l after it; C: the end of a contraction.
_START, _L, _N, _O, _SP, _WS, _A, _AR, _AV, _AL, _C = range(11)
_STATES = 11
# Symbols: classes of characters, letters of contractions apart, and the end of a text.
_SYM_L, _SYM_N, _SYM_O, _SYM_SP, _SYM_WS, _SYM_QUOTE, _SYM_ONE, _SYM_R, _SYM_V, _SYM_LL, _SYM_E, _SYM_END = range(12)
_BLOCK = 64


def _step(state: int, symbol: int) -> int:
    plain = {_SYM_N: _N, _SYM_O: _O, _SYM_SP: _SP, _SYM_WS: _WS, _SYM_END: _START}
    if symbol in plain:
        return plain[symbol]
    if symbol == _SYM_QUOTE:
        return _O if state in (_O, _A, _SP) else _A
    after = {
        (_A, _SYM_ONE): _C,
        (_A, _SYM_R): _AR,
        (_A, _SYM_V): _AV,
        (_A, _SYM_LL): _AL,
        (_AR, _SYM_E): _C,
        (_AV, _SYM_E): _C,
        (_AL, _SYM_LL): _C,
    }
    return after.get((state, symbol), _L)


def _starts(before: int, state: int, after: int) -> bool:
    """Whether a character begins a pre-token, by the states around it."""
    space = (_SP, _WS)
    if state == _START:
        return True  # the end of a text is a slice of its own
    if state in space:
        return before not in space or after not in (*space, _START)
    if before in (_START, _WS, _C):
        return True
    if before == _SP:
        return False
    if before == _A:
        if state in (_AR, _AV, _AL):
            return after != _C
        return state not in (_C, _O)
    kind = {_AR: _L, _AV: _L, _AL: _L, _C: _L}
    return kind.get(before, before) != kind.get(state, state)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, products of functions (first, then second), and values."""
    made = [tuple(_step(q, s) for q in range(_STATES)) for s in range(12)]
    number: dict[tuple[int, ...], int] = {}
    for f in [tuple(range(_STATES)), *made]:
        number.setdefault(f, len(number))
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in made:
            if (h := tuple(g[q] for q in f)) not in number:
                number[h] = len(number)
                todo.append(h)
    functions = list(number)
    product = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint16)
    return np.array([number[f] for f in made], np.uint16), product, np.array(functions, np.uint8)


_OF_SYMBOL, _PRODUCT, _VALUE = _monoid()
_BEGINS = np.array(
    [[[_starts(p, s, n) for n in range(_STATES)] for s in range(_STATES)] for p in range(_STATES)], bool
)


def symbol_table(classes: np.ndarray) -> np.ndarray:
    """Symbol of every code point; one more entry, for the end of a text."""
    table = np.empty(len(classes) + 1, np.uint8)
    of_class = {LETTER: _SYM_L, NUMBER: _SYM_N, OTHER: _SYM_O, SPACE: _SYM_WS}
    for kind, symbol in of_class.items():
        table[:-1][classes == kind] = symbol
    for text, symbol in ((" ", _SYM_SP), ("'", _SYM_QUOTE), ("stmd", _SYM_ONE), ("r", _SYM_R), ("v", _SYM_V), ("l", _SYM_LL), ("e", _SYM_E)):
        table[[ord(c) for c in text]] = symbol
    table[-1] = _SYM_END
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Prefix products: within blocks side by side, then over the blocks' totals, then both together."""
    n = len(functions)
    if n <= _BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = _PRODUCT[out[i - 1], out[i]]
        return out
    rows = -(-n // _BLOCK)
    grid = np.zeros((_BLOCK, rows), np.uint16)  # 0: the identity
    flat = np.zeros(rows * _BLOCK, np.uint16)
    flat[:n] = functions
    grid[:] = flat.reshape(rows, _BLOCK).T
    for j in range(1, _BLOCK):
        grid[j] = _PRODUCT[grid[j - 1], grid[j]]
    carried = scan(grid[-1])
    grid[:, 1:] = _PRODUCT[carried[:-1], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts; each end of a text is a position too."""
    states = _VALUE[scan(_OF_SYMBOL[symbols]), _START]
    before = np.concatenate([np.array([_START], np.uint8), states[:-1]])
    after = np.concatenate([states[1:], np.array([_START], np.uint8)])
    return np.flatnonzero(_BEGINS[before, states, after])


def pieces_of(texts: list[str], symbols: np.ndarray) -> Iterator[tuple[bytes, list[int]]]:
    """For each text its bytes and the byte offsets of its pre-tokens, with the text's length at the end."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = symbols[points]
    kinds[ends] = _SYM_END
    at = boundaries(kinds)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    data, places = joined.encode(), byte_at[at]
    first, begin = 0, 0
    for last, end in zip(np.searchsorted(at, ends).tolist(), byte_at[ends].tolist(), strict=True):
        yield data[begin:end], (places[first : last + 1] - begin).tolist()
        first, begin = last + 1, end + 1


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Parts of a piece after joining the lowest-ranked neighbours, the leftmost first, until none is ranked."""
    if piece in ranks:
        return [piece]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, len(ranks) + 1
    costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same with a heap of (rank, place) over linked parts."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (rank := ranks.get(piece[i : end[end[i]]])) is not None:
            heap.append((rank, i, end[end[i]]))

    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            size = len(heap)
            offer(k)
            if len(heap) > size:
                heapq.heappush(heap, heap.pop())
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, `n_tokens`, `ids` (array<int>) and `offsets` (array<int>: first byte of each token).

    One row per input row. Each pre-token is encoded by the ranks in the file at
    `path`, without special tokens. Null and empty texts have no tokens. Null and
    repeated ids are kept; other columns are not read; an empty table gives none.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((read_ranks(path), symbol_table(rank_classes())))

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        ranks, symbols = shared.value
        cache: dict[bytes, tuple[int, ...]] = {}
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for part, rank in ranks.items():
            lengths[rank] = len(part)

        def merged(piece: bytes) -> tuple[int, ...]:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            ids = tuple(map(ranks.__getitem__, merge_pairs(piece, ranks)))
            if len(piece) <= LONG_PIECE:
                cache[piece] = ids
            return ids

        def work(texts: list[str | None]) -> list[pa.Array]:
            ids: list[np.ndarray] = []
            places: list[np.ndarray] = []
            for data, at in pieces_of([t or "" for t in texts], symbols):
                pieces = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
                found = [cache.get(p) or merged(p) for p in pieces]
                of_text = np.fromiter(chain.from_iterable(found), np.int32)
                ids.append(of_text)
                ends = np.cumsum(lengths[of_text], dtype=np.int32)
                places.append(ends - lengths[of_text])
            n = np.array([len(x) for x in ids], np.int64)
            steps = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            empty = np.empty(0, np.int32)
            return [
                pa.array(n),
                pa.ListArray.from_arrays(steps, pa.array(np.concatenate([empty, *ids]))),
                pa.ListArray.from_arrays(steps, pa.array(np.concatenate([empty, *places]))),
            ]

        return work

    return map_texts(docs, id_col, text_col, start, "n_tokens bigint, ids array<int>, offsets array<int>", ENCODED_BYTES)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add `out_col` (binary): the bytes of the ids, those without an entry refused. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def text_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = {rank: piece for piece, rank in shared.value.items()}
        for batch in batches:
            few = (batch.slice(k, DECODED_TEXTS).to_pylist() for k in range(0, len(batch), DECODED_TEXTS))
            yield pa.array([None if x is None else b"".join(map(part.__getitem__, x)) for some in few for x in some], pa.binary())

    return encoded.withColumn(out_col, text_bytes(named(ids_col)))

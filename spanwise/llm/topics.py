"""Topics of documents, for operator 6: clusters of word profiles.

A profile counts the hashed words of a whole text. Clusters are fitted by spherical
k-means on all distinct texts: tasks sum the profiles next to each centre, and only the
centres and these sums reach the driver. Every document then gets the topic whose centre
its profile is nearest to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import store
from spanwise.llm.language_id import PIECE, pieces, words_of

#: Hashed words that a profile tells apart, and topics.
BUCKETS = 1_024
TOPICS = 12
ROUNDS = 25
#: A bucket and its number of words in a stored profile.
_CELL = np.dtype([("bucket", "<u2"), ("n", "<u4")])
#: Texts whose words a task counts together, or whose profiles are stored in one row and unpacked together.
COUNTED_TEXTS = 200
#: Texts compared with all centres together.
SCORED_TEXTS = 50
#: Texts farthest from the centres that the driver holds at once, to choose the next centres from.
FAR_TEXTS = 200
#: Parts of one in which components of profiles are summed: whole numbers add up to the same in any order.
PARTS_OF_ONE = 2**30


@dataclass(frozen=True)
class Topics:
    """What a bucket is worth, and the centres (topics by buckets)."""

    worth: np.ndarray
    centres: np.ndarray

    def of_profiles(self, rows: int, text: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> list[str | None]:
        """Topic of each of `rows` texts, given as `counted` does; none for texts without words."""
        value = _damped(n) * self.worth[bucket]
        scores = _scores(rows, text, bucket, value, self.centres)
        some = np.bincount(text, minlength=rows) > 0
        return [f"topic {k}" if any_ else None for k, any_ in zip(scores.argmax(1).tolist(), some.tolist(), strict=True)]


def _scores(rows: int, text: np.ndarray, bucket: np.ndarray, value: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Products of texts and centres. Those of a text are summed in the order of its buckets, whatever texts it is read with."""
    scores = np.zeros((rows, len(centres)))
    first = np.flatnonzero(np.diff(text, prepend=-1))
    worth = np.ascontiguousarray(centres.T)
    for k in range(0, len(first), SCORED_TEXTS):
        begin, end = first[k], first[k + SCORED_TEXTS] if k + SCORED_TEXTS < len(first) else len(text)
        at = first[k : k + SCORED_TEXTS]
        each = worth.take(bucket[begin:end], axis=0)
        each *= value[begin:end, None]
        scores[text[at]] = np.add.reduceat(each, at - begin, axis=0)
    return scores


def _damped(n: np.ndarray) -> np.ndarray:
    """Logarithm of 1 and a number of words; those of small numbers are computed once."""
    most = int(n.max(initial=0))
    return np.log1p(np.arange(most + 1))[n] if most < len(n) else np.log1p(n)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, number of words) of all texts; a long text is read in pieces."""
    cells: list[np.ndarray] = []
    waiting: list[str] = []
    of: list[int] = []
    size = 0

    def add() -> None:
        if waiting:
            words = words_of(waiting)
            cells.append(np.array(of, np.int64)[words.text] * BUCKETS + (words.key % np.uint64(BUCKETS)).astype(np.int64))
            waiting.clear()
            of.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            if size + len(piece) > PIECE:
                add()
                size = 0
            waiting.append(piece)
            of.append(i)
            size += len(piece)
    add()
    cell, n = np.unique(np.concatenate([np.empty(0, np.int64), *cells]), return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, n


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _cells(profiles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, number of words) of profiles; null ones have none."""
    profiles = profiles.cast(pa.large_binary())
    _, ends, data = profiles.buffers()
    ends = np.frombuffer(ends, np.int64)[profiles.offset : profiles.offset + len(profiles) + 1] if len(profiles) else np.zeros(1, np.int64)
    cells = np.frombuffer(data or b"", _CELL, (ends[-1] - ends[0]) // _CELL.itemsize, ends[0]) if ends[-1] > ends[0] else np.empty(0, _CELL)
    return np.repeat(np.arange(len(profiles)), np.diff(ends) // _CELL.itemsize), cells["bucket"].astype(np.int64), cells["n"].astype(np.int64)


def _packed(texts: list[str | None]) -> pa.Array:
    of, bucket, n = counted(texts)
    cells = np.empty(len(of), _CELL)
    cells["bucket"], cells["n"] = bucket, n
    ends = np.searchsorted(of, np.arange(len(texts) + 1)) * _CELL.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cells)]).cast(pa.binary())


def profile(text_col: str = "text") -> Column:
    """Profile of each text as a column: its buckets with the number of words in each, packed."""

    @F.arrow_udf("binary")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            blobs = [_packed(batch.slice(k, COUNTED_TEXTS).to_pylist()) for k in range(0, len(batch), COUNTED_TEXTS)]
            yield pa.concat_arrays(blobs) if blobs else pa.array([], pa.binary())

    return count(named(text_col).cast("string"))


def with_profiles(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """The documents with the profile of their text, stored: words are counted once for all that reads them."""
    return store(docs.withColumn(out_col, profile(text_col)), "profiles")


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS, profile_col: str | None = None) -> Topics | None:
    """Topics of all distinct texts, the same ones whenever it is run. None without any words.

    `profile_col` names a column of `docs` with the texts' profiles, where there is one.
    """
    counts = named(profile_col) if profile_col else profile(text_col)
    hashed = docs.select(F.xxhash64(named(text_col).cast("string")).alias("h"), counts.alias("p")).filter(F.length("p") > 0)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = hashed.groupBy("h").agg(F.first("p").alias("p")).repartition(parts, "h")
    gathered = store(distinct.mapInArrow(_gather, "h binary, ends binary, cells binary"), "distinct-profiles")

    def sums(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, present = 0, np.zeros(BUCKETS, np.int64)
        for _, profiles in _gathered(part):
            texts += len(profiles)
            present += np.bincount(_cells(profiles)[1], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BUCKETS), -1]), pa.array([*present.tolist(), texts])], names=["bucket", "n"])

    rows = gathered.mapInArrow(sums, "bucket long, n long").groupBy("bucket").sum("n").collect()  # BUCKETS rows and one
    present = dict(map(tuple, rows))
    texts = present.pop(-1, 0)
    if not texts:
        return None
    worth = np.log((texts + 1) / (np.array([present[k] for k in range(BUCKETS)]) + 1))

    centres = _far_apart(gathered, worth, min(topics, texts))
    before = None
    for _ in range(ROUNDS):
        found = _sums(gathered, worth, centres)
        if before is not None and np.array_equal(found, before):
            break
        before = found
        means = _unit(found[:, :BUCKETS].astype(float))
        centres = np.where(found[:, BUCKETS:] > 0, means, centres)
    return Topics(worth, centres)


def _units(batch: pa.Array, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, component) of profiles brought to length 1."""
    text, bucket, n = _cells(batch)
    value = _damped(n) * worth[bucket]
    length = np.sqrt(np.bincount(text, value * value, len(batch)))
    return text, bucket, value / np.maximum(length, 1e-12)[text]


def _few(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at once that what is unpacked of them stays small."""
    for batch in part:
        yield from (batch.slice(k, COUNTED_TEXTS) for k in range(0, batch.num_rows, COUNTED_TEXTS))


def _gather(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hash and profile to rows of some of them one after the other: Spark then hands on few rows, in each of many passes."""
    for batch in _few(part):
        profiles = batch.column(1).cast(pa.large_binary())
        _, ends, data = profiles.buffers()
        ends = np.frombuffer(ends, np.int64)[profiles.offset : profiles.offset + len(profiles) + 1]
        packed = batch.column(0).to_numpy().tobytes(), (ends - ends[0]).tobytes(), data.slice(ends[0], ends[-1] - ends[0]).to_pybytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["h", "ends", "cells"])


def _gathered(part: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Hashes and profiles, few at once, of rows that `_gather` made or of those it was given."""
    for batch in part:
        if "cells" not in batch.schema.names:
            yield from ((few.column("h").to_numpy(), few.column("p")) for few in _few(iter([batch])))
            continue
        for h, ends, cells in zip(*[batch.column(name) for name in ("h", "ends", "cells")], strict=True):
            hashes = np.frombuffer(h.as_buffer(), np.int64)
            yield hashes, pa.Array.from_buffers(pa.large_binary(), len(hashes), [None, ends.as_buffer(), cells.as_buffer()])


def _nearness(profiles: pa.Array, worth: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Product of each profile with its nearest centre."""
    if not len(centres):
        return np.zeros(len(profiles))
    return _scores(len(profiles), *_units(profiles, worth), centres).max(1)


def _far_apart(distinct: DataFrame, worth: np.ndarray, topics: int) -> np.ndarray:
    """As many centres as there are topics, each the text whose nearest centre so far is farthest.

    A further centre can only bring texts nearer. So one of the texts that were farthest is still the
    farthest one, as long as it is not nearer than the last of them was; else all texts are gone through again.
    """
    centres = np.empty((0, BUCKETS))
    held: list = []
    while len(centres) < topics:
        near = _nearness(pa.array([bytes(row.p) for row in held], pa.binary()), worth, centres)
        first = min(zip(near.tolist(), [row.h for row in held], range(len(held)), strict=True), default=None)
        if first is None or len(held) == FAR_TEXTS and first[:2] > (held[-1].near, held[-1].h):
            held = _farthest(distinct, worth, centres)
            first = (held[0].near, held[0].h, 0)
        _, bucket, n = _cells(pa.array([bytes(held[first[2]].p)], pa.binary()))
        far = np.zeros(BUCKETS)
        far[bucket] = np.log1p(n)
        far *= worth
        centres = np.concatenate([centres, far[None] / max(np.linalg.norm(far), 1e-12)])
    return centres


def _farthest(distinct: DataFrame, worth: np.ndarray, centres: np.ndarray) -> list:
    """The `FAR_TEXTS` profiles whose nearest centre is farthest, farthest first and those with smaller hashes among equals."""

    def far(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, near, p = np.empty(0, np.int64), np.empty(0), pa.array([], pa.large_binary())
        for hashes, profiles in _gathered(part):
            h, near = np.concatenate([h, hashes]), np.concatenate([near, _nearness(profiles, worth, centres)])
            k = np.lexsort([h, near])[:FAR_TEXTS]
            p = pa.concat_arrays([p, profiles.cast(pa.large_binary())]).take(pa.array(k))
            h, near = h[k], near[k]
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(h), p.cast(pa.binary())], names=["near", "h", "p"])

    return distinct.mapInArrow(far, "near double, h long, p binary").orderBy("near", "h").limit(FAR_TEXTS).collect()


def _sums(gathered: DataFrame, worth: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each centre the sum of the profiles next to it, in parts of one, and their number."""
    width = BUCKETS + 1

    def add(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres) * width, np.int64)
        for _, profiles in _gathered(part):
            text, bucket, value = _units(profiles, worth)
            of = _scores(len(profiles), text, bucket, value, centres).argmax(1)
            # Sums of whole numbers below 2**53 are exact.
            total += np.bincount(of[text] * width + bucket, np.rint(value * PARTS_OF_ONE), len(total)).astype(np.int64)
            total += np.bincount(of * width + BUCKETS, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    found = np.zeros(len(centres) * width, np.int64)
    for cell, n in gathered.mapInArrow(add, "cell long, n long").groupBy("cell").sum("n").collect():  # topics times buckets
        found[cell] = n
    return found.reshape(len(centres), width)


def topic(fitted: Topics | None, text_col: str = "text", profile_col: str | None = None) -> Column:
    """The topic of each text as a column; null for texts without words, and for all without fitted topics.

    `profile_col` names a column with the texts' profiles, where there is one.
    """
    if fitted is None:
        return F.lit(None).cast("string")

    @F.arrow_udf("string")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            few = [batch.slice(k, COUNTED_TEXTS) for k in range(0, len(batch), COUNTED_TEXTS)]
            yield pa.array([name for some in few for name in fitted.of_profiles(len(some), *_cells(some))], pa.string())

    return nearest(named(profile_col) if profile_col else profile(text_col))

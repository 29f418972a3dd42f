"""Operator 4. Quality by perplexity under an interpolated modified Kneser-Ney model.

The model reads characters. Every n-gram of all trusted text is counted, first in
tasks and then over hash shards; continuation counts, discounts and back-off weights
are aggregations of that table, which grows with the trusted text and never leaves
the executors. Texts are stored once, packed in large slices. A slice asks for each
n-gram it holds once, of all lengths, by 64-bit keys packed by shard; each shard of the
model meets what is asked of it and answers with what it knows, packed by slice.
Slices are stored in buckets, so the answers come to them and they stay where they are.
A document is kept when its perplexity is at most a quantile of the trusted documents
in its language.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import fold_remainder, fresh, key_bits, store, text_slices, with_named
from spanwise.sources.tables import Steps

#: Characters of an n-gram.
ORDER = 5
#: One trusted document in so many sets the thresholds; the model is trained on the others, which it therefore favours.
FOLDS = 3
#: Quantile of the perplexity of trusted documents that others may reach.
QUANTILE = 0.98
#: Bytes of text in a slice; it is worked on in parts of `common.SLICE_BYTES`. Larger slices share more of their n-grams,
#: smaller ones need less memory for them. Input in smaller partitions is read so that slices have `LEAST_SLICE`.
SLICE_BYTES = 64_000_000
LEAST_SLICE = 16_000_000
#: Entries of the model in a shard, and slices whose questions meet it at a time.
SHARD_ENTRIES = 250_000
SLICES_AT_A_TIME = 64
#: Distinct n-grams that a counting task holds before it hands them on.
HELD_GRAMS = 1_000_000
#: Parts that a language's rows are spread over when they meet its threshold.
SPREAD = 64

_EDGE = 2  # a control character, which texts cannot hold once folded
_POINTS = 0x110000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def fold_table() -> np.ndarray:
    """Symbol of every code point: digits are one, blanks and control characters are one, others stay."""
    table = np.arange(_POINTS, dtype=np.uint32)
    for point in range(_POINTS):
        c = chr(point)
        if point <= 32 or c.isspace():
            table[point] = 32
        elif c.isdigit():
            table[point] = ord("0")
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points with `ORDER` - 1 edges before each text, the end of each n-gram in them, and the lengths."""
    edge = "\0" * (ORDER - 1)
    points = fold_table()[np.frombuffer(edge.join(["", *texts]).encode("utf-32-le"), np.uint32)]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    inside = np.ones(len(points), bool)
    for k in range(1, ORDER):
        points[starts - k] = _EDGE
        inside[starts - k] = False
    return points, np.flatnonzero(inside), lengths


def keys(points: np.ndarray, ends: np.ndarray, size: int = ORDER) -> np.ndarray:
    """64-bit hashes of the n-grams of a size that end at `ends`."""
    key = np.full(len(ends), size * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    for k in range(size - 1, -1, -1):
        key = (key ^ points[ends - k].astype(np.uint64)) * _MULTIPLIER
        key ^= key >> np.uint64(29)
    return key


class _Numbered:
    """Code points with the distinct ones numbered, so that short n-grams are numbers too."""

    def __init__(self, points: np.ndarray) -> None:
        held = np.zeros(_POINTS, bool)
        held[points] = True
        number = np.cumsum(held)
        self.points, self.kinds, self.number = points, int(number[-1]), (number[points] - 1).astype(np.uint64)

    def grouped(self, ends: np.ndarray, size: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """An order of `ends` in which those of equal n-grams of a size are neighbours, and where in it each n-gram begins.

        Where both fit into 64 bits, an n-gram's number and its place are sorted as one: that is faster than to sort places by hashes.
        """
        bits = len(ends).bit_length()
        if self.kinds**size << bits < 2**64:
            gram = np.zeros(len(ends), np.uint64)
            for k in range(size - 1, -1, -1):
                gram = gram * np.uint64(self.kinds) + self.number[ends - k]
            both = np.sort(gram << np.uint64(bits) | np.arange(len(ends), dtype=np.uint64))
            gram, order = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            gram = keys(self.points, ends, size)
            order = np.argsort(gram)
            gram = gram[order]
        return order, np.flatnonzero(_new(gram))

    def looked_up(self, ends: np.ndarray, size: int, known: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
        """Value of the n-gram of a size that ends at each of `ends`; each n-gram is looked up once."""
        order, first = self.grouped(ends, size)
        value, _ = _looked_up(keys(self.points, ends[order[first]], size), known, values, other)
        out = np.empty(len(ends))
        out[order] = np.repeat(value, np.diff(first, append=len(ends)))
        return out


def _new(x: np.ndarray) -> np.ndarray:
    """Which of sorted numbers differ from the one before."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def _once(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, in order."""
    x = np.sort(x)
    return x[_new(x)]


def grams(points: np.ndarray, ends: np.ndarray) -> list[str]:
    """The n-grams that end at `ends`, as text."""
    rows = np.stack([points[ends - k] for k in range(ORDER - 1, -1, -1)], 1)
    joined = np.ascontiguousarray(rows, np.uint32).tobytes().decode("utf-32-le")
    return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]


def _pack(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, parts[0].schema, options=options) as writer:
        for part in parts:
            writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def _parts(data: pa.Scalar) -> Iterator[pa.RecordBatch]:
    """Parts of a packed slice, unpacked one at a time."""
    with pa.ipc.open_stream(data.as_buffer()) as reader:
        yield from reader


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(0).to_pylist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`slice`, `data`: the rows of a slice are neighbours in one task, whole texts, packed."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(held)], pa.binary())], names=["slice", "data"])

    for part in text_slices(batches, 0):
        if held and size + part.nbytes > SLICE_BYTES:
            yield full()
            number, held, size = number + 1, [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield full()


def _distinct(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Counts and texts of the n-grams."""
    points, ends, _ = symbols(texts)
    order, first = _Numbered(points).grouped(ends)
    return np.diff(first, append=len(order)), grams(points, ends[order[first]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`gram`, `n`: counts of a task, summed over parts of its texts as far as memory allows."""
    held: Counter[str] = Counter()

    def summed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    for part in text_slices(batches, 0):
        n, found = _distinct(_texts(part))
        for gram, times in zip(found, n.tolist(), strict=True):
            held[gram] += times
        if len(held) > HELD_GRAMS:
            yield summed()
            held.clear()
    yield summed()


def _all_keys(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at `ends`, of all shorter ones that end them, and of the contexts of all of these."""
    found, numbered = [], _Numbered(points)
    for size in range(ORDER, 0, -1):
        order, first = numbered.grouped(ends, size)
        ends = ends[order[first]]
        found.append(keys(points, ends, size))
        ends = np.concatenate([ends, ends - 1])
    return _once(np.concatenate(found))


def _asker(shards: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`shard`, `group`, `slice`, `keys`: what each slice asks of each shard, once each; slices are dealt to groups."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0), batch.column(1), strict=True):
                seen = np.zeros(0, np.uint64)
                for part in _parts(data):
                    points, ends, _ = symbols(_texts(part))
                    seen = _once(np.concatenate([seen, _all_keys(points, ends)]))
                shard = seen.view(np.int64) % shards
                order = np.argsort(shard, kind="stable")  # keys stay in order within a shard
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                packed = [seen[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                slice_ = number.as_py()
                group = (slice_ + (slice_ >> 32)) % groups
                columns = [pa.array(np.arange(shards)), *[pa.array(np.full(shards, x)) for x in (group, slice_)], pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "group", "slice", "keys"])

    return asked


@dataclass(frozen=True)
class QualityModel:
    """What is known of n-grams, and the probability of a character whatever it is and what the empty context spares.

    `entries` has rows `key` with `own`, an n-gram's discounted share of its context, or
    `spare`, what was taken off the n-grams of a context; the other of the two is null. `size` is about their number.
    """

    entries: DataFrame
    floor: float
    spare: float
    size: int


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """What is taken off counts of 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4.

    The estimate of Chen and Goodman, kept within a tenth and nine tenths of the count.
    """
    y = ones / (ones + 2 * twos) if ones and twos else 0.5
    steps = ((1, ones, twos), (2, twos, threes), (3, threes, fours))
    return [min(max(k - (k + 1) * y * after / now, 0.1 * k), 0.9 * k) if now else 0.5 * k for k, now, after in steps]


def _keyed(rows: DataFrame, size: int) -> DataFrame:
    """`key`, `own`, `spare` of rows (`gram` of `size` characters, `own`, `spare`)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
            found = keys(points, np.arange(size - 1, len(points), size), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1), batch.column(2)], names=["key", "own", "spare"])

    return rows.select("gram", "own", "spare").mapInArrow(keyed, "key long, own double, spare double")


def _level(counts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """N-grams with `own` and contexts with `spare`, as rows `gram`, `own`, `spare`."""
    n = F.col("n")
    found = counts.agg(*[F.count(F.when(n == k, 1)) for k in (1, 2, 3, 4)]).first()
    one, two, more = discounts(*found)
    cut = F.when(n == 1, one).when(n == 2, two).otherwise(more)
    context = F.substring("gram", 1, size - 1)
    contexts = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
    none = F.lit(None).cast("double")
    shares = counts.select("gram", context.alias("context"), (n - cut).alias("rest")).join(contexts, "context")
    shares = shares.select("gram", (F.col("rest") / F.col("total")).alias("own"), none.alias("spare"))
    return shares, contexts.select(F.col("context").alias("gram"), none.alias("own"), (F.col("cut") / F.col("total")).alias("spare"))


def fit_quality(counts: DataFrame) -> QualityModel:
    """Model from `gram` (of `ORDER` characters) and `n`, one row per n-gram. Without any, all characters are alike."""
    entries, at, spare, held = [], counts, 1.0, 0
    for size in range(ORDER, 0, -1):
        held += 2 * at.count()
        shares, contexts = _level(at, size)
        entries.append(_keyed(shares, size))
        if size > 1:  # lower levels count the distinct characters before
            entries.append(_keyed(contexts, size - 1))
            at = store(at.groupBy(F.substring("gram", 2, size - 1).alias("gram")).agg(F.count("*").alias("n")), "quality-level")
        elif (row := contexts.first()) is not None:
            spare = row.spare
    return QualityModel(reduce(DataFrame.unionAll, entries), 1.0 / (at.count() + 1), spare, held)


def _known(keys_: np.ndarray, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and values of the rows that have one."""
    values = column.to_numpy()
    some = np.flatnonzero(~np.isnan(values))
    some = some[np.argsort(keys_[some])]
    return keys_[some], values[some]


def _looked_up(asked: np.ndarray, known: np.ndarray, values: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key, `other` where it is not known, and which are known."""
    if not len(known):
        return np.full(len(asked), other), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    hit = known[at] == asked
    return np.where(hit, values[at], other), hit


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """`slice`, `found`: of the keys that each slice asks a shard for, those it knows, their own shares and what they spare."""
    entries = model.column("key").to_numpy().view(np.uint64)
    own, spare = _known(entries, model.column("own")), _known(entries, model.column("spare"))
    packed = []
    for data in asked.column("keys"):
        wanted = np.frombuffer(data.as_buffer(), np.uint64)
        (share, has), (left, is_context) = _looked_up(wanted, *own, 0.0), _looked_up(wanted, *spare, 1.0)
        some = has | is_context
        packed.append(b"".join([wanted[some].tobytes(), share[some].tobytes(), left[some].tobytes()]))
    return pa.table({"slice": asked.column("slice"), "found": pa.array(packed, pa.binary())})


def _scorer(floor: float, empty: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Perplexity of each row of one slice from the answers of all shards."""

    def scored(slices: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for x in answers.column("found")]
        known, share, left = np.concatenate([np.empty((3, 0), np.uint64), *parts], axis=1)
        order = np.argsort(known)
        known, share, left = known[order], share[order].view(np.float64), left[order].view(np.float64)
        done = []
        for data in slices.column("data"):
            for part in _parts(data):
                points, ends, lengths = symbols(_texts(part))
                numbered = _Numbered(points)
                order, first = numbered.grouped(ends)
                at = ends[order[first]]
                p = np.full(len(at), floor)
                for size in range(1, ORDER + 1):
                    own = numbered.looked_up(at, size, known, share, 0.0)
                    spare = empty if size == 1 else numbered.looked_up(at - 1, size - 1, known, left, 1.0)
                    p = own + spare * p
                logs, after = np.empty(len(ends)), np.cumsum(lengths)
                logs[order] = np.repeat(np.log(p), np.diff(first, append=len(ends)))
                total = np.array([logs[a:b].sum() for a, b in zip(after - lengths, after, strict=True)])
                value = np.exp(-total / np.maximum(lengths, 1))
                done.append(pa.table({
                    "id": part.column(1), "lang": part.column(2),
                    "n_chars_scored": pa.array(lengths), "perplexity": pa.array(value, pa.float64(), mask=lengths == 0),
                }))
        return pa.concat_tables(done)

    return scored


def perplexities(source: DataFrame, model: QualityModel, kept: Steps) -> DataFrame:
    """Columns `id`, `lang`, `n_chars_scored`, `perplexity` per character (null without characters), a row per row of `source`.

    `source` has `text`, `id`, `lang`. Slices are kept in `kept`, which must not be closed before the result has been stored.
    """
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // LEAST_SLICE + 1
    name = f"{kept.database}.slices"
    cut = source.coalesce(parts).mapInArrow(_cut, "slice long, data binary")
    cut.write.bucketBy(kept.buckets, "slice").saveAsTable(name)
    slices = source.sparkSession.table(name)
    shards, groups = model.size // SHARD_ENTRIES + 1, parts // SLICES_AT_A_TIME + 1
    asked = slices.mapInArrow(_asker(shards, groups), "shard long, group long, slice long, keys binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    entries = model.entries.select("key", "own", "spare", F.pmod("key", F.lit(shards)).alias("shard"), every)
    both = ["shard", "group"]
    answers = asked.groupBy(*both).cogroup(entries.groupBy(*both)).applyInArrow(_answered, "slice long, found binary")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"id {kinds['id']}, lang {kinds['lang']}, n_chars_scored long, perplexity double"
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scorer(model.floor, model.spare), schema)


def classify_quality(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
) -> DataFrame:
    """Columns id, `lang`, `perplexity`, `threshold`, `good`, one row per input row.

    Trusted are documents whose id is in `trusted_ids` (one column, the id). One in
    `FOLDS`, by crc32 of the id, sets the thresholds and the model is trained on the
    others: a language's threshold is the `quantile` of perplexity in that part (within
    one part in 10,000 of the rank). Languages without such documents, and null, use
    that of all languages, and if there are none at all that of the others. Texts without characters have null perplexity and are not
    good. Null ids are never trusted; repeated rows are scored alike. Other columns are
    not read. Writes counts and scores to the shared folder, and texts in slices, which are
    removed when all are scored.
    """
    name = fresh(docs, "trusted_id")
    ids = trusted_ids.select(named(trusted_ids.columns[0]).alias(name)).dropna().distinct()
    source = docs.select(named(text_col).cast("string").alias("text"), named(id_col).alias("id"), named(lang_col).alias("lang"))
    is_mark = fold_remainder("id", FOLDS) == 0
    learned = ids.filter(fold_remainder(name, FOLDS) != 0)
    # Texts that cannot be trusted are not moved to find out.
    bits = key_bits(learned.select(F.xxhash64(named(name).cast("string")).alias("key")), "key")
    may = with_named(source, F.xxhash64(F.col("id").cast("string")), bits, "may").filter("may")
    trusted = may.join(learned, F.col("id") == F.col(name), "left_semi")
    found = trusted.select("text").mapInArrow(_counted, "gram string, n long")
    counts = store(found.groupBy("gram").agg(F.sum("n").alias("n")), "quality-counts")
    with Steps(docs.sparkSession) as kept:
        scored = store(perplexities(source, fit_quality(counts), kept), "quality-scores")
    marks = scored.join(ids, F.col("id") == F.col(name), "left_semi").filter("perplexity IS NOT NULL")
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    overall = {r.mark: r.threshold for r in marks.groupBy(is_mark.alias("mark")).agg(at).collect()}
    of_all = overall.get(True, overall.get(False))
    marks = marks.filter(is_mark)
    # A language may hold most rows: its rows are spread, and its threshold is repeated for each part.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>")).alias("part")
    of_lang = marks.filter("lang IS NOT NULL").groupBy("lang").agg(at).select("lang", "threshold", parts)
    spread = scored.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    out = spread.join(of_lang, ["lang", "part"], "left")
    limit = F.coalesce("threshold", F.lit(of_all).cast("double"))
    return out.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", limit.alias("threshold"),
        F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("good"),
    )

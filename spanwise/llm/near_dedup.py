"""Operator 5. Near-duplicate documents by min-max hashing, with exact confirmation.

Each permutation of a document's shingles gives two values, its minimum and its
maximum, so a signature needs half the evaluations. Values are cut into bands; a
band shared by two texts makes them candidates, and a candidate counts only when
the full sets are alike enough.

Copies are folded first: texts with equal sets are one class. Within a bucket no
pairs are formed at first. Every class is compared with one representative of the
bucket it shares most bands with; what is confirmed joins a component, and further
rounds name other representatives for buckets that still hold several components.
Every other round names those that meet most others, the originals of many copies.
Once a round joins nothing more, classes of different components that share a bucket
are compared: by size and by a short sketch of the whole signature within the join,
so that a pair leaves it only if the signatures agree about as often as those of
linked texts do, and then by the full sets. Classes already connected need no further link.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import fresh, map_texts, store
from spanwise.operators.skew import PARTS, hot_keys, in_blocks, salted

#: Words of a shingle and the similarity (in hundredths) from which documents are linked.
SHINGLE_WORDS = 5
SIMILARITY = 75
#: A pair at the similarity itself shares no band with probability (1 - 0.75**5)**48, about 2 in a million.
BANDS = 48
BAND_ROWS = 5
#: Rounds of comparing with representatives before the last one.
STAR_ROUNDS = 4
#: Bits of each signature value in a sketch, and how many standard deviations fewer agreements
#: than a pair at the similarity itself has on average still pass: one in three million of those is missed.
SKETCH_BITS = 4
SKETCH_MARGIN = 5.0
#: Rows of a bucket, and pairs of one class, from which they are spread over tasks.
SPREAD_ROWS = 8_192

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingler(size: int = SHINGLE_WORDS) -> Callable[[str | None], np.ndarray]:
    """Function from a text to the sorted hashes of its distinct shingles.

    Words are runs without ASCII white space, A-Z in lower case; fewer than `size`
    words are one shingle, none at all give the empty set.
    """
    import xxhash

    digest, known = xxhash.xxh3_64_intdigest, {}
    factor = np.uint64(0x9E3779B97F4A7C15)

    def hashed(word: bytes) -> int:
        if len(known) > 500_000:
            known.clear()
        known[word] = number = digest(word)
        return number

    def shingles(text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        get = known.get
        numbers = np.array([get(w) or hashed(w) for w in words], np.uint64)
        if len(words) < size:
            total = np.uint64(len(words))
            for number in numbers:
                total = _mixed(np.array([total]) * factor + number)[0]
            return np.array([total])
        n = len(words) - size + 1
        total = numbers[:n].copy()
        for k in range(1, size):
            total = _mixed(total * factor + numbers[k : k + n])
        return np.unique(total)

    return shingles


def signer(bands: int = BANDS, rows: int = BAND_ROWS) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Function from a set to the hashes of its bands, half of which hold minima and half maxima, and its sketch.

    The sketch holds `SKETCH_BITS` bits of each value, 16 values in a number.
    """
    evaluations = bands * rows // 2
    state = np.random.Generator(np.random.PCG64(20240501))
    factors = state.integers(0, 2**63, evaluations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = state.integers(0, 2**63, evaluations, dtype=np.uint64)
    place = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    shift = np.arange(16, dtype=np.uint64) * np.uint64(SKETCH_BITS)

    def sign(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(evaluations, np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(evaluations, np.uint64)
        for start in range(0, len(members), 256):
            values = members[start : start + 256, None] * factors + shifts
            np.minimum(low, values.min(0), out=low)
            np.maximum(high, values.max(0), out=high)
        values = np.concatenate([low, high])
        parts = values.reshape(bands, rows)
        total = place.copy()
        for k in range(rows):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
        bits = np.zeros(-(-len(values) // 16) * 16, np.uint64)
        bits[: len(values)] = _mixed(values) & np.uint64((1 << SKETCH_BITS) - 1)
        return total, np.bitwise_or.reduce(bits.reshape(-1, 16) << shift, axis=1)

    return sign


def _lists(parts: list[np.ndarray]) -> pa.Array:
    steps = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    values = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(steps, pa.int32()), pa.array(values))


def _set_key(members: np.ndarray) -> int:
    import xxhash

    key = xxhash.xxh3_64_intdigest(members.tobytes())
    return key - 2**64 if key >= 2**63 else key


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, `n_shingles`, `node` (hash of the whole set), `bands`, `sketch`."""
    none = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        shingles, sign = shingler(words), signer(bands, rows)

        def work(texts: list[str | None]) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            signed = [sign(s) if len(s) else none for s in sets]
            sizes, keys = [len(s) for s in sets], [_set_key(s) for s in sets]
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(_lists([x[i] for x in signed]) for i in (0, 1))]

        return work

    return map_texts(docs, id_col, text_col, start, "n_shingles bigint, node bigint, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """`node` and `members` of documents given as (`id`, `text`)."""

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        shingles = shingler(words)

        def work(texts: list[str | None]) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            return [pa.array([_set_key(s) for s in sets], pa.int64()), _lists(sets)]

        return work

    made = map_texts(docs, "id", "text", start, "node bigint, members array<bigint>")
    return made.groupBy("node").agg(F.first("members").alias("members"))


def _fits(a: str, b: str, similarity: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (`a`, `b`) whose full sets are alike enough. A class in very many pairs is spread over tasks."""
    both = pairs
    for end in ("a", "b"):
        members = sets.withColumnsRenamed({"node": end, "members": f"m{end}"})
        left, right, salt = salted(both, members, [end], hot_keys(pairs, [end], SPREAD_ROWS))
        both = left.join(right, [end, *salt]).drop(*salt)
    shared = F.size(F.array_intersect("ma", "mb"))
    return both.filter(100 * shared >= similarity * (F.size("ma") + F.size("mb") - shared)).select("a", "b")


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """`node` and `comp`, the smallest node reachable over `edges` (`a`, `b`); nodes without edges are left out.

    Rounds of two steps: every node hands its neighbours the smallest of them, first
    to larger ones, then to smaller ones. Links stay as many as nodes, and rounds grow
    with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = store(links, label)
    previous = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.low").alias("b")).filter("a <> b").distinct()
        links = store(small, label)
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == previous:
            break
        previous = now
    tree = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return tree.unionAll(tree.select(F.col("comp").alias("node"), "comp").distinct())


def _joined(known: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Components after further edges between nodes; None if none of them is new."""
    if known is not None:
        comp = known.select(F.col("node").alias("n"), "comp")
        for end in ("a", "b"):
            edges = edges.join(comp, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("comp", end)).drop("n", "comp")
    links = store(edges.filter("a <> b").distinct(), "edges")
    if links.isEmpty():
        return None
    merged = components(links)
    if known is None:
        return store(merged, "components")
    merged = merged.withColumnsRenamed({"node": "n", "comp": "c"})
    moved = known.join(merged, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("c", "comp").alias("comp"))
    fresh = merged.join(known, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("c").alias("comp"))
    return store(moved.unionAll(fresh), "components")


def _open_buckets(buckets: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows (`bucket`, `node`, `n`, `comp`) of buckets that hold several components."""
    if known is None:
        return buckets.select("bucket", "node", "n", F.col("node").alias("comp"))
    held = buckets.join(known, "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
    open_ = held.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    return held.join(open_.select("bucket"), "bucket")


def _star_pairs(buckets: DataFrame, round_: int, similarity: int) -> DataFrame:
    """Each class with the representative it shares most buckets with, if of another component and of fitting size.

    In every other round they are the classes that meet most others in all their buckets: the text that
    many copies were made from is closer to each of them than they are to each other. In
    the rounds between, and among equals, the smallest hash decides, which differs by round.
    """
    order = F.xxhash64(F.lit(round_), "node")
    ranked = buckets.withColumn("reach", F.lit(0).cast("long"))
    if round_ % 2 == 0:
        size = buckets.groupBy("bucket").agg(F.count("*").alias("size"))
        reach = buckets.join(size, "bucket").groupBy("node").agg(F.sum("size").alias("reach"))
        ranked = buckets.join(reach, "node")
    head = ranked.groupBy("bucket").agg(F.min(F.struct((-F.col("reach")).alias("r"), order.alias("o"), "node", "comp", "n")).alias("head"))
    met = buckets.join(head, "bucket").filter((F.col("comp") != F.col("head.comp")) & _fits("n", "head.n", similarity))
    met = met.groupBy("node", F.col("head.node").alias("other")).count()
    best = met.groupBy("node").agg(F.max(F.struct("count", "other")).alias("best"))
    other = F.col("best.other")
    return best.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()


def _agreements(a: str, b: str, words: int) -> Column:
    """Number of values that two sketches have in common, those that fill up the last number included."""
    differ = F.lit(0)
    for k in range(words):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        any_bit = x
        for bit in range(1, SKETCH_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, bit))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return 16 * words - differ


def least_agreements(values: int, similarity: int) -> int:
    """Agreements that a pair at the similarity has nearly always, with those that fill up the last number."""
    chance = 0.5**SKETCH_BITS
    p = similarity / 100 + (1 - similarity / 100) * chance
    return math.floor(values * p - SKETCH_MARGIN * math.sqrt(values * p * (1 - p))) + -values % 16


def _cross_pairs(buckets: DataFrame, sketches: DataFrame, values: int, similarity: int) -> DataFrame:
    """Pairs of classes in different components that share a bucket and may be alike enough by size and sketch.

    Both tests are part of the join, so what does not pass is never a row. The rows of a
    common bucket are cut into parts that meet each other in tasks of their own.
    """
    left = buckets.join(sketches, "node")
    right = left.withColumnsRenamed({"node": "node2", "n": "n2", "comp": "comp2", "sketch": "sketch2"})
    ours, theirs = in_blocks(left, right, ["bucket"], SPREAD_ROWS)
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("bucket", *PARTS)]
    alike = _agreements("sketch", "sketch2", -(-values // 16)) >= least_agreements(values, similarity)
    met = ours.alias("l").join(theirs.alias("r"), [*same, F.col("comp") < F.col("comp2"), _fits("n", "n2", similarity), alike])
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """Columns id, `n_shingles`, `component_id` and `kept` (the id is the component's), one row per input row.

    `component_id` is the smallest id reachable over links; documents are linked when
    100 * shared shingles >= `similarity` * all shingles. Texts that are null, empty or
    without words have no shingles and are linked with nothing. Ids must be whole
    numbers; rows with a null id are returned with null component and kept true, and
    take no part. Rows that share an id are linked by their own texts. Writes
    intermediate tables to the shared folder; other columns are not read.
    """
    signed = store(_signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    signed = signed.withColumn("id", named(id_col).cast("long"))
    useful = signed.filter("id IS NOT NULL AND n_shingles > 0")
    one = [F.first(c).alias(c) for c in ("bands", "sketch")]
    classes = useful.groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").cast("int").alias("n"), *one)
    classes = store(classes, "classes")
    rows_ = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows_.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1").select("bucket")
    buckets = store(rows_.join(shared, "bucket").select("bucket", "node", "n"), "buckets")

    involved = classes.select("node", "id").join(buckets.select("node").distinct(), "node").select("id").distinct()
    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    sets = store(_sets(texts.join(involved, "id"), words), "sets")

    known = None
    for round_ in range(STAR_ROUNDS):
        open_ = store(_open_buckets(buckets, known), "open")
        pairs = store(_star_pairs(open_, round_, similarity), "pairs")
        merged = _joined(known, _confirmed(pairs, sets, similarity))
        if merged is None:
            break
        known = merged
    open_ = store(_open_buckets(buckets, known), "open")
    pairs = store(_cross_pairs(open_, classes.select("node", "sketch"), bands * rows, similarity), "pairs")
    last = _joined(known, _confirmed(pairs, sets, similarity))
    known = last or known
    of_class = classes.select("node", "id", F.col("node").alias("comp"))
    if known is not None:
        of_class = classes.select("node", "id").join(known, "node", "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    of_comp = of_class.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = of_class.select("node", "comp").join(of_comp, "comp").select("node", "component_id")
    member = signed.join(of_class, "node", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return member.select(
        named(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The documents that stand for their component, with all their columns.

    Rows are told apart by their id: rows with the id of a kept document stay with it. Null ids stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    name = fresh(docs, "gone")
    gone = found.filter(~F.col("kept")).select(named(id_col).alias(name))
    kept = found.filter("kept").select(named(id_col).alias("kept"))
    gone = gone.join(kept, F.col(name) == F.col("kept"), "left_anti").distinct()
    return docs.join(gone, named(id_col) == F.col(name), "left_anti")

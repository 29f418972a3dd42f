"""Operator 11. Hard negatives by a vertical scan of components (BOND).

Rows are dealt to segments, in which vectors are held by component. An anchor reads
the components in the order of its own largest magnitudes. After every few of them
each row has a partial score, and the smallest and greatest value of the components
still to come bound what they can add. Rows that cannot be among the wanted ones
leave the bitmap of candidates. For positives that is when the greatest possible
score is below the k-th best certain one; for negatives when no window of scores can
hold the row, or a window has enough certain rows that are better. What is left is
scored in full, and the best of all segments are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwise.functions.columns import named
from spanwise.llm.common import store

#: Rows of a segment and anchors that meet it at a time; the two bound the memory of a task.
SEGMENT_ROWS = 65_536
ANCHOR_BLOCK = 16_384
#: Segments that a smaller table is cut into, for the sake of parallel tasks, and rows of such a segment at least.
SPREAD, SPREAD_ROWS = 64, 4_096
#: Components read between two looks at the bounds.
STEP = 8
#: Scores up to this size are exact in the arithmetic of a segment.
_EXACT = 2.0**53


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; minus infinity where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class Segment:
    """Vectors of a block of rows by component, rows of a label side by side."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.labels, self.rows, self.ids = labels[order], rows[order], ids[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.places: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.read = 0

    def of_label(self, label: str, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rows with that label, or with any other, and their smallest and greatest components."""
        key = (label, same)
        if key not in self.places:
            at = np.flatnonzero((self.labels == label) == same)
            edge = self.columns[:, at] if len(at) else np.zeros((len(self.columns), 1))
            self.places[key] = at, edge.min(1), edge.max(1)
        return self.places[key]

    def _scan(
        self, anchor: np.ndarray, among: np.ndarray, low: np.ndarray, high: np.ndarray, keep: Callable
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows that `keep(least possible scores, greatest possible scores)` never rejects."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        products = np.stack([anchor * low, anchor * high])[:, order]
        if np.abs(products).max(0).sum() >= _EXACT:
            raise ValueError("inner products beyond 2**53 are not exact")
        least, greatest = (np.append(np.cumsum(x[::-1])[::-1], 0.0) for x in (products.min(0), products.max(0)))
        partial = np.zeros(len(among))
        for k in range(0, len(order), STEP):
            part = order[k : k + STEP]
            self.read += len(part) * len(among)
            partial = partial + anchor[part] @ self.columns[np.ix_(part, among)]
            done = k + len(part)
            alive = keep(partial + least[done], partial + greatest[done])
            among, partial = among[alive], partial[alive]
        return among, partial

    def _first(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.ids[places], -scores))[:k]
        return places[first], scores[first]

    def best(self, anchor: np.ndarray, row: int, label: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows of the label other than `row`, ties to smaller ids."""
        among, low, high = self.of_label(label, True)
        among = among[self.rows[among] != row]
        return self._first(*self._scan(anchor, among, low, high, lambda least, greatest: greatest >= _kth(least, k)), k)

    def within(
        self, anchor: np.ndarray, label: str, windows: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score): places and scores of its k best rows of other labels."""

        def keep(least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
            wanted = np.zeros(len(least), bool)
            for bottom, top in windows:
                certain = least[(least >= bottom) & (greatest <= top)]
                wanted |= (greatest >= max(bottom, _kth(certain, k))) & (least <= top)
            return wanted

        places, scores = self._scan(anchor, *self.of_label(label, False), keep)
        inside = [(scores >= bottom) & (scores <= top) for bottom, top in windows]
        return [self._first(places[x], scores[x], k) for x in inside]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _segment(table: pa.Table) -> Segment:
    labels, rows, ids = (table.column(c).to_numpy() for c in ("label", "row", "id"))
    return Segment(_matrix(table.column("v")), labels.astype(str), rows, ids)


def _dealt(rows: DataFrame, anchors: DataFrame, segments: int, blocks: int) -> tuple:
    """Both sides grouped by vector length, segment and block of anchors."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    keys = ["n", "segment", "block"]
    left = rows.withColumn("n", F.size("v")).withColumn("segment", own(segments)).withColumn("block", every(blocks))
    # Anchors are rows too: new names keep the two sides apart.
    right = anchors.toDF(*anchors.columns).withColumn("n", F.size("v")).withColumn("block", own(blocks)).withColumn("segment", every(segments))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _numbered(vectors: DataFrame, is_anchor: Column, scale: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(`row`, `id`, `label`, `anchor`, `v` of whole numbers) of rows that take part, stored so that row numbers stay."""
    v = named(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = vectors.select(
        named(id_col).cast("long").alias("id"),
        named(label_col).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        v.alias("v"),
    )
    picked = picked.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite)
    whole = F.transform("v", lambda x: F.floor(x * scale))
    return store(picked.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", whole.alias("v")), "vectors")


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """Rows `anchor_id`, `positive_id`, `rank` (from 1), `negative_id`, `positive_score`, `negative_score`.

    Components become floor(`scale` * x); a score is the whole inner product, higher
    scores come first, ties go to smaller ids. An anchor's positives are its best
    other rows of the same label. For each of them the best rows of other labels are
    returned whose score lies from `window[0]` to `window[1]` hundredths of the
    positive's; a negative positive score leaves none. Fewer rows than wanted give
    all there are.

    Rows without id, label or vector, or with a null or non-finite component, take no
    part; nor do empty vectors. Vectors meet those of their own length only. Every
    row counts by itself: a repeated id is another row, so an anchor's copy may be its
    positive, and a repeated anchor is answered as often as it is there. Inner products
    must stay below 2**53. An empty table, or one without anchors, gives no rows. Other
    columns are not read. Writes intermediate tables to the shared folder.
    """
    rows = _numbered(vectors, is_anchor, scale, id_col, label_col, vec_col)
    n, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    segments = max(-(-n // SEGMENT_ROWS), min(SPREAD, -(-n // SPREAD_ROWS)), 1)
    blocks = max(-(-asked // ANCHOR_BLOCK), 1)
    anchors = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            held = _segment(left)
            for row, label, v in zip(*(right.column(c).to_pylist() for c in ("row", "label")), _matrix(right.column("v"))):
                places, scores = held.best(v, row, label, positives)
                found += [(row, held.rows[p], held.ids[p], int(s)) for p, s in zip(places, scores)]
        return pa.Table.from_arrays(
            [pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 4,
            names=["row", "positive_row", "positive_id", "positive_score"],
        )

    fields = "row long, positive_row long, positive_id long, positive_score long"
    of_anchor = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    best = _dealt(rows, anchors, segments, blocks).applyInArrow(near, fields)
    best = best.withColumn("k", F.row_number().over(of_anchor)).filter(F.col("k") <= positives).drop("k")
    best = store(best, "positives")

    low, high = window
    # Hundredths of a score as whole numbers, rounded inwards.
    bounds = F.struct(
        "positive_score",
        F.expr(f"(positive_score * {low} + pmod(-positive_score * {low}, 100)) div 100").alias("bottom"),
        F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100").alias("top"),
    )
    windows = best.groupBy("row").agg(F.array_sort(F.collect_set(bounds)).alias("windows"))
    open_ = anchors.join(windows, "row")

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            held = _segment(left)
            columns = (right.column(c).to_pylist() for c in ("row", "label", "windows"))
            for row, label, of_row, v in zip(*columns, _matrix(right.column("v"))):
                edges = np.array([(w["bottom"], w["top"]) for w in of_row], np.float64)
                for w, (places, scores) in zip(of_row, held.within(v, label, edges, negatives)):
                    found += [(row, w["positive_score"], held.rows[p], held.ids[p], int(s)) for p, s in zip(places, scores)]
        return pa.Table.from_arrays(
            [pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 5,
            names=["row", "positive_score", "negative_row", "negative_id", "negative_score"],
        )

    fields = "row long, positive_score long, negative_row long, negative_id long, negative_score long"
    of_window = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    worst = _dealt(rows, open_, segments, blocks).applyInArrow(far, fields)
    worst = worst.withColumn("rank", F.row_number().over(of_window)).filter(F.col("rank") <= negatives)
    named_anchor = anchors.select("row", F.col("id").alias("anchor_id"))
    return (
        best.join(worst, ["row", "positive_score"])
        .join(named_anchor, "row")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )

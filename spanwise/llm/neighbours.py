"""Operator 7. Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is put into its leaf. A query
takes nodes from a priority queue by distance to their centres and so orders the
leaves. How many leaves have to be visited is calibrated: for some queries the true
neighbours are found by comparing with all rows, and visits are widened until the
wanted share of them lies in the leaves visited. A query whose leaves hold fewer rows
than it asks for goes on until they hold enough.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanwise.functions.columns import named
from spanwise.llm.common import store

#: Numbers (rows times components) in the sample that the tree is fitted on, and rows at most.
SAMPLE_NUMBERS = 4_000_000
SAMPLE_ROWS = 20_000
#: Children of a node, and rows of the sample in a leaf.
BRANCHES = 8
LEAF_ROWS = 100
#: Queries that visits are calibrated with, and the share of their true neighbours wanted.
CALIBRATION_QUERIES = 200
RECALL = 0.97
#: Rows and queries that meet in one group at most.
ROW_BLOCK = 20_000
QUERY_BLOCK = 20_000


@dataclass
class Tree:
    """Centres of all nodes, their children (none: a leaf) and the leaves' numbers."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf_of: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by descending to the nearest child."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf_of[node]
                continue
            nearest = _distances(x[rows], self.centres[below]).argmin(1)
            todo += [(below[k], rows[nearest == k]) for k in range(len(below)) if (nearest == k).any()]
        return out

    def leaves(self, x: np.ndarray, visits: int, held: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order: `visits` of them, and more until they hold `least` rows (`held[leaf]` each)."""
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or rows < least):
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                leaf = int(self.leaf_of[node])
                found.append(leaf)
                rows += held[leaf]
                continue
            gaps = ((self.centres[below] - x) ** 2).sum(1)
            for gap, child in zip(gaps.tolist(), below.tolist(), strict=True):
                heapq.heappush(queue, (gap, child))
        return found


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, to compare centres with."""
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)


def _split(x: np.ndarray, state: np.random.Generator) -> np.ndarray:
    """Cluster numbers by k-means; vectors that are all alike stay together."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return np.zeros(len(x), np.int64)
    centres = distinct[state.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    for _ in range(10):
        of = _distances(x, centres).argmin(1)
        centres = np.stack([x[of == k].mean(0) if (of == k).any() else centres[k] for k in range(len(centres))])
    return _distances(x, centres).argmin(1)


def grow(sample: np.ndarray) -> Tree:
    """Hierarchical k-means over the sample."""
    state = np.random.default_rng(7)
    centres, children, leaf_of, leaves = [sample.mean(0)], [np.empty(0, np.int64)], [-1], 0
    todo = [(0, sample)]
    while todo:
        node, x = todo.pop()
        of = _split(x, state) if len(x) > LEAF_ROWS else np.zeros(len(x), np.int64)
        kinds = np.unique(of)
        if len(kinds) < 2:
            leaf_of[node], leaves = leaves, leaves + 1
            continue
        below = []
        for k in kinds:
            below.append(len(centres))
            centres.append(x[of == k].mean(0))
            children.append(np.empty(0, np.int64))
            leaf_of.append(-1)
            todo.append((len(centres) - 1, x[of == k]))
        children[node] = np.array(below)
    return Tree(np.stack(centres), children, np.array(leaf_of))


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: list, k: int) -> Iterator[tuple[int, int, float]]:
    """(query's place, id, distance) of the k nearest; `ids[i]` holds all ids of row i, ascending."""
    for q, query in enumerate(queries):
        gap = np.sqrt(((rows - query) ** 2).sum(1))
        near = np.argpartition(gap, min(k, len(gap)) - 1)[:k] if len(gap) > k else np.arange(len(gap))
        edge = gap[near].max()
        near = np.flatnonzero(gap <= edge)
        best = heapq.nsmallest(k, ((gap[i], vec) for i in near for vec in ids[i]))
        for distance, vec in best:
            yield q, vec, float(distance)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(`id`, `v`) of vectors that take part."""
    kind = "array<double>"
    v = vectors.select(named(id_col).cast("long").alias("id"), named(vec_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (sizes.n if sizes else 0))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """Columns `query_id`, `rank` (from 1), the id and `score` (Euclidean distance), nearest first, ties to smaller ids.

    `queries` are rows of the same kind as `vectors`; a query's own id is no candidate.
    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, as queries or candidates; nor do null ids. Ids should be
    unique: a vector given twice with one id is one candidate. Equal vectors are one
    row of the index with its k + 1 smallest ids, which is exact however many there are.
    Fewer candidates than k give as many rows. Writes the index to the shared folder.
    """
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    fields = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType())])
    first = Window.partitionBy("v").orderBy("id")
    rows = _valid(vectors, id_col, vec_col).dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(first))
    rows = rows.filter(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = store(rows, "vectors")
    head = rows.select(F.size("v").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], fields)
    size = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // head.d))
    sample = rows.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(size).select("v").toPandas()
    tree = context.broadcast(grow(_stacked(sample["v"])))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(leaf=tree.value.assign(_stacked(part["v"])))

    index = store(rows.mapInPandas(placed, "v array<double>, ids array<long>, leaf long"), "index")
    asked = store(_valid(queries, id_col, vec_col).dropDuplicates(["id", "v"]), "queries")
    distinct = asked.groupBy("v").agg(F.min("id").alias("q"))

    trial = distinct.orderBy(F.xxhash64("v"), "q").limit(CALIBRATION_QUERIES).toPandas()
    if not len(trial):
        return spark.createDataFrame([], fields)
    trial_v = context.broadcast(_stacked(trial["v"]))

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                leaf = {vec: x for vecs, x in zip(part["ids"], part["leaf"], strict=True) for vec in vecs}
                found = list(_nearest(trial_v.value, _stacked(part["v"]), [list(x) for x in part["ids"]], k + 1))
                yield pd.DataFrame([(q, vec, gap, leaf[vec]) for q, vec, gap in found], columns=["q", "vec", "gap", "leaf"])

    true = index.mapInPandas(compared, "q int, vec long, gap double, leaf long")
    order = Window.partitionBy("q").orderBy("gap", "vec")
    true = true.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).toPandas()  # queries times k + 1
    true = true[true["vec"].to_numpy() != trial["q"].to_numpy()[true["q"].to_numpy(int)]]
    n_leaves = int(tree.value.leaf_of.max()) + 1
    per_leaf = index.groupBy("leaf").agg(F.count("*").alias("rows"))
    held = np.zeros(n_leaves, np.int64)
    for leaf, n in index.groupBy("leaf").agg(F.sum(F.size("ids"))).collect():  # one row per leaf of the bounded tree
        held[leaf] = n
    turn = {q: {leaf: i for i, leaf in enumerate(tree.value.leaves(trial_v.value[q], n_leaves, held, 0))} for q in set(true["q"])}
    needed = np.sort([turn[q][leaf] + 1 for q, leaf in zip(true["q"], true["leaf"], strict=True)])
    visits = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else n_leaves

    def ordered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(leaf=[tree.value.leaves(x, visits, held, k + 1) for x in _stacked(part["v"])])

    plan = distinct.mapInPandas(ordered, "v array<double>, q long, leaf array<long>").withColumn("leaf", F.explode("leaf"))
    asked_leaf = store(plan, "visits")
    blocks = per_leaf.join(asked_leaf.groupBy("leaf").agg(F.count("*").alias("asks")), "leaf", "left").select(
        "leaf",
        F.ceil(F.col("rows") / ROW_BLOCK).alias("row_blocks"),
        F.ceil(F.coalesce("asks", F.lit(1)) / QUERY_BLOCK).alias("query_blocks"),
    )
    # One row per leaf, and the tree of the bounded sample bounds the leaves.
    blocks = F.broadcast(blocks)
    row_side = index.join(blocks, "leaf").select(
        "leaf", "v", "ids",
        F.pmod(F.xxhash64("v"), F.col("row_blocks")).alias("rb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("qb"),
    )
    query_side = asked_leaf.join(blocks, "leaf").select(
        "leaf", "v", "q",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1)).alias("rb"),
        F.pmod(F.xxhash64("v"), F.col("query_blocks")).alias("qb"),
    )

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            q = right["q"].to_list()
            ids = [list(x) for x in left["ids"]]
            found = [(q[i], vec, gap) for i, vec, gap in _nearest(_stacked(right["v"]), _stacked(left["v"]), ids, k + 1)]
        return pd.DataFrame(found, columns=["q", "vec", "gap"])

    keys = ["leaf", "rb", "qb"]
    near = row_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInPandas(searched, "q long, vec long, gap double")
    best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    found = asked.join(distinct, "v").select("id", "q").join(best.select("q", "vec", "gap"), "q").filter("vec <> id")
    final = Window.partitionBy("id").orderBy("gap", "vec")
    return found.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), F.col("gap").alias("score")
    )

"""Operator 9. Toxicity by maximum-scoring segments of token log-odds.

Words and beginnings of words get log-odds of toxic against clean documents under an
informative Dirichlet prior (the pooled shares); only those that stand out by several
standard errors count, a word before its beginnings and long beginnings before short
ones. Words without evidence lower a running score a little. All maximal scoring
segments of a text are found in one pass (Ruzzo and Tompa). The best score of clean
text grows with the logarithm of its length and follows an extreme-value
distribution; against that fitted law segments are standardised, summed and turned
into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.common import bounded_rows, map_texts, text_slices
from spanwise.llm.near_dedup import near_duplicates

#: Labelled rows a model is fitted on, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Weight of the prior against the documents counted.
PRIOR = 0.1
#: Standard errors that log-odds must reach: so many, and so many more for each power of e of toxic documents.
#: More documents make more words that could stand out by chance, and true ones stand out further.
CAUTION = (1.2, 0.5)
#: Log-odds below this are no evidence: longer documents hold more of every word.
LEAST = 2.0
#: Lengths of beginnings, which are marked apart from whole words.
STEMS = (8, 7, 6, 5, 4)
_STEM = "\0"
#: What a word without evidence takes off a running score.
DRIFT = 0.05

_WORD = re.compile(r"\w+")
_BIN = 0.5
CACHE_ENTRIES = 300_000
_LOW, _HIGH = -20.0, 60.0


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its beginnings, what counts first coming first."""
    return [word, *[_STEM + word[:n] for n in STEMS if n < len(word)]]


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of words and beginnings; the law of clean text's best segment; line of the log-odds of a document."""

    weights: dict[str, float]
    centre: float
    growth: float
    scale: float
    slope: float
    intercept: float

    def statistic(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        """The best segment against the law of clean text, and what further ones exceed it by."""
        usual = self.centre + self.growth * math.log(max(n_words, 1))
        best, *rest = sorted((s for _, _, s in segments), reverse=True) or [0.0]
        excess = sum(max(0.0, (s - usual) / self.scale) for s in rest)
        return min(_HIGH, max(_LOW, (best - usual) / self.scale + excess))

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, self.slope * statistic + self.intercept))))


class Weigher:
    """Score of each word, 0 without evidence; the words met are remembered up to a bound."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.known = weights, {}

    def __call__(self, tokens: list[str]) -> list[float]:
        known = self.known
        for word in set(tokens).difference(known):
            known[word] = next((w for f in features(word) if (w := self.weights.get(f))), 0.0)
        found = [known[word] for word in tokens]
        if len(known) > CACHE_ENTRIES:
            known.clear()
        return found


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, word after the last, score), in linear time.

    `scores` are positive for words with evidence and 0 for others, which are a step down.
    """
    total, at = 0.0, 0
    kept: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i, score in enumerate(scores):
        if not score:
            continue
        total -= DRIFT * (i - at)
        at = i + 1
        start, end, low, high = i, i + 1, total, total + score
        total = high
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                kept.append((start, end, low, high))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def _examples(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, keep: Column | None, rows: int):
    """(text, 0 or 1) of the sample. Its ids have a bound, so they are broadcast and texts are not moved."""
    labelled = labels.select(named(id_col).alias("id"), named(label).cast("int").alias("y"))
    labelled = labelled.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    if keep is not None:
        labelled = labelled.filter(keep)
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "id").select("y", "text").distinct()


def _grouped(examples: DataFrame) -> DataFrame:
    """(`y`, `text`, `copies`): the group of near copies that a toxic text is in, null if it is alone."""
    key = F.xxhash64("text")
    toxic = examples.filter("y = 1").select(key.alias("doc_id"), "text")
    groups = near_duplicates(toxic).select("doc_id", F.col("component_id").alias("copies"))
    several = groups.groupBy("copies").count().filter("count > 1").select("copies")
    # At most as many rows as ids the model is fitted on.
    groups = groups.join(several, "copies").select(F.col("doc_id").alias("key"), "copies").distinct()
    joined = examples.join(F.broadcast(groups), (F.col("y") == 1) & (key == F.col("key")), "left")
    return joined.select("y", "text", "copies")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word, summed within a slice, and the groups of copies that do; the empty word counts documents."""
    for part in text_slices(batches):
        found, groups = (Counter(), Counter()), {}
        for y, text, copies in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            held = {"", *(f for word in set(words(text)) for f in features(word))}
            if copies is None:
                found[y].update(held)
            else:
                groups.setdefault(copies, set()).update(held)
        vocabulary = list(found[0] | found[1])
        of_groups = [(word, copies) for copies, held in groups.items() for word in held]
        zeros = [0] * len(of_groups)
        columns = [
            pa.array(vocabulary + [w for w, _ in of_groups], pa.string()),
            *[pa.array([c[w] for w in vocabulary] + zeros, pa.int64()) for c in found],
            pa.array([None] * len(vocabulary) + [c for _, c in of_groups], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic", "copies"])


def _weights(examples: DataFrame) -> dict[str, float]:
    """Log-odds of words that stand out. A group of near copies among the toxic texts counts as one, or all of its words would stand out."""
    counts = _grouped(examples).mapInArrow(_document_counts, "word string, clean long, toxic long, copies long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), (F.sum("toxic") + F.count_distinct("copies")).alias("toxic"))
    total = counts.filter(F.col("word") == "").first()
    if total is None or not total.clean or not total.toxic:
        return {}
    prior = F.col("clean") + F.col("toxic")
    scale = PRIOR * (total.clean + total.toxic)

    def log_odds(side: str, n: int) -> Column:
        held = F.col(side) + PRIOR * prior
        return F.log(held / (n + scale - held + 0.5))

    error = F.sqrt(1 / (F.col("toxic") + PRIOR * prior) + 1 / (F.col("clean") + PRIOR * prior))
    weight = log_odds("toxic", total.toxic) - log_odds("clean", total.clean)
    least = CAUTION[0] + CAUTION[1] * math.log(total.toxic)
    found = counts.filter((F.col("word") != "") & (weight > least * error) & (weight >= LEAST)).select("word", weight.alias("weight"))
    return {r.word: r.weight for r in bounded_rows(found, 500_000, "words with evidence of toxicity")}


def _fit_line(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of the log-odds of label 1 by Newton's method, lightly held back so that both stay finite."""
    x = np.array([b[0] for b in bins])
    clean = np.array([b[1] for b in bins], float)
    toxic = np.array([b[2] for b in bins], float)
    design, beta, held = np.stack([x, np.ones_like(x)], 1), np.zeros(2), np.diag([1e-2, 1e-4])

    def loss(b: np.ndarray) -> float:
        line = design @ b
        return float((clean + toxic) @ np.logaddexp(0, line) - toxic @ line + b @ held @ b / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        slope = design.T @ ((clean + toxic) * p - toxic) + held @ beta
        bend = (design * ((clean + toxic) * p * (1 - p))[:, None]).T @ design + held
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Callable[[str], Column] | None = None,
    fit_rows: int = FIT_ROWS,
) -> ToxicityModel | None:
    """Model from labelled documents; None if one of the labels 0 and 1 does not occur.

    At most `fit_rows` labelled ids are used; `keep`, given the name of an id column,
    restricts them. Labels other than 0 and 1 and null ids are left out, an id with
    both labels counts as 1, equal texts with one label count once, and toxic texts that
    are near copies count words once. Writes what near copies are found with to the shared folder.
    """
    examples = _examples(docs, labels, label, id_col, text_col, keep("id") if keep else None, fit_rows).cache()
    try:
        weights = _weights(examples)
        if not weights and examples.select("y").distinct().count() < 2:
            return None
        shared = docs.sparkSession.sparkContext.broadcast(weights)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weigh = Weigher(shared.value)
            for part in text_slices(batches):
                best, others, n = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = words(text)
                    top, *rest = sorted((s for *_, s in maximal_segments(weigh(tokens))), reverse=True) or [0.0]
                    best.append(top)
                    others.append(rest)
                    n.append(math.log(max(len(tokens), 1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best), pa.array(others, pa.list_(pa.float64())), pa.array(n)],
                    names=["y", "best", "others", "n"],
                )

        seen = examples.mapInArrow(measured, "y int, best double, others array<double>, n double")
        clean = seen.filter("y = 0").agg(
            F.avg("best"), F.avg("n"), F.var_pop("best"), F.var_pop("n"), F.covar_pop("best", "n")
        ).first()
        mean, mean_n, spread, spread_n, both = (x or 0.0 for x in clean)
        growth = max(0.0, both / spread_n) if spread_n > 1e-9 else 0.0
        rest = max(0.0, spread - 2 * growth * both + growth**2 * spread_n)
        scale = max(math.sqrt(6 * rest) / math.pi, 0.1)
        centre = mean - growth * mean_n - 0.5772156649 * scale
        usual = F.lit(centre) + F.lit(growth) * F.col("n")
        excess = F.aggregate("others", F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), (s - usual) / scale))
        statistic = F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), (F.col("best") - usual) / scale + excess))
        place = F.floor(statistic / _BIN).cast("int").alias("place")
        bins = seen.groupBy(place).agg(F.sum(1 - F.col("y")), F.sum("y")).collect()  # at most 161 places
    finally:
        examples.unpersist()
    slope, intercept = _fit_line([((b[0] + 0.5) * _BIN, b[1], b[2]) for b in bins])
    return ToxicityModel(weights, centre, growth, scale, slope, intercept)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns id, `score` (0 to 1), `predicted` (1 from 0.5 on), `segments` (first word, word after, score).

    One row per input row, whole texts. Texts that are null, empty or without words
    have no segments and the score of no evidence; without a model every score is 0.
    Null and repeated ids are kept; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        fitted = shared.value
        weigh = Weigher(fitted.weights if fitted else {})

        def work(texts: list[str | None]) -> list[pa.Array]:
            scores, passages = [], []
            for text in texts:
                tokens = words(text)
                found = maximal_segments(weigh(tokens)) if fitted else []
                scores.append(fitted.probability(fitted.statistic(found, len(tokens))) if fitted else 0.0)
                passages.append([{"first": a, "after": b, "score": s} for a, b, s in found])
            predicted = [int(s >= 0.5) for s in scores]
            return [pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(passages, kind)]

        return work

    fields = "score double, predicted int, segments array<struct<first: int, after: int, score: double>>"
    return map_texts(docs, id_col, text_col, start, fields)


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, with all their columns; nothing is moved. Without a model all stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        weigh = Weigher(fitted.weights)

        def of_text(text: str | None) -> float:
            tokens = words(text)
            return fitted.probability(fitted.statistic(maximal_segments(weigh(tokens)), len(tokens)))

        for texts in batches:
            yield texts.map(of_text).astype(float)

    return docs.filter(score(named(text_col).cast("string")) < 0.5)

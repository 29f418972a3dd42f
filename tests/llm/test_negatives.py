"""Hard negatives against brute force and SQL."""

import math
import random

import numpy as np
import pytest
from compare import connect, differences
from odd_rows import SF, shipped  # noqa: F401
from pyspark.sql import functions as F

from spanwise.llm import hard_negatives as hn
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label string, row long, v int, segment string"


def by_hand(vectors, is_anchor, positives=5, negatives=3, window=(50, 95)):
    """Straight from the definition; `vectors` are (id, vector, label), a copy is a row of its own."""
    ok = [r for r in vectors if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in ok]
    found = []
    for k, (anchor, v, label) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), i, lab == label) for j, (i, w, lab) in enumerate(rows) if j != k and len(w) == len(v)]
        for score, i, _ in sorted(o for o in others if o[2])[:positives]:
            inside = sorted(o for o in others if not o[2] and -window[0] * score <= -100 * o[0] <= -window[1] * score)
            found += [(anchor, i, r + 1, j, -score, -s) for r, (s, j, _) in enumerate(inside[:negatives])]
    return sorted(found)


def mined(spark, vectors, every=5, **options):
    rows = [(*r, 1, 2, "x") for r in vectors]
    got = hn.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, size=12, seed=1, labels=4):
    state = np.random.default_rng(seed)
    centres = state.normal(0, 0.3, (6, size))
    return [(i, (centres[state.integers(6)] + state.normal(0, 0.1, size)).tolist(), str(state.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "SPREAD_ROWS", 40)  # several segments
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 20)  # and blocks of anchors
    vectors = clustered(200, seed=seed)
    expected = by_hand(vectors, lambda i: i % 5 == 0)
    assert len(expected) > 100 and mined(spark, vectors) == expected
    assert mined(spark, vectors, positives=2, negatives=1, window=(80, 120)) == by_hand(vectors, lambda i: i % 5 == 0, 2, 1, (80, 120))


def test_odd_rows(spark):
    vectors = clustered(60, 5)
    vectors += [(None, [0.1] * 5, "1"), (5, None, "1"), (10, [0.1] * 5, None), (15, [0.1, None, 0.1, 0.1, 0.1], "1"), (20, [], "1"),
                (25, [0.1, float("nan"), 0.1, 0.1, 0.1], "1"), (30, [0.1, float("inf"), 0.1, 0.1, 0.1], "1"), (35, [0.2, 0.1], "1"),
                (36, [0.2, 0.1], "2"), (37, [0.2, 0.15], "1"), (40, [0.0] * 5, "1"), (45, [-0.5] * 5, "only one of its label")]
    vectors += vectors[:10] + [(3, [0.3] * 5, "2")]  # repeated rows, and another row with an id that is taken
    assert mined(spark, vectors) == by_hand(vectors, lambda i: i % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, clustered(3), every=100) == by_hand(clustered(3), lambda i: i == 0)
    assert mined(spark, [r for r in clustered(9) if r[0] % 5]) == []


def test_ties_and_a_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(hn, "SPREAD_ROWS", 30)
    state = random.Random(3)
    vectors = [(i, [state.choice([0.0, 0.25, 0.5]) for _ in range(4)], state.choice("ab")) for i in range(150)]
    vectors += [(1000 + i, [0.5, 0.25, 0.25, 0.0], state.choice("ab")) for i in range(120)]
    assert mined(spark, vectors) == by_hand(vectors, lambda i: i % 5 == 0)


def test_candidates_leave_before_all_components_are_read():
    state = np.random.default_rng(6)
    decay = 0.8 ** np.arange(64)
    vectors = np.floor(256 * state.normal(0, 1, (4000, 64)) * decay)
    labels, ids = state.integers(0, 4, 4000).astype(str), np.arange(4000)
    segment = hn.Segment(vectors, labels, ids, ids)
    for anchor in range(0, 4000, 400):
        scores = vectors @ vectors[anchor]
        same = np.flatnonzero((labels == labels[anchor]) & (ids != anchor))
        other = np.flatnonzero(labels != labels[anchor])
        expected = same[np.lexsort((same, -scores[same]))[:5]]
        places, found = segment.best(vectors[anchor], anchor, labels[anchor], 5)
        assert segment.ids[places].tolist() == expected.tolist() and found.tolist() == scores[expected].tolist()
        windows = np.array([(0.5 * s, 0.95 * s) for s in found])
        for (low, high), (places, inside) in zip(windows, segment.within(vectors[anchor], labels[anchor], windows, 3)):
            wanted = other[(scores[other] >= low) & (scores[other] <= high)]
            wanted = wanted[np.lexsort((wanted, -scores[wanted]))[:3]]
            assert segment.ids[places].tolist() == wanted.tolist() and inside.tolist() == scores[wanted].tolist()
    assert segment.read < 0.6 * 10 * 4000 * 64


def test_scores_that_would_not_be_exact_are_refused():
    segment = hn.Segment(np.full((3, 2), 2.0**27), np.array(["a", "a", "b"]), np.arange(3), np.arange(3))
    with pytest.raises(ValueError, match="exact"):
        segment.best(np.full(2, 2.0**27), 0, "a", 1)


def test_query_equals_its_sql(spark):
    con = connect(SF)
    found = QUERIES["op11_hard_negatives"](spark, SF).withColumn("rank", F.col("rank").cast("long"))
    sql = f"SELECT * REPLACE (CAST(rank AS BIGINT) AS rank) FROM ({ORACLES['op11_hard_negatives']})"
    assert differences(found, con, sql) == []

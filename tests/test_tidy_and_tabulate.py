import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanwise.functions import recode as V
from spanwise.plans import tabulate as G


def one(df, **columns):
    return rows(df.select("n", *[c.alias(k) for k, c in columns.items()]))


def test_buckets_and_rounding(table):
    df = table("n int, x double", (1, 0.0), (2, 1.0), (3, 199.0), (4, 200.0), (5, -1.0), (6, -199.0), (7, None))
    assert one(df, b=V.signed_bucket(F.col("x"))) == [(1, 0.0), (2, 100.0), (3, 100.0), (4, 300.0), (5, -100.0), (6, -100.0), (7, None)]
    assert one(df, b=V.round_to(F.col("x"), 30))[2:4] == [(3, 210.0), (4, 210.0)]
    assert one(df, b=V.floor_to(F.col("x"), 5))[2] == (3, 195.0)
    assert one(df, b=V.cap(F.col("x"), 100.0))[2:] == [(3, 100.0), (4, 100.0), (5, -1.0), (6, -199.0), (7, None)]


def test_bands_and_activity(table):
    df = table("n int, y int, a int, b int, c int", (1, 2003, 200, 200, 0), (2, 1950, 200, None, 10), (3, 1980, 179, None, None), (4, None, None, None, None))
    assert one(df, g=V.age_band(F.col("y"), 2018)) == [(1, "c"), (2, "r"), (3, "a"), (4, None)]
    assert one(df, g=V.main_activity(["a", "b", "c"], "a")) == [(1, None), (2, 1), (3, None), (4, None)]
    assert one(df, g=V.any_positive(["b", "c"])) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert one(df, g=V.valid_range(F.col("a"), 1, 199)) == [(1, None), (2, None), (3, 179), (4, None)]


def test_transitions(table):
    df = table("n int, a_q1 int, a_q2 int, b_q1 int, b_q2 int", (1, None, 5, None, None), (2, 5, None, None, None), (3, 5, None, None, 1), (4, None, None, None, None))
    flags = V.transitions(["a", "b"], ["q1", "q2"])
    assert one(df, **flags) == [(1, 1, None), (2, None, 1), (3, None, None), (4, None, None)]


WIDE = "id int, g1 int, g2 int, m string, v double"


@pytest.fixture()
def wide(table):
    return table(WIDE, (1, 1, 1, "x", 10.0), (2, 1, 0, "y", None), (3, None, 0, "x", 5.0), (4, 0, 1, None, 7.5))


def test_groups_and_distributions(wide, monkeypatch):
    members = G.group_members(wide, "id", ["g1", "g2"])
    assert rows(members, "group_name", "id") == [("g1", 1), ("g1", 2), ("g2", 1), ("g2", 4)]
    by_join = G.distribution_by_group(wide, members, "id", ["m"])
    by_flag = G.distribution_by_group(wide, ["g1", "g2"], "id", ["m"])
    cols = ("group_name", "measure", "value", "count")
    assert rows(by_join, *cols) == rows(by_flag, *cols) == sorted(
        [("g1", "m", "x", 1), ("g1", "m", "y", 1), ("g2", "m", "x", 1), ("g2", "m", None, 1), (None, "m", "x", 1)], key=repr
    )
    monkeypatch.setattr(G, "_MAX_FLAGS", 1)
    assert rows(G.distribution_by_group(wide, ["g1", "g2"], "id", ["m"]), *cols) == rows(by_join, *cols)
    monkeypatch.undo()
    totals = G.totals_by_group(wide, ["g1", "g2"], "id", ["v"])
    assert rows(totals, "group_name", "total", "count") == sorted([("g1", 10.0, 1), ("g2", 17.5, 2), (None, 5.0, 1)], key=repr)
    spread = G.spread_groups(by_join, groups=["g1", "g2", G.NO_GROUP])
    assert rows(spread, "value", "g1", "g2", G.NO_GROUP) == sorted([("x", 1, 1, 1), ("y", 1, None, None), (None, None, 1, None)], key=repr)


def test_adjustment_equalises_one_adjuster(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("a"), (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    overall = df.agg(F.avg("v")).first()[0]
    for min_rows in (None, 1):
        adjusted = G.adjusted_values(df, "v", ["a"], min_rows)
        assert adjusted.count() == 60
        assert all(math.isclose(r["m"], overall) for r in adjusted.groupBy("a").agg(F.avg("adj").alias("m")).collect())


def test_sweep_equals_single_tables(spark):
    df = spark.range(400).select(
        (F.col("id") % 5).cast("string").alias("g"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("h"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("a"),
        F.when(F.col("id") % 13 > 0, F.col("id") % 4).alias("b"),
        F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 101).cast("double")).alias("v"),
        (F.col("id") * 5 % 23).cast("double").alias("w"),
    )
    sets = [[], ["a"], ["a", "b"], ["b", "a"]]
    swept = {(r["col"], r["subgroup"], r["label"]): r for r in G.mean_sweep(df, ["g", "h"], ["v", "w"], sets).collect()}
    n = 0
    for value in ("v", "w"):
        for adjusters in sets:
            adjusted = G.adjusted_values(df, value, adjusters)
            for group in ("g", "h"):
                for r in G.tabulate_means(adjusted, group, G.sweep_label(value, adjusters)).collect():
                    found = swept[(r["col"], r["subgroup"], r["label"])]
                    n += 1
                    assert found["num"] == r["num"]
                    for c in ("mean", "sdev", "total"):
                        assert math.isclose(found[c], r[c], rel_tol=1e-9, abs_tol=1e-9)
    assert n == len(swept) == 2 * 4 * 7


def test_pair_counts(wide):
    found = G.pair_counts(wide, ["g1", "g2", "m"])
    assert ("g1", "1", "m", "x", 1) in rows(found)
    assert sum(r[4] for r in rows(found) if (r[0], r[2]) == ("g1", "g2")) == 3


def test_reports_are_whole_or_refused():
    from spanwise.plans.reports import counted_columns, summed_columns
    from spanwise.plans.tidy import TidyNames

    for columns in (counted_columns, summed_columns):
        with pytest.raises(ValueError, match="total_income"):
            columns(["birth_year"], TidyNames())


def test_tidy_step_refuses_small_or_repeated_tables(spark, sf):
    from registry.inputs import frame
    from spanwise.plans.tidy import checked_wide_table, tidy_wide_table

    wide = frame(spark, sf, "person_wide")
    assert checked_wide_table(wide).columns == tidy_wide_table(wide).columns
    with pytest.raises(AssertionError):
        checked_wide_table(wide.unionByName(wide))
    with pytest.raises(AssertionError):
        checked_wide_table(wide, min_rows=wide.count() + 1)

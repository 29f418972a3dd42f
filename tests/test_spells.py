import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanwise.functions.dates import partial_date
from spanwise.operators import overlap as O
from spanwise.operators import spells as S
from spanwise.operators.skew import attach_group_stats, hot_keys

SPELL = "id int, start_date date, end_date date"
OUT = ("id", "start_date", "end_date")


def day(n):
    return dt.date(2001, 1, 1) + dt.timedelta(days=n)


def random_spells(people, per_person, seed, span=120):
    rng = random.Random(seed)
    out = []
    for person in range(people):
        for _ in range(rng.randint(0, per_person)):
            start = rng.randint(0, span)
            out.append((person, day(start), day(start + rng.randint(-2, 14))))
    return out


def busy_days(spells):
    """person -> set of day numbers covered."""
    covered = {}
    for person, start, end in spells:
        covered.setdefault(person, set()).update(range(start.toordinal(), end.toordinal() + 1))
    return covered


def islands(days, linked=1):
    """Runs of day numbers as (first, last) text."""
    runs, run = [], []
    for d in sorted(days):
        if run and d - run[-1] > linked:
            runs.append((run[0], run[-1]))
            run = []
        run.append(d)
    if run:
        runs.append((run[0], run[-1]))
    return [(dt.date.fromordinal(a).isoformat(), dt.date.fromordinal(b).isoformat()) for a, b in runs]


def test_condense_worked_example(table):
    df = table(
        SPELL,
        (1, "2001-01-01", "2001-01-05"),
        (1, "2001-01-06", "2001-01-12"),
        (1, "2001-02-09", "2001-02-14"),
        (1, "2001-02-12", "2001-02-18"),
        (1, "2001-02-18", "2001-02-28"),
        (1, "2010-10-10", "2010-10-10"),
    )
    joined = [(1, "2001-01-01", "2001-01-12"), (1, "2001-02-09", "2001-02-28"), (1, "2010-10-10", "2010-10-10")]
    assert rows(S.condense_spells(df, "id"), *OUT) == joined
    touching = [(1, "2001-01-01", "2001-01-05"), (1, "2001-01-06", "2001-01-12"), *joined[1:]]
    assert rows(S.condense_spells(df, "id", gap_days=0), *OUT) == touching


def test_condense_open_ends_and_reversed(table):
    df = table(
        SPELL,
        (1, "2001-01-01", "9999-12-31"),
        (1, "2005-01-01", "2005-02-01"),
        (2, "2001-03-01", "2001-02-01"),
        (3, "2001-01-01", "2001-01-02"),
        (3, "2001-01-03", "9999-01-01"),
    )
    assert rows(S.condense_spells(df, "id"), *OUT) == [(1, "2001-01-01", "9999-12-31"), (3, "2001-01-01", "9999-01-01")]
    assert rows(S.condense_spells(df, "id", open_ended="drop"), *OUT) == []
    with pytest.raises(ValueError):
        S.condense_spells(df, "id", open_ended="maybe")


def test_condense_against_days(spark):
    spells = random_spells(60, 12, seed=1)
    df = spark.createDataFrame(spells, SPELL)
    expected = [(p, *i) for p, days in busy_days(spells).items() for i in islands(days)]
    once = S.condense_spells(df, "id")
    assert rows(once, *OUT) == sorted(expected, key=repr)
    assert rows(S.condense_spells(once, "id"), *OUT) == sorted(expected, key=repr)


def test_invert_worked_example(table):
    df = table(SPELL, (1, "2001-01-01", "2001-01-05"), (1, "2001-01-06", "2001-01-12"), (1, "2001-02-12", "2001-02-18"))
    assert rows(S.invert_spells(df, "id"), *OUT) == [
        (1, "1900-01-01", "2000-12-31"),
        (1, "2001-01-13", "2001-02-11"),
        (1, "2001-02-19", "9999-01-01"),
    ]


def test_invert_at_the_edges(table):
    df = table(
        SPELL,
        (1, "1890-01-01", "1899-12-31"),
        (2, "1899-01-01", "1900-01-31"),
        (3, "1900-01-01", "9999-12-31"),
        (4, "2001-01-01", "9999-12-31"),
    )
    assert rows(S.invert_spells(df, "id"), *OUT) == [
        (1, "1900-01-01", "9999-01-01"),
        (2, "1900-02-01", "9999-01-01"),
        (4, "1900-01-01", "2000-12-31"),
    ]


def test_condensed_and_inverted_tile_the_time_line(spark):
    df = spark.createDataFrame(random_spells(40, 8, seed=2), SPELL)
    lo, hi = "2000-06-01", "2002-06-01"
    both = S.condense_spells(df, "id").unionByName(S.invert_spells(df, "id", origin=lo, horizon=hi))
    sums = both.groupBy("id").agg(F.sum(F.datediff("end_date", "start_date") + 1).alias("n"))
    whole = (dt.date.fromisoformat(hi) - dt.date.fromisoformat(lo)).days + 1
    assert {r["n"] for r in sums.collect()} == {whole}
    assert O.intersect_spells(S.condense_spells(df, "id"), S.invert_spells(df, "id"), "id").isEmpty()


def test_gaps_within_bounds(table):
    bounds = table(
        "id int, earliest_date date, latest_date date",
        (1, "2001-01-01", "2001-12-31"),
        (2, "2001-01-01", "2001-12-31"),
        (3, "2001-01-01", "2001-12-31"),
        (4, "2001-01-01", "2001-12-31"),
        (5, "2001-12-31", "2001-01-01"),
        (6, "2001-01-01", "9999-01-01"),
        (7, "2001-01-01", "2001-12-31"),
    )
    busy = table(
        SPELL,
        (1, "2000-06-01", "2001-02-28"),
        (1, "2001-03-01", "2001-03-10"),
        (1, "2001-11-01", "2002-03-01"),
        (2, "1999-01-01", "9999-01-01"),
        (4, "1990-01-01", "1990-02-01"),
        (6, "2001-02-01", "2001-02-02"),
        (7, "2001-01-01", "2001-12-30"),
        (9, "2001-01-01", "2001-12-30"),
    )
    assert rows(S.gaps_within_bounds(busy, bounds, "id"), *OUT) == [
        (1, "2001-03-11", "2001-10-31"),
        (3, "2001-01-01", "2001-12-31"),
        (4, "2001-01-01", "2001-12-31"),
        (6, "2001-01-01", "2001-01-31"),
        (6, "2001-02-03", "9999-01-01"),
        (7, "2001-12-31", "2001-12-31"),
    ]


def test_gaps_against_days(spark):
    spells = random_spells(60, 8, seed=3)
    rng = random.Random(4)
    bounds = [(p, day(rng.randint(0, 60)), day(rng.randint(50, 140))) for p in range(70)]
    covered = busy_days(spells)
    expected = []
    for person, lo, hi in bounds:
        free = set(range(lo.toordinal(), hi.toordinal() + 1)) - covered.get(person, set())
        expected += [(person, *i) for i in islands(free)]
    found = S.gaps_within_bounds(
        spark.createDataFrame(spells, SPELL), spark.createDataFrame(bounds, "id int, earliest_date date, latest_date date"), "id"
    )
    assert rows(found, *OUT) == sorted(expected, key=repr)


def test_windows_made_from_the_key_are_not_worked_out_for_busy_spells(spark, table):
    """What tells which windows have days stays with the windows; a key may have several, reversed ones and none."""
    born = F.make_date(F.lit(1990) + F.col("id").cast("int") % 7, F.lit(1), F.lit(1))
    bounds = spark.range(30).select("id", born.alias("earliest_date"), F.add_months(born, F.col("id").cast("int") % 5 - 1).alias("latest_date"))
    busy = spark.range(200).select((F.col("id") % 40).alias("id"), F.date_add(F.lit(day(-4000)), F.col("id").cast("int") * 9).alias("start_date"))
    found = S.gaps_within_bounds(busy.withColumn("end_date", F.date_add("start_date", 3)), bounds, "id")
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("make_date" in line for line in filters)
    twice = table(
        "id int, earliest_date date, latest_date date",
        (1, "2001-01-01", "2001-01-31"), (1, "2001-01-20", "2001-01-05"), (1, None, "2001-01-05"), (2, "2001-01-02", "2001-01-01"),
        (None, "2001-01-01", "2001-01-02"), (3, "2001-01-01", None),
    )
    spells = table(SPELL, (1, "2001-01-04", "2001-01-25"), (2, "2001-01-01", "2001-01-02"), (3, "2001-01-01", "2001-01-02"))
    assert rows(S.gaps_within_bounds(spells, twice, "id"), *OUT) == [
        (1, "2001-01-01", "2001-01-03"),
        (1, "2001-01-26", "2001-01-31"),
        (None, "2001-01-01", "2001-01-02"),
    ]


@pytest.mark.parametrize("hot_rows", [None, 1, 6])
def test_overlap_join_against_pairs(spark, hot_rows):
    """The same pairs, once each, whether keys are treated as common or not."""
    rng = random.Random(5)

    def long_spells(seed):
        out = []
        for n, (p, s, e) in enumerate(random_spells(12, 14, seed)):
            if rng.random() < 0.3:
                e = s + dt.timedelta(days=rng.choice([31, 32, 33, 900, 1024, 4000, 40000]))
            if rng.random() < 0.1:
                e = dt.date(9999, 12, 31)
            if rng.random() < 0.1:
                s = dt.date(1, 1, 1)
            out.append((p, s, e, n))
        return out

    a, b = long_spells(6), long_spells(7)
    expected = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    left = spark.createDataFrame(a, SPELL + ", n int")
    right = spark.createDataFrame(b, SPELL + ", n int")
    hot = None if hot_rows is None else hot_keys(left, ["id"], hot_rows)
    found = O.overlap_join(left, right, "id", hot=hot)
    assert sorted((r["n"], r["right_n"]) for r in found.collect()) == expected


def test_short_spells_of_a_common_key_do_not_meet_in_wide_tiles(spark):
    """50,000 spells of one key over 19 years: tiles stay small and few more pairs are compared than found."""
    n = 50_000
    days = spark.range(n).select(
        F.lit(1).alias("id"), F.date_add(F.lit(dt.date(2001, 1, 1)), (F.col("id") * 7919 % 6939).cast("int")).alias("start_date"), F.col("id").alias("n")
    )
    left = days.withColumn("end_date", F.date_add("start_date", 3))
    hot = hot_keys(left, ["id"], 1)
    plan = O.tile_plan(O.tile_counts(left, left, ["id"]), every_key=True)
    sides = [O._tiled(left, ["id"], O.SPAN, plan, is_left) for is_left in (True, False)]
    tile = ["_level", "_tile", "_meets"]
    a, b = (s.groupBy(*tile).count() for s in sides)
    assert a.agg(F.max("count")).first()[0] < n / 50
    compared = a.join(b.withColumnRenamed("count", "m"), tile).agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    found = O.overlap_join(left, left, "id", hot=hot).count()
    assert found <= compared < 10 * found


def test_group_stats_equal_a_window(spark):
    data = [(k, v) for k in (1, 2, None) for v in range(k or 5)] * 3
    df = spark.createDataFrame(data, "k int, v int")
    expected = sorted([(k, v, max(w for j, w in data if j == k)) for k, v in data], key=repr)
    for min_rows in (None, 1, 4):
        found = attach_group_stats(df, ["k"], {"top": F.max("v")}, min_rows)
        assert sorted([tuple(r) for r in found.collect()], key=repr) == expected


def test_hot_list_is_short_and_leaves_no_common_key_off(spark, monkeypatch):
    from spanwise.operators import skew

    df = spark.range(50).select((F.col("id") % 10).alias("k")).unionByName(spark.range(70).select((F.col("id") % 2).alias("k")))
    for share, expected in ((3, {0, 1}), (9, {0, 1}), (30, set(range(10)))):
        monkeypatch.setattr(skew, "HOT_SHARE", share)
        assert {r["_hot_0"] for r in hot_keys(df, ["k"], 1).collect()} == expected
    assert hot_keys(df, ["k"], 41).isEmpty() and hot_keys(df.limit(0), ["k"], 1).isEmpty()


def test_snapshots(table):
    seen = "id int, seen date, hh int, old int"
    df = table(
        seen,
        (1, "2012-01-01", 5, None),
        (1, "2012-02-01", 5, None),
        (1, "2012-02-01", 5, None),
        (1, "2012-03-01", None, 7),
        (1, "2012-04-01", 9, 7),
        (1, "2012-05-20", 9, 7),
        (2, "2012-01-01", 5, None),
        (2, "2012-01-20", 5, None),
        (2, "2012-02-10", 5, None),
    )
    assert rows(S.snapshots_to_spells(df, "id", "seen", ["hh", "old"])) == [
        (1, "2012-01-01", "2012-02-01"),
        (1, "2012-03-01", "2012-04-01"),
        (2, "2012-01-01", "2012-02-10"),
        (2, "2012-01-20", "2012-02-10"),
    ]


def test_reporting_period(table):
    df = table(
        "n int, r date, s date, e date",
        (1, "2015-03-31", None, None),
        (2, "2015-03-31", "2015-02-10", "2015-03-20"),
        (3, "2015-03-31", "2015-01-30", "2015-03-04"),
        (4, "2015-03-31", "2015-03-31", "2015-04-10"),
        (5, "2015-03-31", "2015-03-25", "2015-03-20"),
    )
    assert rows(S.reporting_period_spells(df, "r", "s", "e"), "n", "start_date", "end_date") == [
        (1, "2015-03-01", "2015-03-31"),
        (2, "2015-02-10", "2015-03-20"),
        (3, "2015-03-01", "2015-03-31"),
        (4, "2015-03-01", "2015-03-31"),
        (5, "2015-03-25", "2015-03-31"),
    ]


def test_partial_dates_never_raise(table):
    df = table("n int, y int, m int, d int", (1, 2001, 2, 28), (2, 2001, 2, 29), (3, 2001, 13, 1), (4, None, 1, 1), (5, 2001, 4, 31), (6, 2004, 2, 29))
    made = df.select("n", partial_date(F.col("y"), F.col("m"), F.col("d")).alias("d"))
    assert rows(made) == [(1, "2001-02-28"), (2, None), (3, None), (4, None), (5, None), (6, "2004-02-29")]


def test_roles_stacked_once(table):
    df = table("n int, a int, b int", (1, 10, 20), (2, 10, 10), (3, None, 20), (4, 10, None), (5, None, None))
    assert rows(S.stack_roles(df, ["a", "b"], "p"), "n", "p") == [(1, 10), (1, 20), (2, 10), (3, 20), (4, 10)]


def test_longest_sequence_keeps_ties(table):
    df = table("id int, seq int, x string", (1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 0, "d"), (None, 9, "e"))
    for min_rows in (None, 1):
        assert rows(S.keep_longest_sequence(df, "id", "seq", min_rows), "x") == [("b",), ("c",), ("d",)]


def test_terminal_events(table):
    df = table(
        "id int, boss int, r date",
        (1, 7, "2015-01-31"),
        (1, 7, "2015-02-28"),
        (1, 8, "2015-04-30"),
        (1, 9, "2015-05-31"),
        (1, 9, "2015-12-31"),
        (2, 7, "2015-12-31"),
        (2, 8, "2016-01-31"),
    )
    assert rows(S.terminal_events(df, "id", "boss", "r"), "id", "boss", "event_date") == [(1, 7, "2015-02-28")]


def test_roles_of_recipients_and_partners(table):
    spells = table(SPELL + ", code string", (1, "2001-01-01", "2001-12-31", "x"), (2, "2001-06-01", "2001-06-30", "y"))
    partners = table("id int, partner int, start_date date, end_date date", (1, 5, "2001-03-01", "2001-03-31"), (1, 6, "2001-03-15", "2001-04-15"))
    for min_rows in (None, 1):
        found = S.classify_roles(spells, partners, "id", "partner", min_rows=min_rows)
        assert rows(found, "id", "role", "start_date", "end_date", "code") == [
            (1, "primary", "2001-03-01", "2001-03-31", "x"),
            (1, "primary", "2001-03-15", "2001-04-15", "x"),
            (1, "single", "2001-01-01", "2001-02-28", "x"),
            (1, "single", "2001-04-16", "2001-12-31", "x"),
            (2, "single", "2001-06-01", "2001-06-30", "y"),
            (5, "partner", "2001-03-01", "2001-03-31", "x"),
            (6, "partner", "2001-03-15", "2001-04-15", "x"),
        ]


def test_lookup_validity_and_missing_second_code(table):
    df = table("n int, c string, x string, at date", (1, "a", "null", "2001-01-01"), (2, "a", None, "2003-01-01"), (3, "a", "1", "2001-01-01"), (4, "b", "1", "2001-01-01"))
    codes = table("serv string, extra string, f date, t date, level string", ("a", None, "2000-01-01", "2002-01-01", "old"), ("a", None, "2002-01-02", "2009-01-01", "new"), ("a", "1", "2000-01-01", "2009-01-01", "one"))
    found = S.lookup_valid_at(df, codes, ("c", "serv"), ("x", "extra"), "at", "f", "t")
    assert rows(found, "n", "level") == [(1, "old"), (2, "new"), (3, "one"), (4, None)]


def test_relatives(table):
    people = table(
        "id int, p1 int, p2 int, died date",
        (1, None, None, "2001-01-28"),
        (2, None, None, None),
        (3, 1, 2, "2002-02-28"),
        (4, 1, 2, None),
        (5, 1, 1, None),
        (6, None, 2, None),
    )
    unions = table("a int, b int", (1, 2), (2, 2), (9, None))
    found = S.relative_events(people, unions, "id", "p1", "p2", "died", "a", "b")
    first, second = "2001-01-28", "2002-02-28"
    expected = [
        (1, second, "child", 3), (2, second, "child", 3),
        (3, first, "parent", 1), (4, first, "parent", 1), (5, first, "parent", 1),
        (4, second, "sibling", 3), (4, second, "sibling", 3), (5, second, "sibling", 3), (6, second, "sibling", 3),
        (2, first, "spouse", 1), (2, first, "coparent", 1),
    ]
    assert rows(found, "id", "event_date", "relationship", "deceased_id") == sorted(expected, key=repr)
    once = S.relative_events(people, unions, "id", "p1", "p2", "died", "a", "b", distinct=True)
    assert once.count() == len(expected) - 1

"""Common keys: the same rows as a plain join, and no task with more than a small share of one key."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanwise.operators import ledger as L
from spanwise.operators import overlap as O
from spanwise.operators import skew
from spanwise.operators import spells as S
from spanwise.plans import assembly as A

N = 20_000
FIRST = dt.date(2001, 1, 1)
GROUP = [*O._TILE, *skew.PARTS]


@pytest.fixture()
def every_partition(spark):
    """Joins are made by exchange, and partitions stay as they are dealt."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key in wanted:
        spark.conf.unset(key)


def spells_of(spark, n, length, spread=6939, key=1):
    start = F.date_add(F.lit(FIRST), (F.col("id") * 7919 % spread).cast("int"))
    return spark.range(n).select(
        F.lit(key).alias("id"), start.alias("start_date"), F.date_add(start, length).alias("end_date"), F.col("id").alias("n")
    )


def largest(df, by):
    return df.groupBy(*by).count().agg(F.max("count")).first()[0]


def test_short_spells_that_meet_one_long_spell_are_spread(spark):
    """All short spells of the key come to the long one's tile; its row is repeated for parts of them."""
    short, long = spells_of(spark, N, 3), spells_of(spark, 1, 9000, 1)
    plan = O.tile_plan(O.tile_counts(short, long, ["id"]), N // 10)
    left, right = (O._tiled(df, ["id"], O.SPAN, plan, is_left) for df, is_left in ((short, True), (long, False)))
    assert left.count() == N and largest(left, GROUP) < N / 20
    assert largest(right, GROUP) == 1 and right.count() < 100
    found = O.overlap_join(short, long, "id", min_rows=N // 10)
    assert found.count() == N and found.select("n").distinct().count() == N


def test_very_many_spells_on_the_same_days(spark):
    many, some = spells_of(spark, N, 0, 1), spells_of(spark, 300, 2, 2)
    plan = O.tile_plan(O.tile_counts(many, some, ["id"]), 400)
    sides = [O._tiled(df, ["id"], O.SPAN, plan, is_left) for df, is_left in ((many, True), (some, False))]
    assert largest(sides[0], GROUP) < N / 50 and largest(sides[1], GROUP) < 150
    assert O.overlap_join(many, some, "id", min_rows=400).count() == N * 150


@pytest.mark.parametrize("min_rows", [4, 30, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_cut_tiles_give_the_same_pairs_once(spark, seed, min_rows):
    state = random.Random(seed)

    def made():
        out = []
        for n in range(250):
            start = FIRST + dt.timedelta(days=state.choice([0, state.randrange(40), state.randrange(3000)]))
            end = start + dt.timedelta(days=state.choice([0, 1, 5, 31, 32, 500, 1024, 40000]))
            if state.random() < 0.05:
                end = dt.date(9999, 12, 31)
            out.append((state.choice([1, 1, 1, 2, None]), None if state.random() < 0.03 else start, end, n))
        return out

    a, b = made(), made()
    expected = sorted((x[3], y[3]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] and y[1] and x[1] <= y[2] and y[1] <= x[2])
    left, right = (spark.createDataFrame(x, "id int, start_date date, end_date date, n int") for x in (a, b))
    found = O.overlap_join(left, right, "id", min_rows=min_rows)
    assert sorted((r["n"], r["right_n"]) for r in found.collect()) == expected


def test_partners_of_a_common_person(spark):
    """Roles are the same rows whether or not the person's spells are cut into tiles."""
    spells = spells_of(spark, 400, 9).unionByName(spells_of(spark, 5, 40, key=2)).withColumnRenamed("n", "code")
    partners = spells_of(spark, 300, 20, 500).unionByName(spells_of(spark, 3, 900, key=3))
    partners = partners.withColumn("n", F.col("n") % 7 + 10).withColumnRenamed("n", "other")
    plain = S.classify_roles(spells, partners, "id", "other")
    assert plain.count() > 400 and rows(S.classify_roles(spells, partners, "id", "other", min_rows=20)) == rows(plain)


def test_block_join_cuts_both_sides(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("a")).filter("k < 2 OR a < 9")
    right = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").alias("b")).unionByName(
        spark.range(5).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("b"))
    )
    ours, theirs = skew.in_blocks(left, right, ["k"], 200)
    by = ["k", *skew.PARTS]
    assert largest(ours, by) < 100 and largest(theirs, by) < 100
    found = skew.block_join(left, right, ["k"], 200)
    assert found.columns == ["k", "a", "b"]
    assert found.count() == found.distinct().count() == left.join(right, "k").count() == 2 * 1000 * 1000
    assert skew.block_join(left.limit(0), right, ["k"], 2).isEmpty()


def family(table, children, parent=900):
    people = [(i, parent, 901 if i % 2 else None, "2010-05-01" if i % 4 == 0 else None) for i in range(children)]
    people += [(parent, None, None, "2011-01-01"), (901, None, None, None), (902, 903, 903, None)]
    return table("id int, p1 int, p2 int, died date", *people)


def test_siblings_in_blocks(spark, table):
    """A parent of many children: the pairs of a plain join, and no task with all children."""
    people, unions = family(table, 120), table("a int, b int", (900, 901), (900, 900))
    args = (people, unions, "id", "p1", "p2", "died", "a", "b")
    plain = S.relative_events(*args)
    lost = people.filter("died IS NOT NULL")
    expected = lost.alias("d").join(people.alias("c"), F.expr("d.p1 = c.p1 AND d.id <> c.id")).count()
    assert plain.filter("relationship = 'sibling'").count() == expected + lost.filter("p2 = 901").count() * 59
    cut = S.relative_events(*args, min_rows=8)
    assert rows(cut) == rows(plain)
    kin = S.stack_roles(people.select("id", "p1", "p2"), ["p1", "p2"], "parent")
    ours, theirs = skew.in_blocks(kin.filter("id % 4 = 0").select("parent"), kin.select("id", "parent"), ["parent"], 8)
    assert largest(theirs, ["parent", *skew.PARTS]) < 12 and largest(ours, ["parent", *skew.PARTS]) < 12


def test_placeholder_parents_have_no_children(spark, table):
    people, unions = family(table, 8), table("a int, b int", (900, 901), (3, 4))
    args = (people, unions, "id", "p1", "p2", "died", "a", "b")
    found = S.relative_events(*args, placeholders=[900])
    assert {r.relationship for r in found.collect()} == {"spouse"}
    assert rows(found) == [(3, "2010-05-01", "spouse", 4)]
    assert rows(S.relative_events(*args, placeholders=[12345])) == rows(S.relative_events(*args))


def test_balances_of_a_common_day(spark, every_partition):
    """Very many rows of one key on one day share its balance and are spread over partitions."""
    same = spark.range(N).select(F.lit(1).alias("k"), F.lit(FIRST).alias("day"), F.lit(1.0).alias("x"), F.col("id").alias("n"))
    other = spark.range(100).select((F.col("id") % 5).cast("int").alias("k"), F.date_add(F.lit(FIRST), (F.col("id") % 9).cast("int")).alias("day"),
                                    F.lit(2.0).alias("x"), (F.col("id") + N).alias("n"))
    df = same.unionByName(other).unionByName(same.limit(3).withColumn("k", F.lit(None).cast("int")))
    plain, cut = L.running_balance(df, "k", "day", ["x"]), L.running_balance(df, "k", "day", ["x"], min_rows=1000)
    assert rows(cut.filter(f"n >= {N} OR n < 50")) == rows(plain.filter(f"n >= {N} OR n < 50"))
    assert cut.count() == df.count() and cut.columns == [*df.columns, "balance"]
    placed = cut.filter(f"k = 1 AND n < {N}").groupBy(F.spark_partition_id()).count()
    assert placed.count() >= 3 and cut.filter(f"k = 1 AND n < {N}").select("balance").distinct().count() == 1


def test_few_codes_over_many_rows(spark, table, every_partition):
    """Ten codes, and missing ones, spread over tasks where the code table is too long to broadcast."""
    df = spark.range(N).select(
        F.when(F.col("id") % 11 < 10, F.col("id") % 11).cast("int").alias("code"),
        F.when(F.col("id") % 2 == 0, "x").alias("extra"),
        F.date_add(F.lit(FIRST), (F.col("id") % 1000).cast("int")).alias("at"), F.col("id").alias("n"),
    )
    codes = table("c int, e string, f date, t date, level string",
                  *[(c, e, f, t, f"{c}{e}{f[:4]}") for c in range(9) for e in (None, "x", "y")
                    for f, t in (("2001-01-01", "2001-12-31"), ("2002-01-01", "2002-06-30"))])
    args = (codes, ("code", "c"), ("extra", "e"), "at", "f", "t")
    plain = S.lookup_valid_at(df, *args)
    assert plain.count() == N and plain.filter("level IS NOT NULL").count() > N / 3
    cut = S.lookup_valid_at(df, *args, min_rows=100)
    assert rows(cut) == rows(plain)
    of_code = cut.groupBy("code", F.spark_partition_id().alias("p")).count()
    assert of_code.groupBy("code").agg(F.max("count").alias("m")).agg(F.max("m")).first()[0] < N / 11 * 0.6


def test_a_person_common_in_populations_and_measures(spark):
    """Very many periods of one person against very many of its spells."""
    period = F.date_add(F.lit(FIRST), (F.col("id") * 10).cast("int"))
    people = spark.range(400).select(F.lit(1).alias("id"), F.lit("all").alias("who"), period.alias("s"), F.date_add(period, 9).alias("e"),
                                     F.col("id").cast("string").alias("p"))
    spec = A.Population("people", A.Col("id"), A.Col("who"), A.Col("s"), A.Col("e"), A.Col("p"))
    days = A.Measure("work", A.Col("id"), A.Col("start_date"), A.Col("end_date"), A.Lit("days"), A.Lit(1), "DURATION", True)
    tables = {"people": people, "work": spells_of(spark, 500, 15, 4000)}
    plain, cut = (A.assemble([spec], [days], tables, min_rows=m) for m in (None, 50))
    assert plain.count() > 300 and rows(cut) == rows(plain)

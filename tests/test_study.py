"""Stored steps, the whole run, checks inside writes, measures replaced one by one."""

import datetime as dt
import glob
import os
import threading

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanwise.operators import overlap as O
from spanwise.operators import spells as S
from spanwise.plans import assembly as A
from spanwise.plans import study as T
from spanwise.plans import tabulate as G
from spanwise.plans.tidy import TidyNames
from spanwise.sources import tables as IO

FIRST = dt.date(2001, 1, 1)


def spells_of(spark, n, length):
    start = F.date_add(F.lit(FIRST), (F.col("id") * 7919 % 3000).cast("int"))
    return spark.range(n).select(
        (F.col("id") % 50).alias("id"), start.alias("start_date"), F.date_add(start, length).alias("end_date"), F.col("id").alias("n")
    )


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_steps_in_buckets_need_no_exchange(spark, no_broadcast):
    """Condense, invert, intersect and assemble on tables stored by person: every row stays where it is."""
    with IO.Steps(spark, 4) as steps:
        spells, others = (steps.keep(spells_of(spark, 900, d), name, "id") for name, d in (("spell", 9), ("other", 200)))
        free = S.invert_spells(S.condense_spells(spells, "id"), "id")
        met = O.intersect_spells(free, others, "id", spread=False)
        people = steps.keep(spells.select("id").distinct(), "people", "id")
        spec = A.Population("people", A.Col("id"), A.Lit("all"), A.Lit("2002-01-01"), A.Lit("2004-12-31"), A.Lit("p"))
        days = A.Measure("met", A.Col("id"), A.Col("start_date"), A.Col("end_date"), A.Lit("days"), A.Lit(1), "DURATION", True)
        wide = A.assemble([spec], [days], {"people": people, "met": met}, spread=False)
        assert exchanges(free) == exchanges(met) == exchanges(wide) == 0
        plain = spells_of(spark, 900, 9), spells_of(spark, 900, 200)
        again = O.intersect_spells(S.invert_spells(S.condense_spells(plain[0], "id"), "id"), plain[1], "id")
        assert exchanges(again) > 2 and rows(again) == rows(met)
        assert rows(A.assemble([spec], [days], {"people": people, "met": again})) == rows(wide)


def test_steps_leave_nothing_behind(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ZeroDivisionError), IO.Steps(spark, 2) as steps:
        steps.keep(spark.range(5), "kept", "id")
        steps.keep(spark.range(5), "plain")
        folder = spark.sql(f"DESCRIBE DATABASE {steps.database}").filter("info_name = 'Location'").first()[1].removeprefix("file:")
        assert folder.startswith(root) and len(os.listdir(folder)) == 2
        1 / 0
    assert not spark.catalog.databaseExists(steps.database) and not os.path.exists(folder)


def test_only_shared_steps_are_stored(spark):
    made = []

    def step(name, *reads):
        def make(*tables):
            made.append(name)
            return tables[0].withColumn(name, F.lit(len(tables)))

        return T.Step(make, reads)

    plan = {"shared": step("shared", "raw"), "a": step("a", "shared", "raw"), "b": step("b", "shared"), "alone": step("alone", "raw"),
            "unused": step("unused", "raw"), "x": step("x", "y"), "y": step("y", "x")}
    raw = spark.range(9).withColumnRenamed("id", T.ID)
    with IO.Steps(spark, 2) as steps:
        found = T.tables_of(["a", "b", "alone", "raw", "alone"], {"raw": raw}, plan, steps)
        kept = {t.name for t in spark.catalog.listTables(steps.database)}
        assert found["a"].count() == 9 and set(found["b"].columns) == {T.ID, "shared", "b"}
        assert kept == {"shared", "alone"} and sorted(made) == ["a", "alone", "b", "shared"]
        with pytest.raises(ValueError, match="x > y > x"):
            T.tables_of(["x"], {"raw": raw}, plan, steps)
        with pytest.raises(ValueError, match="no step or source table named other"):
            T.tables_of(["other"], {"raw": raw}, plan, steps)


def test_steps_are_stored_side_by_side(spark):
    """Two steps that each wait for the other one to begin end all the same; one that reads both follows them."""
    met = threading.Barrier(2, timeout=60)

    def wait(df):
        met.wait()
        return df

    plan = {"a": T.Step(wait, ("raw",)), "b": T.Step(wait, ("raw",)), "both": T.Step(lambda a, b: a.unionByName(b), ("a", "b"))}
    raw = spark.range(9).withColumnRenamed("id", T.ID)
    with IO.Steps(spark, 2) as steps:
        found = T.tables_of(["a", "b", "both", "both"], {"raw": raw}, plan, steps)
        assert found["both"].count() == 18
        plan["a"] = T.Step(lambda df: 1 / 0, ("raw",))
        with pytest.raises(ZeroDivisionError):
            T.tables_of(["a", "a", "both", "both"], {"raw": raw}, {**plan, "b": T.Step(lambda df: df, ("raw",))}, steps)


def test_only_common_persons_are_counted(spark, monkeypatch):
    """Rows of persons are counted for tables that are large enough for a common one, with the same result."""
    spec = A.Population("people", A.Col("id"), A.Lit("all"), A.Lit("2002-01-01"), A.Lit("2004-12-31"), A.Lit("p"))
    days = [A.Measure(t, A.Col("id"), A.Col("start_date"), A.Col("end_date"), A.Lit(t), A.Lit(1), "DURATION", True) for t in ("few", "many")]
    tables = {"people": spark.range(40), "few": spells_of(spark, 59, 9), "many": spells_of(spark, 60, 20)}
    monkeypatch.setattr(T, "HOT_ROWS", 100)
    assert T.common_in(tables, [spec]) == {"many"}
    part, whole, none = (A.assemble([spec], days, tables, min_rows=2, spread=s) for s in ({"many"}, True, False))
    assert exchanges(none) < exchanges(part) < exchanges(whole)
    assert rows(part) == rows(whole) == rows(none)


def test_large_tables_without_a_common_person_are_not_spread(spark, monkeypatch):
    """A table may have many rows and no person with many; only one that has is spread. Rows without a person are none's."""
    spec = A.Population("people", A.Col(T.ID), A.Lit("all"), A.Lit("2002-01-01"), A.Lit("2004-12-31"), A.Lit("p"))
    one = F.when(F.col("id") < 98, F.lit(1)).otherwise(F.col("id"))
    none = F.when(F.col("id") % 2 == 0, F.col("id"))
    numbers = spark.range(400)
    tables = {"people": spark.range(120).union(spark.range(3)).toDF(T.ID), "flat": numbers.toDF(T.ID),
              "steep": numbers.select(one.alias(T.ID)), "gaps": numbers.select(none.alias(T.ID)), "empty": numbers.limit(0).toDF(T.ID)}
    monkeypatch.setattr(T, "HOT_ROWS", 100)
    large = T.common_in(tables, [spec])
    assert large == set(tables)
    assert T.with_common_person(tables, sorted(large - {"people"}), [spec]) == {"steep"}
    assert T.with_common_person(tables, [], [spec]) == set()
    asked, known = [], A.assemble
    monkeypatch.setattr(T, "assemble", lambda *args, spread, **kw: asked.append(spread) or known(*args, spread=spread, **kw))
    monkeypatch.setattr(T, "measures_of", lambda *_: [A.Measure(t, A.Col(T.ID), A.Lit("2002-01-01"), A.Lit("2002-02-01"), A.Lit(t), A.Lit(1), "COUNT") for t in ("flat", "steep")])
    with IO.Steps(spark, 2) as steps:
        T.wide_table(spark, tables, [spec], T.Study(), steps)
    assert asked == [{"steep"}]


def test_every_column_of_the_tidy_step_is_named():
    """The wide table has what the tidy step reads, and each measure of the study has a column or a step to come from."""
    names, study = TidyNames(), T.Study()
    columns, steps = T.wide_columns(names), T.steps_of(study)
    measures = T.measures_of(study, names)
    fixed = {m.label.value for m in measures if m.summary != "HISTOGRAM"}
    assert fixed <= set(columns) and len(columns) == len(set(columns))
    assert {m.label.value for m in measures} - fixed == {"ben_type", "area_type", "region_code"}
    assert {m.table for m in measures} <= {*steps, "persons"}
    without = set(columns) - fixed - {c for c in columns if c.split("=")[0] in ("ben_type", "area_type", "region_code")}
    assert without == {"sex_code=1", "sex_code=2", "eth_asian", "eth_european", "eth_maori", "eth_pacific", "eth_other", "eth_MELAA"}


SPELL = "id long, start_date date, end_date date, v double"


def setup(table, *more):
    people = table("id long", (1,), (2,))
    spells = table(SPELL, (1, "2001-01-01", "2001-01-10", 2.0), (1, "2001-03-01", "2001-03-05", 3.0), (2, "2001-02-01", "2001-02-02", 5.0), *more)
    spec = A.Population("people", A.Col("id"), A.Lit("all"), A.Lit("2001-01-01"), A.Lit("2001-12-31"), A.Lit("2001"))

    def measure(label, summary):
        return A.Measure("spell", A.Col("id"), A.Col("start_date"), A.Col("end_date"), A.Lit(label), A.Col("v"), summary)

    return spec, measure, {"people": people, "spell": spells}


def values(df):
    return rows(df, "identity_column", "label_measure", "value_measure")


def test_one_measure_is_replaced(spark, table, tmp_path):
    spec, measure, tables = setup(table)
    total, count, top = measure("total", "SUM"), measure("spells", "COUNT"), measure("top", "MAX")
    output = str(tmp_path / "long")
    first = A.replace_measures(spark, [spec], [total, count], output, tables)
    assert values(first) == [(1, "spells", 2.0), (1, "total", 5.0), (2, "spells", 1.0), (2, "total", 5.0)]
    untouched = {f: os.path.getmtime(f) for f in glob.glob(f"{output}/*/*COUNT*/*.parquet")}
    less = {**tables, "spell": tables["spell"].filter("id = 1")}
    again = A.replace_measures(spark, [spec], [total, top], output, less)
    assert values(again) == [(1, "spells", 2.0), (1, "top", 3.0), (1, "total", 5.0), (2, "spells", 1.0)]
    assert untouched == {f: os.path.getmtime(f) for f in glob.glob(f"{output}/*/*COUNT*/*.parquet")} and untouched
    nothing = {**tables, "spell": tables["spell"].limit(0)}
    assert values(A.replace_measures(spark, [spec], [total, measure("new", "MIN")], output, nothing)) == [
        (1, "spells", 2.0), (1, "top", 3.0), (2, "spells", 1.0)]
    assert values(A.replace_measures(spark, [spec], [total], output, tables))[-1] == (2, "total", 5.0)
    with pytest.raises(ValueError, match="the same"):
        A.replace_measures(spark, [spec], [total, total], output, tables)
    with pytest.raises(ValueError, match="path"):
        A.replace_measures(spark, [spec], [total], "a_table", tables)


def test_missing_labels_stop_the_write(spark, table, tmp_path):
    spec, _, tables = setup(table)
    named_by = A.Measure("spell", A.Col("id"), A.Col("start_date"), A.Col("end_date"), A.Col("kind"), A.Lit(1), "COUNT")
    tables = {**tables, "spell": tables["spell"].withColumn("kind", F.when(F.col("v") < 5, "x"))}
    output = str(tmp_path / "out")
    with pytest.raises(PySparkException, match="label_measure is missing"):
        A.run_assembly(spark, [spec], [named_by], output, tables)
    assert not A._exists(spark, output)
    kept = {**tables, "spell": tables["spell"].filter("kind IS NOT NULL")}
    assert values(A.run_assembly(spark, [spec], [named_by], output, kept)) == [(1, "x", 2.0)]


def test_figures_come_out_of_the_write(spark, tmp_path):
    """One scan gives the stored rows and the figures."""
    scanned = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(seen, "id long").withColumn("v", F.when(F.col("id") % 4 > 0, F.col("id")))
    metrics = {"n": F.count(F.lit(1)), "none": F.count_if(F.col("v").isNull()), "top": F.max("v")}
    stored, found = IO.write_observed(df, str(tmp_path / "t"), metrics)
    assert found == {"n": 100, "none": 25, "top": 99} and stored.count() == 100 and scanned.value == 100


def test_seventy_groups_share_one_plan(spark):
    """Membership takes two numbers; the result equals that of a joined membership table."""
    flags = [f"g{i}" for i in range(70)]
    wide = spark.range(300).select(
        "id", (F.col("id") % 4).cast("string").alias("m"), F.col("id").cast("double").alias("v"),
        *[F.when(F.col("id") % (i + 2) == 0, 1).alias(g) for i, g in enumerate(flags)]
    )
    members = G.group_members(wide, "id", flags)
    assert rows(G.distribution_by_group(wide, flags, "id", ["m"])) == rows(G.distribution_by_group(wide, members, "id", ["m"]))
    assert rows(G.totals_by_group(wide, flags, "id", ["v"])) == rows(G.totals_by_group(wide, members, "id", ["v"]))

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanwise.plans import assembly as A
from spanwise.plans.assembly import Col, Lit, Measure, Population
from spanwise.sources.tables import read_table


@pytest.fixture()
def tables(table):
    return {
        "people": table(
            "id long, p_start date, p_end date, label string",
            (1, "2001-01-06", "2001-12-31", "first"),
            (1, "2002-01-01", "2002-12-31", "second"),
            (2, "2001-01-06", "2001-12-31", "first"),
            (3, "2001-01-06", "2001-12-31", "first"),
        ),
        "payment": table(
            "id long, start_date date, end_date date, amount double, kind string, flag boolean",
            (1, "2001-01-01", "2001-01-10", 100.0, "a", True),
            (1, "2001-12-30", "2002-01-02", 40.0, None, False),
            (2, "2001-03-01", "9999-01-01", None, "b", True),
            (3, "2005-01-01", "2005-02-01", 7.0, "c", True),
            (9, "2001-03-01", "2001-04-01", 7.0, "c", True),
        ),
    }


PEOPLE = Population("people", Col("id"), Lit("person"), Col("p_start"), Col("p_end"), Col("label"))


def measure(summary, value="amount", proportional=False, label=Lit("m")):
    given = value if isinstance(value, Lit) else Col(value)
    return Measure("payment", Col("id"), Col("start_date"), Col("end_date"), label, given, summary, proportional)


def values(df):
    return rows(df, "identity_column", "label_summary_period", "label_measure", "value_measure")


OPEN_DAYS = float((dt.date(9999, 1, 1) - dt.date(2001, 3, 1)).days + 1)
PERIOD_DAYS = float((dt.date(2001, 12, 31) - dt.date(2001, 3, 1)).days + 1)

CASES = [
    ("SUM", "amount", False, 140.0, 40.0, None),
    ("SUM", "amount", True, 50.0 + 20.0, 20.0, None),
    ("sum", "flag", False, 1.0, 0.0, 1.0),
    ("COUNT", "amount", False, 2.0, 1.0, 0.0),
    ("COUNT", Lit(1), False, 2.0, 1.0, 1.0),
    ("EXISTS", "amount", False, 1.0, 1.0, 0.0),
    ("MIN", "amount", False, 40.0, 40.0, None),
    ("MIN", "amount", "t", 20.0, 20.0, None),
    ("MAX", "amount", False, 100.0, 40.0, None),
    ("MAX", "amount", "true", 50.0, 20.0, None),
    ("MEAN", "amount", "F", 70.0, 40.0, None),
    ("DISTINCT", "kind", False, 1.0, 0.0, 1.0),
    ("DURATION", "amount", False, 14.0, 4.0, OPEN_DAYS),
    ("DURATION", "amount", True, 7.0, 2.0, PERIOD_DAYS),
]


@pytest.mark.parametrize("min_rows", [None, 1])
def test_every_summary(tables, min_rows):
    """All summaries in one run, so that they share joins and aggregations, and each as worked out by hand."""
    measures = [measure(s, v, p, Lit(f"m{i}")) for i, (s, v, p, *_) in enumerate(CASES)]
    expected = []
    for i, (*_, first, second, other) in enumerate(CASES):
        expected += [(1, "first", f"m{i}", first), (1, "second", f"m{i}", second), (2, "first", f"m{i}", other)]
    found = A.assemble([PEOPLE], measures, tables, min_rows=min_rows)
    assert values(found) == sorted(expected, key=repr)
    assert found.columns == list(A.RESULT_COLUMNS)


def test_histogram_and_label_from_column(tables):
    found = A.assemble([PEOPLE], [measure("HISTOGRAM", "kind"), measure("SUM", "amount", label=Col("kind"))], tables)
    assert values(found) == sorted(
        [
            (1, "first", "m=a", 1.0), (1, "first", "m=", 0.0), (1, "second", "m=", 0.0), (2, "first", "m=b", 1.0),
            (1, "first", "a", 100.0), (1, "first", None, 40.0), (1, "second", None, 40.0), (2, "first", "b", None),
        ],
        key=repr,
    )


def test_populations_stay_apart(tables):
    whole = Population("people", Col("id"), Lit("all"), Lit("2001-01-01"), Lit("2002-12-31"), Lit("both"))
    found = A.assemble([PEOPLE, whole, whole], [measure("COUNT")], tables)
    both = [v for v in values(found) if v[1] == "both"]
    # Person 1 has two rows in the table, hence two matches per payment, in each of the two runs.
    assert both == [(1, "both", "m", 4.0)] * 2 + [(2, "both", "m", 0.0)] * 2


def test_fixed_periods_reach_the_scan(tables, spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    path = str(tmp_path / "payment")
    tables["payment"].write.parquet(path)
    stored = {**tables, "payment": spark.read.parquet(path)}
    whole = Population("people", Col("id"), Lit("all"), Lit("2001-01-01"), Lit("2002-12-31"), Lit("both"))
    plan = A.assemble([whole], [measure("COUNT")], stored)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "amount" in line)
    assert "GreaterThanOrEqual(end_date,2001-01-01)" in scan and "LessThanOrEqual(start_date,2002-12-31)" in scan
    assert "kind" not in scan


def test_rectangular(tables):
    measures = [measure("SUM", label=Lit("total")), measure("COUNT", label=Lit("how many"))]
    wide = A.rectangular(A.assemble([PEOPLE], measures, tables), "id", A.fixed_labels(measures))
    assert rows(wide, "id", "label_summary_period", "total", "how many") == [(1, "first", 140.0, 2.0), (1, "second", 40.0, 1.0), (2, "first", None, 0.0)]
    assert A.fixed_labels([measure("HISTOGRAM")]) is None


def test_refusals(tables, spark):
    with pytest.raises(ValueError, match="amounts"):
        A.validate([PEOPLE], [measure("SUM", "amounts")], tables)
    with pytest.raises(ValueError, match="numbers"):
        A.validate([PEOPLE], [measure("Mean", "kind")], tables)
    with pytest.raises(ValueError, match="MEDIAN"):
        A.validate([PEOPLE], [measure("MEDIAN")], tables)
    with pytest.raises(ValueError, match="maybe"):
        A.validate([PEOPLE], [measure("SUM", proportional="maybe")], tables)
    with pytest.raises(ValueError, match="nowhere"):
        A.validate([Population("nowhere", *[Lit(1)] * 5)], [measure("SUM")], tables, spark)
    with pytest.warns(UserWarning, match="COUNT"):
        A.validate([PEOPLE], [measure("COUNT", "kind", True)], tables)
    A.validate([PEOPLE], [measure("sum", "flag"), measure("DISTINCT", "kind"), measure("MIN", Lit(1))], tables)


def test_modes(tables, spark, tmp_path):
    out = str(tmp_path / "long")
    once = [measure("COUNT")]
    assert A.run_assembly(spark, [PEOPLE], once, out, tables, checks_only=True) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_table(spark, out)
    assert A.run_assembly(spark, [PEOPLE], once, out, tables).count() == 3
    assert A.run_assembly(spark, [PEOPLE], once, out, tables).count() == 6
    assert A.run_assembly(spark, [PEOPLE], once, out, tables, overwrite=True, development=True).count() == 3
    with pytest.raises(ValueError):
        A.run_assembly(spark, [PEOPLE], [measure("SUM", "kind")], out, tables)


def test_other_output_tables_are_refused(tables, spark, tmp_path):
    once = [measure("COUNT")]
    long = A.assemble([PEOPLE], once, tables)
    wrong = {
        "more": long.withColumn("extra", F.lit(1)),
        "fewer": long.drop("label_identity"),
        "other": long.withColumn("value_measure", F.col("value_measure").cast("string")),
    }
    for name, df in wrong.items():
        out = str(tmp_path / name)
        df.write.parquet(out)
        with pytest.raises(ValueError, match="does not fit"):
            A.run_assembly(spark, [PEOPLE], once, out, tables)
        assert read_table(spark, out).count() == 3
    out = str(tmp_path / "order")
    long.select(*reversed(long.columns)).write.parquet(out)
    assert A.run_assembly(spark, [PEOPLE], once, out, tables).count() == 6


def test_development_rows_per_pair(tables, monkeypatch):
    monkeypatch.setattr(A, "DEV_ROWS", 2)
    found = A.assemble([PEOPLE], [measure("COUNT"), measure("SUM", label=Lit("s"))], tables, development=True)
    assert found.count() == 4


def test_fixed_days_are_compared_as_days():
    from spanwise.functions.dates import literal_day

    periods = [A.Population("t", Col("id"), Lit("x"), Lit(s), Lit(e), Lit(s)) for s, e in (("1998-1-1", "1998-9-30"), ("1998-10-1", "1998-12-31"))]
    assert A._fixed_window(periods) == (dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    for wrong in ("1998-13-1", "soon", None, "1998-1"):
        with pytest.raises(ValueError):
            literal_day(wrong)

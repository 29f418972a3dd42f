import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanwise.functions.dates import parse_quarter_code, quarters_of
from spanwise.operators import ledger as L

LEDGER = "id int, d date, inc double, rep double, off double"
AMOUNTS = ["inc", "rep", "off"]


def test_quarter_codes(table):
    df = table("c string", ("JAN17",), ("APR10",), ("jul18",), ("OCT09",), ("DEC17",), (None,))
    found = rows(df.select("c", parse_quarter_code(F.col("c")).alias("d")))
    assert found == sorted(
        [("APR10", "2010-04-01"), ("DEC17", None), ("JAN17", "2017-01-01"), ("OCT09", "2009-10-01"), ("jul18", "2018-07-01"), (None, None)],
        key=repr,
    )
    assert list(quarters_of(2017, 2018))[3:5] == ["2017Q4", "2018Q1"]
    assert quarters_of(2017)["2017Q4"] == (dt.date(2017, 10, 1), dt.date(2017, 12, 31))


def test_running_balance_shares_the_day(table):
    df = table(LEDGER, (1, "2017-01-01", 40.0, None, None), (1, "2017-01-02", None, -5.0, None), (1, "2017-01-02", 20.0, None, None), (2, "2017-01-01", 7.0, None, -7.0))
    found = L.running_balance(df, "id", "d", AMOUNTS)
    assert rows(found, "id", "d", "balance") == [(1, "2017-01-01", 40.0), (1, "2017-01-02", 55.0), (1, "2017-01-02", 55.0), (2, "2017-01-01", 0.0)]
    daily = L.daily_totals(df, "id", "d", AMOUNTS)
    assert rows(L.running_balance(daily, "id", "d", AMOUNTS, one_per_day=True), "id", "d", "balance") == [(1, "2017-01-01", 40.0), (1, "2017-01-02", 55.0), (2, "2017-01-01", 0.0)]


@pytest.mark.parametrize("how", [{}, {"one_per_day": True}, {"min_rows": 1}])
def test_lift(table, how):
    df = table("id int, n int, b double", (1, 1, 400.0), (1, 2, 100.0), (1, 3, -200.0), (1, 4, -500.0), (2, 1, -10.0), (2, 2, 3.0))
    found = L.lift_negative_cases(df, "id", "b", **how)
    assert rows(found, "id", "n", "balance_lifted") == [(1, 1, 900.0), (1, 2, 600.0), (1, 3, 300.0), (1, 4, 0.0), (2, 1, -10.0), (2, 2, 3.0)]


def test_validity_and_quarters(table):
    df = table("id int, d date, b double", (1, "2017-01-01", 100.0), (1, "2017-07-01", 5.0), (2, "2017-04-01", 50.0))
    valid = L.balance_validity(df, "id", "d", "b")
    assert rows(valid, "id", "d", "end_date", "lag_balance", "lead_date") == [
        (1, "2017-01-01", "2017-06-30", None, "2017-07-01"),
        (1, "2017-07-01", None, 100.0, None),
        (2, "2017-04-01", "9999-01-01", None, None),
    ]
    found = L.balance_at_quarters(valid, "id", "d", "b", quarters_of(2017), prefix="Y")
    assert rows(found) == [(1, 100.0, 100.0, 0.0, 0.0), (2, 0.0, 50.0, 50.0, 50.0)]


def test_cumulative_drops_immaterial(table):
    df = table(LEDGER, (1, "2016-05-01", 100.0, None, None), (1, "2017-05-01", None, -40.0, -10.0), (2, "2017-01-01", 0.5, None, None), (3, "2018-06-01", 9.0, None, None))
    found = L.cumulative_at_quarters(df, "id", "d", AMOUNTS, quarters_of(2017), flows={"new": ("inc", 2017)})
    assert rows(found) == [(1, 100.0, 50.0, 50.0, 50.0, 0.0)]
    assert rows(L.flow_in_year(df, "id", "d", 2017, "inc", "rep")) == [(1, 0.0, -40.0), (2, 0.5, 0.0), (3, 0.0, 0.0)]


def test_case_worked_example(table):
    df = table(
        LEDGER,
        (1, "2017-01-02", 40.0, None, None),
        (1, "2017-01-03", None, -5.0, None),
        (1, "2017-01-04", 20.0, None, None),
        (1, "2017-02-01", None, -20.0, None),
        (1, "2018-03-01", None, -20.0, None),
        (1, "2018-04-01", None, None, -6.0),
    )
    # The first 40 are repaid to within 10 once 30 are paid, all 60 once 50 are.
    assert rows(L.debt_cases(df, "id", "d", *AMOUNTS)) == [(1, "2017-01-02", "2018-03-01"), (1, "2017-01-04", "2018-04-01")]


def brute_cases(ledger, tolerance=10.0):
    out = []
    for person in {r[0] for r in ledger}:
        mine = [r for r in ledger if r[0] == person]
        days = sorted({r[1] for r in mine})
        owed = {d: sum(r[2] or 0 for r in mine if r[1] <= d) for d in days}
        paid = {d: sum((r[3] or 0) + (r[4] or 0) for r in mine if r[1] <= d) for d in days}
        for d in sorted({r[1] for r in mine if r[2] is not None}):
            ends = [p for p in days if p >= d and round(owed[d] + paid[p], 6) <= tolerance]
            out.append((person, d.isoformat(), ends[0].isoformat() if ends else "9999-01-01"))
    return sorted(out, key=repr)


def test_cases_against_all_pairs_with_reversals(spark):
    """Repayments that are taken back, overpayments, and cases closing years later."""
    rng = random.Random(8)
    ledger = []
    for person in range(40):
        for _ in range(rng.randint(1, 30)):
            d = dt.date(2010, 1, 1) + dt.timedelta(days=rng.randint(0, 2500))
            kind = rng.random()
            amount = float(rng.randint(1, 80))
            ledger.append(
                (person, d, amount if kind < 0.4 else None, (amount if kind > 0.9 else -amount) if kind >= 0.4 else None, -5.0 if kind < 0.1 else None)
            )
    found = L.debt_cases(spark.createDataFrame(ledger, LEDGER), "id", "d", *AMOUNTS)
    assert rows(found) == brute_cases(ledger)


def test_duration_link_and_spread(table):
    cases = table("key int, s date, e date", (1, "2010-01-01", "2013-01-01"), (1, "2010-01-01", "9999-01-01"), (2, "2010-01-01", "2010-01-01"), (2, "2010-01-01", None), (3, "2010-01-01", "2010-01-31"))
    assert rows(L.case_duration(cases, "s", "e"), "key", "days_debt", "long_term_debt") == [(1, 1096, 1), (3, 30, 0)]
    spine = table("snz_uid int, key int", (100, 1))
    assert rows(L.link_ids(cases, spine, "key", "snz_uid").select("snz_uid", "key").distinct()) == sorted([(100, 1), (None, 2), (None, 3)], key=repr)
    typed = table("id int, t string, q double", (1, "GST", 5.0), (1, "PAYE", 7.0))
    found = L.spread_by_type(typed, "t", {"GST": "gst", "PAYE": "paye"}, ["q"])
    assert rows(found, "t", "q_gst", "q_paye") == [("GST", 5.0, 0.0), ("PAYE", 0.0, 7.0)]


def test_links_of_common_and_missing_keys(spark, table):
    """Common keys and missing ones are spread over many partitions, and the rows are those of a plain left join."""
    cases = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("key"), F.col("id").alias("n")
    )
    spine = table("key long, snz_uid long", (7, 100), (4, 101), (None, 102))
    plain = cases.join(spine.filter("key IS NOT NULL"), "key", "left").select("snz_uid", "key", "n")
    for common, min_rows in ((True, 10), (True, None), (False, None)):
        linked = L.link_ids(cases, spine, "key", "snz_uid", common, min_rows)
        assert rows(linked) == rows(plain)
    from spanwise.operators.skew import hot_keys, left_lookup

    found = left_lookup(cases, spine.withColumnRenamed("key", "other"), "key", "other", hot_keys(cases, ["key"], 10))
    counts = found.groupBy("snz_uid").count()
    assert {r.snz_uid: r["count"] for r in counts.collect()} == {100: 1001, 101: 1, None: 1998}

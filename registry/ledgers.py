"""Ledgers and debt cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.build import i8, query, r2
from registry.inputs import frame
from spanwise.functions.dates import parse_quarter_code, quarters_of
from spanwise.operators import ledger as L

_KEYS = ["id", "case_id", "tax_type"]
_K = "id, case_id, tax_type"


@query("l1_parse_quarter_code", "SELECT DISTINCT code, d FROM coded_txn", ["coded_txn"])
def _(spark, sf):
    return frame(spark, sf, "coded_txn").select("code", parse_quarter_code(F.col("code")).alias("d")).distinct()


_MOVED = "COALESCE(incurred, 0) + COALESCE(repaid, 0) + COALESCE(written_off, 0)"


@query(
    "l2_running_balance",
    f"""SELECT id, d, {r2('incurred')} AS incurred, {r2('repaid')} AS repaid, {r2('written_off')} AS written_off,
               {r2(f'SUM({_MOVED}) OVER (PARTITION BY id ORDER BY d)')} AS balance FROM ledger""",
    ["ledger"],
)
def _(spark, sf):
    return L.running_balance(frame(spark, sf, "ledger"), "id", "d", ["incurred", "repaid", "written_off"])


_LIFT = f"""low AS (SELECT {_K}, MIN(balance) AS lowest FROM case_balance GROUP BY {_K}),
lifted AS (SELECT b.*, balance + CASE WHEN lowest < -10 THEN -lowest ELSE 0 END AS balance_lifted
           FROM case_balance b JOIN low USING ({_K}))"""


@query(
    "l3_lift_negative_cases",
    _LIFT + f" SELECT {_K}, d, {r2('balance')} AS balance, {r2('balance_lifted')} AS balance_lifted FROM lifted",
    ["case_balance"],
)
def _(spark, sf):
    lifted = L.lift_negative_cases(frame(spark, sf, "case_balance"), _KEYS, "balance", one_per_day=True)
    return lifted.select(*_KEYS, "d", "balance", "balance_lifted")


_VALID = _LIFT + f""", near AS (SELECT *, LEAD(d) OVER w AS lead_date, LAG(d) OVER w AS lag_date,
                LEAD(balance_lifted) OVER w AS lead_balance, LAG(balance_lifted) OVER w AS lag_balance
                FROM lifted WINDOW w AS (PARTITION BY {_K} ORDER BY d)),
valid AS (SELECT *, CASE WHEN ROUND(balance_lifted, 6) > 10 AND lead_date IS NULL THEN DATE '9999-01-01'
                         WHEN ROUND(balance_lifted, 6) > 10 THEN lead_date - 1 END AS end_date FROM near)"""


def _validity(spark, sf):
    lifted = L.lift_negative_cases(frame(spark, sf, "case_balance"), _KEYS, "balance", one_per_day=True)
    # Whole millionths, so that a balance at the floor is the same in both engines.
    lifted = lifted.withColumn("balance_lifted", F.round("balance_lifted", 6))
    return L.balance_validity(lifted, _KEYS, "d", "balance_lifted")


@query(
    "l4_balance_validity",
    _VALID + f""" SELECT {_K}, d, {r2('balance_lifted')} AS balance_lifted, lag_date, lead_date, {r2('lag_balance')} AS lag_balance,
                         {r2('lead_balance')} AS lead_balance, CAST(end_date AS DATE) AS end_date FROM valid""",
    ["case_balance"],
)
def _(spark, sf):
    return _validity(spark, sf).select(
        *_KEYS, "d", "balance_lifted", "lag_date", "lead_date", "lag_balance", "lead_balance", "end_date"
    )


_QUARTERS = quarters_of(2013, 2014)


@query(
    "l5_balance_at_quarters",
    _VALID + " SELECT id, tax_type, " + ", ".join(
        r2(f"SUM(CASE WHEN DATE '{a}' <= end_date AND d <= DATE '{b}' THEN balance_lifted ELSE 0 END)") + f" AS Y{q}"
        for q, (a, b) in _QUARTERS.items()
    ) + f""", {r2('SUM(CASE WHEN year(d) = 2014 THEN assessment ELSE 0 END)')} AS incurred,
            {r2('SUM(CASE WHEN year(d) = 2014 THEN payment ELSE 0 END)')} AS repaid FROM valid GROUP BY id, tax_type""",
    ["case_balance"],
)
def _(spark, sf):
    return L.balance_at_quarters(
        _validity(spark, sf), ["id", "tax_type"], "d", "balance_lifted", _QUARTERS, prefix="Y",
        flows={"incurred": ("assessment", 2014), "repaid": ("payment", 2014)},
    )


_LEDGER_QUARTERS = quarters_of(1998, 1999)
_TOTALS = {q: f"SUM(CASE WHEN d <= DATE '{b}' THEN {_MOVED} ELSE 0 END)" for q, (_, b) in _LEDGER_QUARTERS.items()}


@query(
    "l6_cumulative_at_quarters",
    "SELECT id, " + ", ".join(f"{r2(s)} AS value_{q}" for q, s in _TOTALS.items())
    + " FROM ledger GROUP BY id HAVING " + " OR ".join(f"ABS({s}) >= 1" for s in _TOTALS.values()),
    ["ledger"],
)
def _(spark, sf):
    return L.cumulative_at_quarters(
        frame(spark, sf, "ledger"), "id", "d", ["incurred", "repaid", "written_off"], _LEDGER_QUARTERS
    )


@query(
    "l7_flow_in_year",
    f"""SELECT id, {r2('SUM(CASE WHEN year(d) = 1999 THEN COALESCE(incurred, 0) ELSE 0 END)')} AS incurred_1999,
               {r2('SUM(CASE WHEN year(d) = 1999 THEN COALESCE(repaid, 0) ELSE 0 END)')} AS repaid_1999 FROM ledger GROUP BY id""",
    ["ledger"],
)
def _(spark, sf):
    return L.flow_in_year(frame(spark, sf, "ledger"), "id", "d", 1999, "incurred", "repaid")


def cases_sql(ledger: str, key: str, day: str, incurred: str, repaid: str, written_off: str) -> str:
    """SQL parts that end in `debt_case`: every opening day against every later day of the person."""
    return f"""
per_day AS (SELECT {key} AS id, {day} AS d, SUM(COALESCE({incurred}, 0)) AS owed,
                   SUM(COALESCE({repaid}, 0) + COALESCE({written_off}, 0)) AS paid, COUNT({incurred}) AS news
            FROM {ledger} GROUP BY {key}, {day}),
so_far AS (SELECT id, d, news, SUM(owed) OVER w AS owed, SUM(paid) OVER w AS paid FROM per_day
           WINDOW w AS (PARTITION BY id ORDER BY d)),
debt_case AS (SELECT a.id, a.d AS debt_start_date, COALESCE(MIN(b.d), DATE '9999-01-01') AS debt_end_date
              FROM so_far a LEFT JOIN so_far b ON a.id = b.id AND a.d <= b.d AND ROUND(a.owed + b.paid, 6) <= 10
              WHERE a.news > 0 GROUP BY a.id, a.d)"""


@query(
    "l8_debt_cases",
    cases_sql("ledger", "id", "d", "incurred", "repaid", "written_off")
    + " SELECT id, debt_start_date, debt_end_date FROM debt_case",
    ["ledger"],
)
def _(spark, sf):
    return L.debt_cases(frame(spark, sf, "ledger"), "id", "d", "incurred", "repaid", "written_off")


_DURATION = f"""SELECT snz_ird_uid, dbt_date_begin, dbt_date_end, {i8('dbt_date_end - dbt_date_begin')} AS days_debt,
       {i8('CASE WHEN dbt_date_end - dbt_date_begin > 1000 THEN 1 ELSE 0 END')} AS long_term_debt
       FROM assessed_cases WHERE year(dbt_date_end) < 9999 AND dbt_date_begin <> dbt_date_end"""


@query("l9_case_duration", _DURATION, ["assessed_cases"])
def _(spark, sf):
    return L.case_duration(frame(spark, sf, "assessed_cases"), "dbt_date_begin", "dbt_date_end")


@query(
    "l10_link_ids",
    """SELECT (SELECT MAX(c.snz_uid) FROM concordance c WHERE c.snz_ird_uid = a.snz_ird_uid) AS snz_uid,
              snz_ird_uid, dbt_date_begin, dbt_date_end FROM assessed_cases a""",
    ["assessed_cases", "concordance"],
)
def _(spark, sf):
    return L.link_ids(frame(spark, sf, "assessed_cases"), frame(spark, sf, "concordance"), "snz_ird_uid", "snz_uid")


@query(
    "l11_spread_by_type",
    "SELECT id, case_id, tax_type, d, " + f"{r2('delta')} AS delta, {r2('payment')} AS payment, " + ", ".join(
        r2(f"CASE WHEN tax_type = '{t}' THEN {v} ELSE 0 END") + f" AS {v}_{n}"
        for t, n in (("O", "open"), ("F", "final")) for v in ("delta", "payment")
    ) + " FROM case_quarter",
    ["case_quarter"],
)
def _(spark, sf):
    rows = frame(spark, sf, "case_quarter").drop("assessment")
    return L.spread_by_type(rows, "tax_type", {"O": "open", "F": "final"}, ["delta", "payment"])

"""Assembly of populations and measures."""

from __future__ import annotations

from registry.build import query, r2
from registry.inputs import frame
from spanwise.plans import assembly as A
from spanwise.plans.assembly import Col, Lit, Measure, Population
from spanwise.sources.tables import read_table, scratch_path

PEOPLE = Population("population", Col("id"), Col("segment"), Col("period_start"), Col("period_end"), Col("period"))
# A second population of the same people with one fixed period and fixed labels.
WHOLE = Population("population", Col("id"), Lit("all"), Lit("1998-01-01"), Lit("1999-12-31"), Col("period"))


def spell_measure(label: str, summary: str, value: str = "v", proportional: bool | str = False) -> Measure:
    return Measure("spell", Col("id"), Col("start_date"), Col("end_date"), Lit(label), Col(value), summary, proportional)


def _tables(spark, sf):
    return {name: frame(spark, sf, name) for name in ("population", "spell", "partner")}


_SHARE = """((LEAST(m.end_date, p.period_end) - GREATEST(m.start_date, p.period_start) + 1) * 1.0
            / (m.end_date - m.start_date + 1))"""
_OVERLAP = "(LEAST(m.end_date, p.period_end) - GREATEST(m.start_date, p.period_start) + 1)"
_FROM = """FROM population p JOIN {table} m ON p.id = m.id AND p.period_start <= m.end_date AND m.start_date <= p.period_end
           GROUP BY p.id, p.segment, p.period_start, p.period_end, p.period"""


def measure_sql(label: str, value: str, table: str = "spell", more: str = "") -> str:
    """One measure of one population, as its own query."""
    return f"""SELECT p.id AS identity_column, p.segment AS label_identity, p.period_start AS summary_period_start_date,
        p.period_end AS summary_period_end_date, p.period AS label_summary_period, {label} AS label_measure,
        {r2(value)} AS value_measure {_FROM.format(table=table)}{more}"""


def _single(name: str, kind: str, value_sql: str, column: str = "v", proportional: bool | str = False) -> None:
    @query(name, measure_sql("'m'", value_sql), ["population", "spell"])
    def _(spark, sf):
        return A.assemble([PEOPLE], [spell_measure("m", kind, column, proportional)], _tables(spark, sf))


_single("a2_sum", "SUM", "SUM(m.v)")
_single("a3_count", "COUNT", "COUNT(m.v)")
_single("a4_exists", "EXISTS", "CASE WHEN COUNT(m.v) >= 1 THEN 1 ELSE 0 END")
_single("a5_min", "MIN", "MIN(m.v)")
_single("a6_max", "MAX", "MAX(m.v)")
_single("a7_mean", "MEAN", "AVG(m.v)")
_single("a8_distinct", "DISTINCT", "COUNT(DISTINCT m.code)", "code")
_single("a9_duration", "DURATION", "SUM(m.end_date - m.start_date + 1)")
_single("a9_duration_in_period", "DURATION", f"SUM({_OVERLAP})", proportional="t")
_single("a11_proportional_sum", "SUM", f"SUM({_SHARE} * m.v)", proportional="true")
_single("a11_proportional_min", "MIN", f"MIN({_SHARE} * m.v)", proportional=True)
_single("a11_proportional_max", "MAX", f"MAX({_SHARE} * m.v)", proportional=True)
_single("a11_proportional_mean", "MEAN", f"AVG({_SHARE} * m.v)", proportional=True)


@query(
    "a10_histogram",
    measure_sql("CONCAT('kind=', COALESCE(m.extra, ''))", "COUNT(m.extra)", "coded_spell", ", m.extra"),
    ["population", "coded_spell"],
)
def _(spark, sf):
    tables = {"population": frame(spark, sf, "population"), "coded_spell": frame(spark, sf, "coded_spell")}
    kinds = Measure(
        "coded_spell", Col("id"), Col("start_date"), Col("end_date"), Lit("kind"), Col("extra"), "HISTOGRAM"
    )
    return A.assemble([PEOPLE], [kinds], tables)


MEASURES = [
    spell_measure("spells", "COUNT"),
    spell_measure("total", "SUM"),
    spell_measure("share", "SUM", proportional=True),
    spell_measure("kinds", "DISTINCT", "code"),
    spell_measure("days", "DURATION", proportional=True),
    spell_measure("code", "HISTOGRAM", "code"),
    Measure("spell", Col("id"), Col("start_date"), Col("end_date"), Col("code"), Lit(1), "EXISTS"),
    Measure("partner", Col("id"), Col("start_date"), Col("end_date"), Lit("partners"), Col("partner_id"), "DISTINCT"),
]


def _union(population: str) -> str:
    parts = [
        measure_sql("'spells'", "COUNT(m.v)"),
        measure_sql("'total'", "SUM(m.v)"),
        measure_sql("'share'", f"SUM({_SHARE} * m.v)"),
        measure_sql("'kinds'", "COUNT(DISTINCT m.code)"),
        measure_sql("'days'", f"SUM({_OVERLAP})"),
        measure_sql("CONCAT('code=', m.code)", "COUNT(m.code)", more=", m.code"),
        measure_sql("m.code", "1", more=", m.code"),
        measure_sql("'partners'", "COUNT(DISTINCT m.partner_id)", "partner"),
    ]
    return " UNION ALL ".join(p.replace("FROM population p", f"FROM {population} p") for p in parts)


@query(
    "a1_assemble",
    "whole AS (SELECT id, 'all' AS segment, DATE '1998-01-01' AS period_start, DATE '1999-12-31' AS period_end, period FROM population) "
    + _union("population") + " UNION ALL " + _union("whole"),
    ["population", "spell", "partner"],
)
def _(spark, sf):
    tables = _tables(spark, sf)
    A.validate([PEOPLE, WHOLE], MEASURES, tables)
    return A.assemble([PEOPLE, WHOLE], MEASURES, tables)


# As text, the second period would end before the first one begins.
_TWO_PERIODS = [
    Population("population", Col("id"), Lit("fixed"), Lit(start), Lit(end), Lit(name))
    for start, end, name in (("1998-1-1", "1998-9-30", "early"), ("1998-10-1", "1998-12-31", "late"))
]
_EARLY, _LATE = (
    f"SELECT DISTINCT id, 'fixed' AS segment, DATE '{start}' AS period_start, DATE '{end}' AS period_end, '{name}' AS period FROM population"
    for start, end, name in (("1998-01-01", "1998-09-30", "early"), ("1998-10-01", "1998-12-31", "late"))
)


@query(
    "a1_two_fixed_periods",
    f"early AS ({_EARLY}), late AS ({_LATE}) "
    + " UNION ALL ".join(measure_sql("'days'", f"SUM({_OVERLAP})").replace("FROM population p", f"FROM {p} p") for p in ("early", "late")),
    ["population", "spell"],
)
def _(spark, sf):
    people = frame(spark, sf, "population").select("id").distinct()
    tables = {"population": people, "spell": frame(spark, sf, "spell")}
    return A.assemble(_TWO_PERIODS, [spell_measure("days", "DURATION", proportional=True)], tables)


_WIDE = [spell_measure("spells", "COUNT"), spell_measure("total", "SUM"), spell_measure("days", "DURATION", proportional=True)]


@query(
    "a12_run_assembly_append",
    " UNION ALL ".join([measure_sql("'spells'", "COUNT(m.v)"), measure_sql("'total'", "SUM(m.v)"),
                        measure_sql("'days'", f"SUM({_OVERLAP})")] * 2),
    ["population", "spell"],
)
def _(spark, sf):
    tables = _tables(spark, sf)
    output = scratch_path(spark, "long")
    assert A.run_assembly(spark, [PEOPLE], _WIDE, output, tables, checks_only=True) is None
    A.run_assembly(spark, [PEOPLE], _WIDE, output, tables)
    A.run_assembly(spark, [PEOPLE], _WIDE, output, tables, skip_checks=True)
    return read_table(spark, output)


@query(
    "a12_run_assembly_development",
    measure_sql("'spells'", "COUNT(m.v)") + """ QUALIFY ROW_NUMBER() OVER (ORDER BY p.id, p.segment, p.period_start) <= 1000""",
    ["population", "spell"],
)
def _(spark, sf):
    tables = _tables(spark, sf)
    output = scratch_path(spark, "long")
    A.run_assembly(spark, [PEOPLE], _WIDE[:1], output, tables)
    return A.run_assembly(spark, [PEOPLE], _WIDE[:1], output, tables, overwrite=True, development=True)


@query(
    "a13_rectangular",
    f"""SELECT p.id, p.segment AS label_identity, p.period_start AS summary_period_start_date,
        p.period_end AS summary_period_end_date, p.period AS label_summary_period, {r2('COUNT(m.v)')} AS spells,
        {r2('SUM(m.v)')} AS total, {r2(f'SUM({_OVERLAP})')} AS days {_FROM.format(table='spell')}""",
    ["population", "spell"],
)
def _(spark, sf):
    tables = _tables(spark, sf)
    return A.rectangular(A.assemble([PEOPLE], _WIDE, tables), "id", A.fixed_labels(_WIDE))

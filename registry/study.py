"""Whole runs: source tables to group tables, stored steps, checks inside a write, measures replaced one by one.

The twin of the whole run puts the twins of the single measures together. What they are
summarised to and called is written out here, so that it does not depend on the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.assembly import PEOPLE, measure_sql, spell_measure
from registry.build import ORACLES, one_row, query, r2, sweep
from registry.inputs import frame
from registry.measures import _DIED
from registry.tables import _IN_GROUPS, _REPORT_SUMMED, _TIDY_PLAIN, _quoted
from spanwise.operators import overlap as O
from spanwise.operators import spells as S
from spanwise.plans import assembly as A
from spanwise.plans.study import Study, fixed_population, run_study, steps_of
from spanwise.sources import tables as IO

# The test data has residents of 1998 and addresses up to 2000; all else lies about 2018.
_STUDY = Study(year=2018, resident_year=1998, address_day="2000-06-30")
_PS, _PE = "DATE '2018-01-01'", "DATE '2018-12-31'"

# For the whole run, people keep their number in both agencies, and incomes lie in the study's year too.
_CHANGED = {
    "c_custkey + 500000 AS snz_uid": "c_custkey AS snz_uid",
    "year(o_orderdate) AS inc_tax_yr_sum_year_nbr": "year(o_orderdate) + 20 AS inc_tax_yr_sum_year_nbr",
}

# The twin of each measure.
_TWINS = {
    "benefit": "m8_benefit_spells", "corrections": "m12_corrections_spells", "prison": "m13_prison_spells",
    "worked": "m4_employment_spells", "neet": "m6_neet_spells", "sickness": "m10_sickness_spells",
    "housing": "m11_social_housing_spells", "studied": "m5_education_spells", "benefit_kind": "m9_benefit_types",
    "resident": "m1_residents", "living": "m2_alive", "insolvent": "m25_bankrupt", "proceeding": "m26_bankruptcy_proceedings",
    "family_death": "m16_family_deaths", "job_end": "m20_end_of_employment", "violence": "m14_family_violence_events",
    "couple": "m15_relationship_spells", "dependent": "m17_dependent_children", "parenthood": "m18_recent_parents",
    "migrant": "m19_recent_migrants", "qualified": "m22_qualifications", "answers": "m23_wellbeing_survey",
    "home": "m24_address_descriptors", "income": "m21_annual_income", "ledger_q": "m28_ledger_debt_by_quarter",
    "assessed_q": "m29_assessed_debt_by_type", "ledger_d": "m27_debt_durations_ledger", "assessed_d": "m27_debt_durations_assessed",
}


def _exact(sql: str) -> str:
    """A twin on the inputs of the whole run, without its rounding to two places where the measure has none itself."""
    if sql != ORACLES["m28_ledger_debt_by_quarter"]:
        before, after = r2("\0").split("\0")
        sql = sql.replace(before, "(CAST(").replace(after, " AS DOUBLE))")
    for old, new in _CHANGED.items():
        sql = sql.replace(old, new)
    return sql


def _long_sql() -> str:
    """Rows (snz_uid, label, value) of all measures over the year."""
    rows: list[str] = []

    def add(label: str, table: str, value: str, start: str = "start_date", end: str = "end_date", by: str = "") -> None:
        inside = f"{start} <= {_PE} AND {end} >= {_PS}" if start else "TRUE"
        name = f"CONCAT('{label}=', COALESCE(CAST({by} AS VARCHAR), ''))" if by else f"'{label}'"
        rows.append(f"SELECT snz_uid, {name} AS label, CAST({value} AS DOUBLE) AS value FROM {table} WHERE {inside} GROUP BY snz_uid{', ' + by if by else ''}")

    days = f"SUM(LEAST(end_date, {_PE}) - GREATEST(start_date, {_PS}) + 1)"
    for label, table in {
        "benefit": "benefit", "corrections_any": "corrections", "corrections_prison": "prison", "dead": "dead", "employed": "worked",
        "neet": "neet", "overseas": "away", "sickness_benefit": "sickness", "social_housing": "housing", "study": "studied",
    }.items():
        add(f"days_{label}", table, days)
    one = "CASE WHEN COUNT(*) >= 1 THEN 1 ELSE 0 END"
    add("ben_type", "benefit_kind", "COUNT(ben_type)", by="ben_type")
    add("residential_population_indicator", "resident", one, "", "")
    add("audit_gss", "answers", one, "", "")
    add("spine_indicator", "persons", "MAX(snz_spine_ind)", "", "")
    add("birth_year", "persons", "MAX(snz_birth_year_nbr)", "", "")
    add("deprivation", "home", "MAX(DepIndex2013)", "", "")
    add("child_at_address", "home", "MAX(child_indicator)", "", "")
    add("area_type", "home", "COUNT(IUR2018_V1_00_NAME)", "", "", "IUR2018_V1_00_NAME")
    add("region_code", "home", "COUNT(ant_region_code)", "", "", "ant_region_code")
    for label, table in {
        "is_alive": "living", "bankrupt": "insolvent", "bankruptcy_process": "proceeding", "recent_parent": "parenthood", "recent_migrant": "migrant",
    }.items():
        add(label, table, one)
    for label, table in {"death_in_family": "family_death", "employment_end": "job_end", "family_violence_experience": "violence"}.items():
        add(label, table, "COUNT(*)", "event_date", "event_date")
    add("start_official_relationship", "couple", "COUNT(*)", "start_date", "start_date")
    add("end_official_relationship", "couple", "COUNT(*)", "end_date", "end_date")
    add("sickness_benefit_start", "sickness", "COUNT(*)", "start_date", "start_date")
    add("number_dependent_children", "dependent", "COUNT(*)")
    add("highest_qualification", "qualified", "MAX(qualification_level)", "event_date", "DATE '9999-12-31'")
    for label, code in {"WAS_income": "WAS", "WHP_income": "WHP", "BEN_income": "BEN", "total_income": "all_srces"}.items():
        add(label, "income", f"SUM(inc_tax_yr_sum_{code}_tot_amt)", "event_date", "event_date")
    for label, answer in {
        "life_satisfaction": "life_satisfaction", "life_worthwhile": "life_worthwhile", "sf12_mental_health": "SF12_mental_health",
        "sf12_physical_health": "SF12_physical_health", "mwi_afford_300_item": "gss_pq_item_300_limit_code",
        "mwi_not_pay_bills_on_time": "gss_pq_not_pay_bills_time_code", "mwi_enough_income": "gss_pq_enough_inc_code",
        "mwi_material_wellbeing_index": "material_wellbeing_index",
    }.items():
        add(label, "answers", f"MAX({answer})", "", "")
    for q in (f"{y}Q{i}" for y in (2017, 2018) for i in (1, 2, 3, 4)):
        add(f"msd_{q}", "ledger_q", f"SUM(value_{q})", "", "")
        add(f"ird_{q}", "assessed_q", f"SUM(Y{q})", "", "")
        for t in ("child_support", "families", "GST", "income_tax", "other", "PAYE", "student_loan"):
            add(f"ird_Y{q}_{t}", "assessed_q", f"SUM(Y{q}_{t})", "", "")
    for agency, table, cases, start, end in (
        ("msd", "ledger_q", "ledger_d", "debt_start_date", "debt_end_date"),
        ("ird", "assessed_q", "assessed_d", "dbt_date_begin", "dbt_date_end"),
    ):
        add(f"{agency}_2018_new_debt", table, "SUM(incurred_2018)", "", "")
        add(f"{agency}_2018_repaid", table, "SUM(repaid_2018)", "", "")
        add(f"{agency}_num_debts", cases, "COUNT(*)", start, end)
        add(f"{agency}_long_term_debtor", f"(SELECT * FROM {cases} WHERE long_term_debt = 1)", one, start, end)
    return " UNION ALL ".join(rows)


# Columns of the wide table, with or without a measure behind them.
_WIDE = [
    "birth_year", "residential_population_indicator", "highest_qualification", "number_dependent_children",
    "family_violence_experience", "child_at_address", "bankrupt", "deprivation", "sex_code=1", "sex_code=2", "eth_asian",
    "eth_european", "eth_maori", "eth_pacific", "eth_other", "eth_MELAA", "life_satisfaction", "life_worthwhile",
    "mwi_afford_300_item", "mwi_enough_income", "mwi_material_wellbeing_index", "mwi_not_pay_bills_on_time", "sf12_mental_health",
    "sf12_physical_health", "ben_type=Job Seeker", "ben_type=Sole Parent Support", "ben_type=Young Parent Payment",
    "ben_type=Sickness", "ben_type=Invalids", "ben_type=NZSuper", "ben_type=Student", "ben_type=Youth",
    "ben_type=Caring For Sick Or Infirm", "days_benefit", "days_corrections_any", "days_corrections_prison", "days_dead",
    "days_employed", "days_neet", "days_overseas", "days_sickness_benefit", "days_social_housing", "days_study", "WAS_income",
    "WHP_income", "BEN_income", "total_income", "audit_gss", "bankruptcy_process", "death_in_family", "employment_end",
    "end_official_relationship", "is_alive", "recent_migrant", "recent_parent", "sickness_benefit_start", "spine_indicator",
    "start_official_relationship",
    *[f"area_type={t} area" for t in ("Large urban", "Major urban", "Medium urban", "Small urban")],
    "area_type=Rural other", "area_type=Rural settlement",
    *[f"region_code={r:02}" for r in (*range(1, 10), *range(12, 19))],
    *[f"{a}_{y}Q{q}" for a in ("msd", "ird") for y in (2017, 2018) for q in (1, 2, 3, 4)],
    *[f"ird_Y{y}Q{q}_{t}" for t in ("child_support", "families", "GST", "income_tax", "other", "PAYE", "student_loan")
      for y in (2017, 2018) for q in (1, 2, 3, 4)],
    *[f"{a}_{what}" for a in ("msd", "ird") for what in ("2018_new_debt", "2018_repaid", "long_term_debtor", "num_debts")],
]
_SOURCES = sorted({name for step in steps_of(_STUDY).values() for name in step.reads} - set(steps_of(_STUDY)))


def _run_sql() -> str:
    parts = [f"{name} AS MATERIALIZED ({_exact(ORACLES[twin])})" for name, twin in _TWINS.items()]
    parts += [
        f"dead AS (SELECT snz_uid, {_DIED} AS start_date, DATE '9999-01-01' AS end_date FROM persons)",
        "away AS (SELECT snz_uid, CAST(pos_applied_date AS DATE) AS start_date, CAST(pos_ceased_date AS DATE) AS end_date FROM overseas)",
        f"long_rows AS (SELECT * FROM ({_long_sql()}) JOIN study_people USING (snz_uid))",
        "person_wide AS (SELECT snz_uid, '2018' AS label_summary_period, "
        + ", ".join(f"SUM(value) FILTER (WHERE label = '{c}') AS \"{c}\"" for c in _WIDE) + " FROM long_rows GROUP BY snz_uid)",
    ]
    return ", ".join(parts) + ", "


@query(
    "run_sources_to_group_totals",
    _run_sql() + _TIDY_PLAIN + _IN_GROUPS + f""" SELECT group_name, measure, {r2('SUM(value)')} AS total, COUNT(value) AS count FROM (
        SELECT group_name, measure, value FROM (SELECT group_name, {_quoted(_REPORT_SUMMED)} FROM grouped)
        UNPIVOT INCLUDE NULLS (value FOR measure IN ({_quoted(_REPORT_SUMMED)}))) GROUP BY group_name, measure""",
    ["study_people", "persons", "overseas"],
)
def _(spark, sf):
    sources = {name: frame(spark, sf, name) for name in [*_SOURCES, "study_people"]}
    sources["concordance"] = sources["concordance"].withColumn("snz_uid", F.col("snz_uid") - 500_000)
    sources["income_summary"] = sources["income_summary"].withColumn("inc_tax_yr_sum_year_nbr", F.col("inc_tax_yr_sum_year_nbr") + 20)
    return run_study(spark, sources, [fixed_population("study_people", _STUDY)], _STUDY)


@query(
    "io3_steps_in_buckets",
    sweep("spell", ["id"]) + """ SELECT a.id, GREATEST(a.start_date, b.start_date) AS start_date, LEAST(a.end_date, b.end_date) AS end_date,
        CAST(b.partner_id AS BIGINT) AS partner_id
        FROM isl a JOIN partner b ON a.id = b.id AND a.start_date <= b.end_date AND b.start_date <= a.end_date""",
    ["spell", "partner"],
)
def _(spark, sf):
    with IO.Steps(spark) as steps:
        spells = steps.keep(frame(spark, sf, "spell"), "spell", "id")
        partners = steps.keep(frame(spark, sf, "partner"), "partner", "id")
        return IO.materialise(O.intersect_spells(S.condense_spells(spells, "id"), partners, "id", spread=False))


@query(
    "c1_c3_checks_inside_the_write",
    """SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(*) - COUNT(score) AS BIGINT) AS no_score,
              CAST(COUNT(*) - COUNT(level) AS BIGINT) AS no_level, CAST(COUNT(*) AS BIGINT) AS stored FROM wide""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    metrics = {"n": F.count(F.lit(1)), "no_score": F.count_if(F.col("score").isNull()), "no_level": F.count_if(F.col("level").isNull())}
    stored, found = IO.write_observed(IO.never_missing(wide, ["id"]), IO.scratch_path(spark, "observed"), metrics)
    return one_row(spark, **found, stored=stored.count())


_REPLACED = [spell_measure("spells", "COUNT"), spell_measure("total", "SUM")]


@query(
    "a12_replace_measures",
    " UNION ALL ".join([measure_sql("'spells'", "COUNT(m.v)"), measure_sql("'total'", "SUM(m.v)").replace("GROUP BY", "WHERE m.code <> '5-LOW' GROUP BY")]),
    ["population", "spell"],
)
def _(spark, sf):
    tables = {name: frame(spark, sf, name) for name in ("population", "spell")}
    output = IO.scratch_path(spark, "by-measure")
    A.replace_measures(spark, [PEOPLE], _REPLACED, output, tables)
    # The definition of one measure's table changes: it alone is computed again.
    changed = {**tables, "spell": tables["spell"].filter("code <> '5-LOW'")}
    stored = A.replace_measures(spark, [PEOPLE], _REPLACED[1:], output, changed)
    return stored.select(*A.RESULT_COLUMNS)

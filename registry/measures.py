"""Measure definitions on source tables derived from the driver's."""

from __future__ import annotations

from registry.build import i8, query, r2, sweep
from registry.inputs import frame
from registry.ledgers import cases_sql
from registry.spells import gaps_sql, relatives_sql, roles_sql
from spanwise.plans.measures import activity, debt, justice, people, support

_SPELL = "SELECT id AS snz_uid, start_date, end_date FROM isl"


def _born(years: int = 0, day: int = 15) -> str:
    return f"make_date(snz_birth_year_nbr + {years}, snz_birth_month_nbr, {day})"


_DIED = "make_date(snz_deceased_year_nbr, snz_deceased_month_nbr, 28)"


@query("m1_residents", "SELECT snz_uid, srp_ref_date FROM residents_in WHERE year(srp_ref_date) = 1998", ["residents_in"])
def _(spark, sf):
    return people.residents(frame(spark, sf, "residents_in"), 1998)


@query(
    "m2_alive",
    f"""dated AS (SELECT snz_uid, {_born()} AS start_date, COALESCE({_DIED}, {_born(130, 28)}) AS end_date FROM persons
        WHERE snz_person_ind = 1 AND snz_birth_year_nbr <= 2021 AND snz_birth_month_nbr IS NOT NULL
        AND COALESCE(snz_deceased_year_nbr, 0) < 2021)
        SELECT * FROM dated WHERE start_date <= end_date""",
    ["persons"],
)
def _(spark, sf):
    return people.alive(frame(spark, sf, "persons"))


@query(
    "m3_deaths",
    f"""SELECT snz_uid, snz_deceased_year_nbr, snz_deceased_month_nbr, snz_deceased_date_source_code, {_DIED} AS event_date
        FROM persons WHERE snz_deceased_year_nbr + snz_deceased_month_nbr IS NOT NULL""",
    ["persons"],
)
def _(spark, sf):
    return people.deaths(frame(spark, sf, "persons"))


def _returns_sql(kinds: str, first: str, last: str) -> str:
    s, e, r = "ir_ems_employee_start_date", "ir_ems_employee_end_date", "ir_ems_return_period_date"
    return f"""
    SELECT snz_uid AS id, CAST(CASE WHEN {r} - {s} BETWEEN 1 AND 59 THEN {s} ELSE date_trunc('month', {r}) END AS DATE) AS start_date,
           CASE WHEN {r} - {e} BETWEEN 1 AND 26 AND COALESCE({s} < {e}, TRUE) THEN {e} ELSE {r} END AS end_date
    FROM returns WHERE ir_ems_income_source_code IN ({kinds}) AND snz_ird_uid <> 0
    AND {r} >= DATE '{first}' AND {r} <= DATE '{last}'"""


_WORK = f"work AS ({_returns_sql("'W&S', 'WHP'", '2014-01-01', '2020-12-31')}),"


@query("m4_employment_spells", _WORK + sweep("work", ["id"]) + _SPELL, ["returns"])
def _(spark, sf):
    return activity.employment_spells(frame(spark, sf, "returns"))


def _touches(s: str, e: str, first: str, last: str) -> str:
    return f"{s} <= DATE '{last}' AND DATE '{first}' <= {e}"


_W = ("2006-01-01", "2026-12-31")
_STUDY = f"""study AS (
  SELECT snz_uid AS id, moe_enr_prog_start_date AS start_date, moe_enr_prog_end_date AS end_date FROM enrolment
  UNION ALL SELECT snz_uid, moe_ttr_placement_start_date, moe_ttr_placement_end_date FROM targeted_training
  UNION ALL SELECT snz_uid, moe_itl_start_date, moe_itl_end_date FROM industry_training WHERE moe_itl_end_date IS NOT NULL),
study_in AS (SELECT * FROM study WHERE {_touches('start_date', 'end_date', *_W)}),"""
_STUDY_INPUTS = ["enrolment", "targeted_training", "industry_training"]


@query("m5_education_spells", _STUDY + sweep("study_in", ["id"]) + _SPELL, _STUDY_INPUTS)
def _(spark, sf):
    return activity.education_spells(*[frame(spark, sf, n) for n in _STUDY_INPUTS])


@query(
    "m6_neet_spells",
    _WORK + _STUDY
    + f"""occupied AS (SELECT * FROM (
        SELECT id, start_date, end_date FROM work UNION ALL SELECT id, start_date, end_date FROM study_in
        UNION ALL SELECT snz_uid, CAST(pos_applied_date AS DATE), CAST(pos_ceased_date AS DATE) FROM overseas) WHERE {_touches('start_date', 'end_date', *_W)}),
      age_window AS (SELECT snz_uid AS id, {_born(18)} AS earliest_date,
        CASE WHEN snz_deceased_year_nbr - snz_birth_year_nbr <= 65 THEN {_DIED} ELSE {_born(65, 28)} END AS latest_date
        FROM persons WHERE snz_spine_ind = 1 AND snz_person_ind = 1 AND snz_birth_year_nbr + snz_birth_month_nbr IS NOT NULL),"""
    + gaps_sql("occupied", "age_window").replace("SELECT id, CAST(start_date", "SELECT id AS snz_uid, CAST(start_date"),
    ["persons", "overseas", "returns", *_STUDY_INPUTS],
)
def _(spark, sf):
    study = activity.education_spells(*[frame(spark, sf, n) for n in _STUDY_INPUTS])
    work = activity.employment_spells(frame(spark, sf, "returns"))
    return activity.neet_spells(frame(spark, sf, "persons"), frame(spark, sf, "overseas"), study, work)


_ROLE = (
    """own AS (SELECT snz_uid AS id, COALESCE(msd_spel_servf_code, 'null') AS servf, COALESCE(msd_spel_add_servf_code, 'null') AS added,
               msd_spel_spell_start_date AS start_date, COALESCE(msd_spel_spell_end_date, DATE '9999-01-01') AS end_date
        FROM benefit_spell WHERE msd_spel_spell_start_date <= COALESCE(msd_spel_spell_end_date, DATE '9999-01-01')),
    couple AS (SELECT snz_uid AS id, partner_snz_uid AS partner_id, msd_ptnr_ptnr_from_date AS start_date,
               COALESCE(msd_ptnr_ptnr_to_date, DATE '9999-01-01') AS end_date
        FROM benefit_partner WHERE msd_ptnr_ptnr_from_date <= COALESCE(msd_ptnr_ptnr_to_date, DATE '9999-01-01')),"""
    + roles_sql("own", "couple", "servf, added")
    + """, benefit AS (SELECT r.id, role, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date,
               servf, added, level1, level2, level3, level4
        FROM role_row r LEFT JOIN benefit_codes c ON r.servf = c.serv AND r.added = COALESCE(c.additional_service_data, 'null')
        AND r.start_date BETWEEN c.ValidFromtxt AND c.ValidTotxt)"""
)
_ROLE_INPUTS = ["benefit_spell", "benefit_partner", "benefit_codes"]


def _roles(spark, sf):
    return support.benefit_roles(*[frame(spark, sf, n) for n in _ROLE_INPUTS])


@query(
    "m7_benefit_roles",
    _ROLE + """ SELECT id AS snz_uid, role, start_date, end_date, servf AS msd_spel_servf_code, added AS msd_spel_add_servf_code,
                       level1, level2, level3, level4 FROM benefit""",
    _ROLE_INPUTS,
)
def _(spark, sf):
    return _roles(spark, sf)


@query(
    "m8_benefit_spells",
    _ROLE + f", near AS (SELECT * FROM benefit WHERE {_touches('start_date', 'end_date', *_W)})," + sweep("near", ["id"]) + _SPELL,
    _ROLE_INPUTS,
)
def _(spark, sf):
    return support.benefit_spells(_roles(spark, sf))


@query(
    "m9_benefit_types",
    _ROLE + f""" SELECT id AS snz_uid, start_date, end_date, level4 AS ben_type FROM benefit
                 WHERE year(start_date) <= 2020 AND year(end_date) >= 2014
                 UNION ALL SELECT id, start_date, end_date, 'NZSuper' FROM ({_returns_sql("'PEN'", '2014-01-01', '2020-12-31')})""",
    [*_ROLE_INPUTS, "returns"],
)
def _(spark, sf):
    return support.benefit_types(_roles(spark, sf), frame(spark, sf, "returns"))


@query(
    "m10_sickness_spells",
    _ROLE + f""", ill AS (SELECT * FROM benefit WHERE role <> 'partner' AND level4 IN ('Sickness', 'Invalids')
                  AND {_touches('start_date', 'end_date', '2012-01-01', '2020-12-31')}),""" + sweep("ill", ["id"]) + _SPELL,
    _ROLE_INPUTS,
)
def _(spark, sf):
    return support.sickness_spells(_roles(spark, sf))


@query(
    "m11_social_housing_spells",
    """seen AS (SELECT DISTINCT snz_uid AS id, hnz_ths_snapshot_date AS d, snz_household_uid AS h, snz_legacy_household_uid AS o
                FROM tenancy WHERE hnz_ths_snapshot_date BETWEEN DATE '2012-01-01' AND DATE '2020-12-31'),
       stay AS (SELECT DISTINCT a.id, a.d AS start_date, b.d AS end_date FROM seen a JOIN seen b
                ON a.id = b.id AND b.d - a.d BETWEEN 20 AND 40 AND (a.h = b.h OR a.o = b.o)),""" + sweep("stay", ["id"]) + _SPELL,
    ["tenancy"],
)
def _(spark, sf):
    return support.social_housing_spells(frame(spark, sf, "tenancy"))


_MANAGED = f"""SELECT snz_uid, cor_mmp_prev_mmc_code, cor_mmp_mmc_code, cor_mmp_next_mmc_code, cor_mmp_index_offence_code,
  {i8('cor_mmp_imposed_sentence_length_nbr')} AS cor_mmp_imposed_sentence_length_nbr, cor_mmp_sentence_location_text,
  cor_mmp_period_start_date AS start_date, cor_mmp_period_end_date - %d AS end_date
  FROM (SELECT *, MAX(cor_mmp_max_period_nbr) OVER (PARTITION BY snz_uid) AS longest FROM management)
  WHERE cor_mmp_max_period_nbr = longest AND cor_mmp_period_start_date <= cor_mmp_period_end_date AND %s"""


@query(
    "m12_corrections_spells",
    _MANAGED % (1, "cor_mmp_mmc_code NOT IN ('AGED_OUT', 'ALIVE', 'ERROR', 'NA')"),
    ["management"],
)
def _(spark, sf):
    return justice.corrections_spells(frame(spark, sf, "management"))


@query("m13_prison_spells", _MANAGED % (0, "cor_mmp_mmc_code = 'PRISON'"), ["management"])
def _(spark, sf):
    return justice.prison_spells(frame(spark, sf, "management"))


# Offence codes of family violence.
_VIOLENCE = ["1581", "1582", "1583", "1587", "1641", "1642", "1643", "1647", "2654", "2658", "3711", "1D"]


@query(
    "m14_family_violence_events",
    f"""SELECT snz_uid, nia_links_rec_date AS event_date, nia_links_role_type_text FROM police_links
        WHERE nia_links_rec_date IS NOT NULL AND list_contains({_VIOLENCE}, nia_links_latest_inc_off_code)""",
    ["police_links"],
)
def _(spark, sf):
    return justice.family_violence_events(frame(spark, sf, "police_links"))


@query(
    "m15_relationship_spells",
    f"""died AS (SELECT snz_uid AS id, {_DIED} AS d FROM persons),
        couple AS (SELECT partnr1_snz_uid AS a, partnr2_snz_uid AS b, dia_mar_marriage_date AS s, dia_mar_disolv_order_date AS e FROM marriages
                   UNION ALL SELECT partnr1_snz_uid, partnr2_snz_uid, dia_civ_civil_union_date, dia_civ_disolv_order_date FROM civil_unions),
        ended AS (SELECT a, b, s, COALESCE(e, LEAST(x.d, y.d), DATE '9999-12-31') AS e FROM couple
                  JOIN died x ON a = x.id JOIN died y ON b = y.id WHERE a <> b AND s IS NOT NULL)
        SELECT a AS snz_uid, s AS start_date, e AS end_date FROM ended UNION ALL SELECT b, s, e FROM ended""",
    ["marriages", "civil_unions", "persons"],
)
def _(spark, sf):
    return people.relationship_spells(*[frame(spark, sf, n) for n in ("marriages", "civil_unions", "persons")])


@query(
    "m16_family_deaths",
    f"""folk AS (SELECT snz_uid AS id, snz_parent1_uid AS parent1, snz_parent2_uid AS parent2,
                 CASE WHEN snz_person_ind = 1 THEN {_DIED} END AS died FROM persons),
        unions AS (SELECT partnr1_snz_uid AS partner1, partnr2_snz_uid AS partner2 FROM marriages WHERE dia_mar_marriage_date IS NOT NULL
                   UNION ALL SELECT partnr1_snz_uid, partnr2_snz_uid FROM civil_unions WHERE dia_civ_civil_union_date IS NOT NULL),"""
    + relatives_sql("folk", "unions")
    + " SELECT id AS snz_uid, event_date, relationship, deceased_id AS deceased_snz_uid FROM relation",
    ["persons", "marriages", "civil_unions"],
)
def _(spark, sf):
    return people.family_deaths(*[frame(spark, sf, n) for n in ("persons", "marriages", "civil_unions")])


@query(
    "m17_dependent_children",
    f"""child AS (SELECT snz_parent1_uid AS p1, snz_parent2_uid AS p2, snz_birth_date_proxy AS s,
                  CASE WHEN {_DIED} < {_born(16)} THEN {_DIED} ELSE {_born(16)} END AS e
                  FROM persons WHERE snz_birth_year_nbr + snz_birth_month_nbr IS NOT NULL)
        SELECT p1 AS snz_uid, s AS start_date, e AS end_date FROM child WHERE p1 IS NOT NULL AND s <= e
        UNION ALL SELECT p2, s, e FROM child WHERE p2 IS NOT NULL AND p2 IS DISTINCT FROM p1 AND s <= e""",
    ["persons"],
)
def _(spark, sf):
    return people.dependent_children(frame(spark, sf, "persons"))


@query(
    "m18_recent_parents",
    """born AS (SELECT *, make_date(dia_bir_birth_year_nbr, dia_bir_birth_month_nbr, 15) AS dob FROM births
                WHERE dia_bir_still_birth_code IS NULL),
       parent AS (SELECT parent1_snz_uid AS snz_uid, dob, snz_uid AS child_snz_uid FROM born
                  UNION ALL SELECT parent2_snz_uid, dob, snz_uid FROM born WHERE parent2_snz_uid IS DISTINCT FROM parent1_snz_uid)
       SELECT snz_uid, dob AS start_date, CAST(dob + INTERVAL 2 YEAR AS DATE) AS end_date, child_snz_uid FROM parent
       WHERE snz_uid IS NOT NULL""",
    ["births"],
)
def _(spark, sf):
    return people.recent_parents(frame(spark, sf, "births"))


@query(
    "m19_recent_migrants",
    """SELECT snz_uid, CAST(pos_ceased_date AS DATE) AS start_date,
              CAST(CASE WHEN year(pos_ceased_date) = 9999 THEN pos_ceased_date ELSE pos_ceased_date + INTERVAL 2 YEAR END AS DATE) AS end_date,
              pos_first_arrival_ind, pos_last_departure_ind, pos_source_code FROM overseas WHERE pos_first_arrival_ind = 'y'""",
    ["overseas"],
)
def _(spark, sf):
    return people.recent_migrants(frame(spark, sf, "overseas"))


@query(
    "m20_end_of_employment",
    f"""wage AS (SELECT snz_uid, snz_employer_ird_uid, ir_ems_return_period_date AS d FROM returns
                 WHERE ir_ems_income_source_code = 'W&S' AND snz_ird_uid <> 0),
        ends AS (SELECT snz_uid, snz_employer_ird_uid, MAX(d) AS event_date FROM wage GROUP BY ALL)
        SELECT snz_uid, event_date, {i8('snz_employer_ird_uid')} AS snz_employer_ird_uid FROM ends e
        WHERE EXISTS (SELECT 1 FROM wage w WHERE w.snz_uid = e.snz_uid AND w.d > e.event_date)
        AND NOT EXISTS (SELECT 1 FROM wage w WHERE w.snz_uid = e.snz_uid
                        AND year(w.d) * 12 + month(w.d) = year(e.event_date) * 12 + month(e.event_date) + 1)""",
    ["returns"],
)
def _(spark, sf):
    return activity.end_of_employment(frame(spark, sf, "returns"))


# Sources of income, as they stand in column names.
_SOURCES = "WAS WHP BEN ACC PEN PPL STU C00 C01 C02 P00 P01 P02 S00 S01 S02 S03 all_srces".split()
_AMOUNTS = [f"inc_tax_yr_sum_{c}_tot_amt" for c in _SOURCES]


@query(
    "m21_annual_income",
    "SELECT snz_uid, inc_tax_yr_sum_year_nbr, " + ", ".join(
        f"CAST(CAST(inc_tax_yr_sum_year_nbr AS VARCHAR) || '-{d}' AS DATE) AS {n}"
        for n, d in (("event_date", "03-31"), ("start_date", "01-01"), ("end_date", "12-31"))
    ) + ", " + ", ".join(f"{r2(a)} AS {a}" for a in _AMOUNTS) + " FROM income_summary",
    ["income_summary"],
)
def _(spark, sf):
    return activity.annual_income(frame(spark, sf, "income_summary"))


def _census_sql(table: str, school: str, highest: str, day: str, source: str) -> str:
    return f"""
    SELECT snz_uid, make_date(cen_ind_birth_year_nbr + 18, 12, 1) AS event_date, {i8(school)} AS qualification_level, '{source}' AS source
    FROM {table} WHERE CAST({school} AS INT) BETWEEN 1 AND 3
    UNION ALL SELECT snz_uid, DATE '{day}', {i8(highest)}, '{source}' FROM {table}
    WHERE CAST({highest} AS INT) BETWEEN 1 AND 10 AND {highest} <> {school}"""


_QUALIFICATION_INPUTS = ["census_2018", "census_2013", "student_qualification", "completion", "industry_training"]


@query(
    "m22_qualifications",
    "SELECT * FROM (" + " UNION ALL ".join([
        _census_sql("census_2018", "cen_ind_scdry_scl_qual_code", "cen_ind_standard_hst_qual_code", "2018-03-08", "cen2018"),
        _census_sql("census_2013", "cen_ind_sndry_scl_qual_code", "cen_ind_std_highest_qual_code", "2013-03-05", "cen2013"),
        """SELECT snz_uid, make_date(moe_sql_attained_year_nbr, 12, 1), moe_sql_nqf_level_code, 'second' FROM student_qualification
           WHERE moe_sql_nqf_level_code BETWEEN 1 AND 10""",
        """SELECT snz_uid, make_date(moe_com_year_nbr, 12, 1), moe_com_qual_level_code, 'tertiary' FROM completion
           WHERE moe_com_qual_level_code BETWEEN 1 AND 10""",
        *[f"""SELECT snz_uid, moe_itl_end_date, {i}, 'industry' FROM industry_training
              WHERE moe_itl_end_date IS NOT NULL AND moe_itl_level{i}_qual_awarded_nbr > 0""" for i in range(1, 9)],
    ]) + ")",
    _QUALIFICATION_INPUTS,
)
def _(spark, sf):
    return activity.qualifications(*[frame(spark, sf, n) for n in _QUALIFICATION_INPUTS])


# Survey questions and what their answers are called.
_ANSWERS = {
    "gss_pq_feel_life_code": "life_satisfaction",
    "gss_pq_life_worthwhile_code": "life_worthwhile",
    "gss_pq_ment_health_code": "SF12_mental_health",
    "gss_pq_phys_health_code": "SF12_physical_health",
    "gss_pq_item_300_limit_code": "gss_pq_item_300_limit_code",
    "gss_pq_not_pay_bills_time_code": "gss_pq_not_pay_bills_time_code",
    "gss_pq_enough_inc_code": "gss_pq_enough_inc_code",
    "gss_pq_material_wellbeing_code": "material_wellbeing_index",
}


@query(
    "m23_wellbeing_survey",
    "SELECT snz_uid, gss_pq_PQinterview_date AS event_date, "
    + ", ".join(f"{r2(c)} AS {n}" for c, n in _ANSWERS.items())
    + " FROM survey WHERE gss_pq_collection_code = 'GSS2016'",
    ["survey"],
)
def _(spark, sf):
    return activity.wellbeing_survey(frame(spark, sf, "survey"))


_ADDRESS_INPUTS = ["address", "mb_concordance", "mb_geography", "mb_deprivation", "persons", "residents_in"]


@query(
    "m24_address_descriptors",
    f"""here AS (SELECT * FROM address WHERE DATE '2000-06-30' BETWEEN ant_notification_date AND ant_replacement_date),
        homes AS (SELECT h.snz_idi_address_register_uid AS home, COUNT(*) AS children FROM here h JOIN persons b USING (snz_uid)
                  WHERE COALESCE(b.snz_deceased_year_nbr, 9999) > 2000 AND h.snz_idi_address_register_uid IS NOT NULL
                  AND (2000 * 12 + 6) - (year(b.snz_birth_date_proxy) * 12 + month(b.snz_birth_date_proxy)) <= 180
                  AND h.snz_uid IN (SELECT snz_uid FROM residents_in) GROUP BY 1)
        SELECT a.snz_uid, a.ant_notification_date, a.ant_replacement_date, a.snz_idi_address_register_uid, a.ant_region_code,
               b.IUR2018_V1_00, b.IUR2018_V1_00_NAME, {i8('b.SA22018_V1_00')} AS SA22018_V1_00, b.SA22018_V1_00_NAME,
               {i8('c.DepIndex2013')} AS DepIndex2013, {r2('c.DepScore2013')} AS DepScore2013,
               {i8('CASE WHEN children > 0 THEN 1 ELSE 0 END')} AS child_indicator
        FROM here a JOIN mb_concordance m ON m.MB2019_code = a.ant_meshblock_code
        LEFT JOIN mb_geography b ON m.MB2018_code = b.MB2018_V1_00 LEFT JOIN mb_deprivation c ON m.MB2013_code = c.Meshblock2013
        LEFT JOIN homes ON a.snz_idi_address_register_uid = home""",
    _ADDRESS_INPUTS,
)
def _(spark, sf):
    return people.address_descriptors(*[frame(spark, sf, n) for n in _ADDRESS_INPUTS], on="2000-06-30")


@query(
    "m25_bankrupt",
    """SELECT snz_uid, ir_xrf_applied_date AS event_date, ir_xrf_applied_date AS start_date, ir_xrf_ceased_date AS end_date,
              ir_xrf_reference_type_code, ir_xrf_ird_timestamp_date FROM insolvency
       WHERE ir_xrf_reference_type_code = 'BAN' AND ir_xrf_applied_date <= ir_xrf_ceased_date""",
    ["insolvency"],
)
def _(spark, sf):
    return debt.bankrupt(frame(spark, sf, "insolvency"))


@query(
    "m26_bankruptcy_proceedings",
    """SELECT snz_uid, ir_cus_applied_date AS start_date, ir_cus_ceased_date AS end_date, ir_cus_client_status_code FROM tax_customers
       WHERE ir_cus_client_status_code <> 'A' AND ir_cus_entity_type_code = 'I' AND ir_cus_ceased_date - ir_cus_applied_date >= 0""",
    ["tax_customers"],
)
def _(spark, sf):
    return debt.bankruptcy_proceedings(frame(spark, sf, "tax_customers"))


def _linked(key: str, table: str) -> str:
    return f"FROM {table} t LEFT JOIN concordance c ON t.{key} = c.{key}"


_LEDGER_CASES = cases_sql(
    "benefit_ledger", "snz_msd_uid", "debt_as_at_date", "amount_incurred", "amount_repaid", "amount_written_off"
)
_DAYS = "debt_end_date - debt_start_date"


@query(
    "m27_debt_durations_ledger",
    _LEDGER_CASES + f""" SELECT c.snz_uid, t.id AS snz_msd_uid, debt_start_date, debt_end_date, {i8(_DAYS)} AS days_debt,
        {i8(f'CASE WHEN {_DAYS} > 1000 THEN 1 ELSE 0 END')} AS long_term_debt
        FROM debt_case t LEFT JOIN concordance c ON t.id = c.snz_msd_uid
        WHERE year(debt_end_date) <> 9999 AND debt_end_date > debt_start_date""",
    ["benefit_ledger", "concordance"],
)
def _(spark, sf):
    cases = debt.ledger_debt_cases(frame(spark, sf, "benefit_ledger"), frame(spark, sf, "concordance"))
    return debt.debt_durations(cases, "debt_start_date", "debt_end_date")


@query(
    "m27_debt_durations_assessed",
    f"""SELECT c.snz_uid, t.snz_ird_uid, dbt_date_begin, dbt_date_end, {i8('dbt_date_end - dbt_date_begin')} AS days_debt,
        {i8('CASE WHEN dbt_date_end - dbt_date_begin > 1000 THEN 1 ELSE 0 END')} AS long_term_debt {_linked('snz_ird_uid', 'assessed_cases')}
        WHERE year(dbt_date_end) <> 9999 AND dbt_date_begin <> dbt_date_end""",
    ["assessed_cases", "concordance"],
)
def _(spark, sf):
    cases = debt.assessed_debt_cases(frame(spark, sf, "assessed_cases"), frame(spark, sf, "concordance"))
    return debt.debt_durations(cases, "dbt_date_begin", "dbt_date_end")


@query(
    "m28_ledger_debt_cases",
    _LEDGER_CASES + """ SELECT c.snz_uid, t.id AS snz_msd_uid, debt_start_date, debt_end_date
                        FROM debt_case t LEFT JOIN concordance c ON t.id = c.snz_msd_uid""",
    ["benefit_ledger", "concordance"],
)
def _(spark, sf):
    return debt.ledger_debt_cases(frame(spark, sf, "benefit_ledger"), frame(spark, sf, "concordance"))


# First and last day of each quarter.
_Q = {
    "2017Q1": ("2017-01-01", "2017-03-31"), "2017Q2": ("2017-04-01", "2017-06-30"),
    "2017Q3": ("2017-07-01", "2017-09-30"), "2017Q4": ("2017-10-01", "2017-12-31"),
    "2018Q1": ("2018-01-01", "2018-03-31"), "2018Q2": ("2018-04-01", "2018-06-30"),
    "2018Q3": ("2018-07-01", "2018-09-30"), "2018Q4": ("2018-10-01", "2018-12-31"),
}
_MOVED = "COALESCE(amount_incurred, 0) + COALESCE(amount_repaid, 0) + COALESCE(amount_written_off, 0)"


@query(
    "m28_ledger_debt_by_quarter",
    "total AS (SELECT snz_msd_uid, " + ", ".join(
        f"SUM({_MOVED}) FILTER (WHERE debt_as_at_date <= DATE '{b}') AS value_{q}" for q, (_, b) in _Q.items()
    ) + """, SUM(amount_incurred) FILTER (WHERE year(debt_as_at_date) = 2018) AS incurred_2018,
             SUM(amount_repaid) FILTER (WHERE year(debt_as_at_date) = 2018) AS repaid_2018 FROM benefit_ledger GROUP BY 1)
        SELECT c.snz_uid, t.snz_msd_uid, """ + ", ".join(
        f"{r2(f'COALESCE({v}, 0)')} AS {v}" for v in [*[f"value_{q}" for q in _Q], "incurred_2018", "repaid_2018"]
    ) + f" {_linked('snz_msd_uid', 'total')} WHERE " + " OR ".join(f"ABS(COALESCE(value_{q}, 0)) >= 1" for q in _Q),
    ["benefit_ledger", "concordance"],
)
def _(spark, sf):
    return debt.ledger_debt_by_quarter(frame(spark, sf, "benefit_ledger"), frame(spark, sf, "concordance"))


_CASE = "snz_ird_uid, snz_dbt_case_uid, dbt_tax_type"
_ASSESSED = f"""
dated AS (SELECT *, make_date(CAST(2000 + CAST(dbt_date_processed[4:5] AS INT) AS INT),
                 CASE dbt_date_processed[1:3] WHEN 'JAN' THEN 1 WHEN 'APR' THEN 4 WHEN 'JUL' THEN 7 ELSE 10 END, 1) AS d FROM assessed_txn),
quarterly AS (SELECT {_CASE}, d, SUM(dbt_delta) AS delta, SUM(COALESCE(dbt_assessment, 0)) AS assessed,
                     SUM(COALESCE(dbt_payment, 0)) AS paid FROM dated GROUP BY ALL),
summed AS (SELECT *, SUM(delta) OVER (PARTITION BY {_CASE} ORDER BY d) AS bal FROM quarterly),
raised AS (SELECT *, bal + CASE WHEN MIN(bal) OVER (PARTITION BY {_CASE}) < -10 THEN -MIN(bal) OVER (PARTITION BY {_CASE}) ELSE 0 END AS b,
                  LEAD(d) OVER (PARTITION BY {_CASE} ORDER BY d) AS next_d FROM summed),
by_quarter AS (SELECT snz_ird_uid, dbt_tax_type, """ + ", ".join(
    f"SUM(CASE WHEN d <= DATE '{b}' AND b > 10 AND COALESCE(next_d - 1, DATE '9999-01-01') >= DATE '{a}' THEN b ELSE 0 END) AS Y{q}"
    for q, (a, b) in _Q.items()
) + """, SUM(CASE WHEN year(d) = 2018 THEN assessed ELSE 0 END) AS incurred_2018,
         SUM(CASE WHEN year(d) = 2018 THEN paid ELSE 0 END) AS repaid_2018 FROM raised GROUP BY 1, 2)"""
_VALUES = [*[f"Y{q}" for q in _Q], "incurred_2018", "repaid_2018"]
_BY_QUARTER = "c.snz_uid, t.snz_ird_uid, dbt_tax_type, " + ", ".join(f"{r2(v)} AS {v}" for v in _VALUES)


def _assessed(spark, sf):
    return debt.assessed_debt_by_quarter(frame(spark, sf, "assessed_txn"), frame(spark, sf, "concordance"))


@query(
    "m29_assessed_debt_by_quarter",
    _ASSESSED + f" SELECT {_BY_QUARTER} {_linked('snz_ird_uid', 'by_quarter')}",
    ["assessed_txn", "concordance"],
)
def _(spark, sf):
    return _assessed(spark, sf)


# Types of assessed debt and how they end column names.
_TAX_TYPES = {
    "Child Support": "child_support", "Families": "families", "GST": "GST", "Income Tax": "income_tax",
    "Other": "other", "PAYE": "PAYE", "Student Loan": "student_loan",
}


@query(
    "m29_assessed_debt_by_type",
    _ASSESSED + f" SELECT {_BY_QUARTER}, " + ", ".join(
        r2(f"CASE WHEN dbt_tax_type = '{t}' THEN Y{q} ELSE 0 END") + f" AS Y{q}_{n}" for t, n in _TAX_TYPES.items() for q in _Q
    ) + f" {_linked('snz_ird_uid', 'by_quarter')}",
    ["assessed_txn", "concordance"],
)
def _(spark, sf):
    return debt.assessed_debt_by_type(_assessed(spark, sf))


@query(
    "m29_assessed_debt_cases",
    f"SELECT c.snz_uid, t.snz_ird_uid, dbt_date_begin, dbt_date_end {_linked('snz_ird_uid', 'assessed_cases')}",
    ["assessed_cases", "concordance"],
)
def _(spark, sf):
    return debt.assessed_debt_cases(frame(spark, sf, "assessed_cases"), frame(spark, sf, "concordance"))

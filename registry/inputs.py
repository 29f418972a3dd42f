"""Inputs in the shapes the library works on, derived from the driver's tables.

Each text is valid in Spark SQL and in DuckDB, so both sides of a comparison see
the same rows. `{orders}` and the like stand for the driver's tables; `[name]`
refers to another input. Missing values, open ends and reversed spells, which the
driver's tables lack, are put in here. People without a partner, spell or link come
from keys that are shifted or NULL: every row of a table takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from registry.names import Names

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_DAY = "CAST(o_orderdate AS DATE)"
# 1995..2001 moved on by 19, 17 and 15 years, to fall in the study windows of the measures.
_LATER = f"({_DAY} + 6940)"
_SHIPPED_LATER = "(CAST(l_shipdate AS DATE) + 6209)"
_TXN_DAY = "(CAST(l_shipdate AS DATE) + 5479)"

INPUTS: dict[str, str] = {
    # ---- generic shapes -------------------------------------------------------------
    "spell": f"""
        SELECT o_custkey AS id, o_orderpriority AS code, {_DAY} AS start_date,
               CASE WHEN o_orderkey % 97 = 0 THEN DATE '9999-01-01'
                    ELSE {_DAY} + CAST(o_orderkey % 120 AS INT) END AS end_date,
               o_totalprice AS v
        FROM {{orders}}""",
    "raw_spell": f"""
        SELECT o_custkey AS id, o_orderpriority AS code, {_DAY} AS start_date,
               CASE WHEN o_orderkey % 97 = 0 THEN DATE '9999-12-31'
                    WHEN o_orderkey % 89 = 0 THEN {_DAY} - 5
                    ELSE {_DAY} + CAST(o_orderkey % 120 AS INT) END AS end_date
        FROM {{orders}}""",
    "bounds": """
        SELECT c_custkey AS id, DATE '1995-06-01' + CAST(c_custkey % 400 AS INT) AS earliest_date,
               CASE WHEN c_custkey % 50 = 0 THEN DATE '9999-01-01'
                    ELSE DATE '1995-06-01' + CAST(c_custkey % 400 + c_custkey % 1100 - 20 AS INT) END AS latest_date
        FROM {customer}""",
    "busy": """
        SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN id ELSE -id END AS id, start_date, end_date
        FROM [spell] JOIN {customer} ON id = c_custkey""",
    "partner": f"""
        SELECT CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN o_custkey ELSE -o_custkey END AS id, o_custkey + 1 + o_orderkey % 2 AS partner_id, {_DAY} + 30 AS start_date,
               CASE WHEN o_orderkey % 83 = 0 THEN DATE '9999-01-01'
                    ELSE {_DAY} + 30 + CAST(o_orderkey % 200 AS INT) END AS end_date
        FROM {{orders}}""",
    "person": """
        SELECT c_custkey AS id, 1935 + c_custkey % 75 AS birth_year, 1 + c_custkey % 12 AS birth_month,
               CASE WHEN c_custkey % 7 = 0 THEN 2000 + c_custkey % 20 END AS death_year,
               CASE WHEN c_custkey % 7 = 0 THEN 1 + c_custkey % 11 END AS death_month,
               CASE WHEN c_custkey >= 40 AND c_custkey % 11 <> 0 THEN c_custkey - 40 + c_custkey % 4 END AS parent1,
               CASE WHEN c_custkey >= 60 AND c_custkey % 3 <> 0 THEN c_custkey - 60 + c_custkey % 5
                    WHEN c_custkey >= 60 AND c_custkey % 6 = 0 THEN c_custkey - 40 + c_custkey % 4 END AS parent2
        FROM {customer}""",
    "union_record": f"""
        SELECT o_custkey AS partner1, CASE WHEN o_orderkey % 41 = 0 THEN NULL
                    WHEN o_orderkey % 43 = 0 THEN o_custkey ELSE o_custkey + 1 + o_orderkey % 9 END AS partner2,
               {_DAY} AS since, CASE WHEN o_orderkey % 5 = 0 THEN {_DAY} + 900 END AS dissolved,
               o_orderpriority AS kind, o_orderkey AS union_no
        FROM {{orders}}""",
    "ledger": """
        SELECT o_custkey AS id, CAST(l_shipdate AS DATE) AS d,
               CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS incurred,
               CASE WHEN l_returnflag = 'R' THEN -l_extendedprice * 0.4 END AS repaid,
               CASE WHEN l_returnflag = 'A' THEN -l_extendedprice * 0.4
                    WHEN l_orderkey % 29 = 0 AND l_returnflag = 'N' THEN l_extendedprice * 0.2 END AS written_off
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "case_txn": f"""
        SELECT o_custkey AS id, o_orderkey % 3 AS case_id, l_linestatus AS tax_type,
               CASE quarter({_TXN_DAY}) WHEN 1 THEN 'JAN' WHEN 2 THEN 'APR' WHEN 3 THEN 'JUL' ELSE 'OCT' END AS quarter_name,
               year({_TXN_DAY}) AS txn_year, CAST(date_trunc('quarter', {_TXN_DAY}) AS DATE) AS d,
               CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE -l_extendedprice * 0.6 END AS delta,
               CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS assessment,
               CASE WHEN l_returnflag = 'R' THEN -l_extendedprice * 0.6 END AS payment
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "coded_txn": """
        SELECT *, CONCAT(quarter_name, LPAD(CAST(txn_year - 2000 AS VARCHAR(9)), 2, '0')) AS code FROM [case_txn]""",
    "case_quarter": """
        SELECT id, case_id, tax_type, d, SUM(delta) AS delta, SUM(COALESCE(assessment, 0)) AS assessment,
               SUM(COALESCE(payment, 0)) AS payment
        FROM [case_txn] GROUP BY id, case_id, tax_type, d""",
    "case_balance": """
        SELECT id, case_id, tax_type, d, assessment, payment,
               SUM(delta) OVER (PARTITION BY id, case_id, tax_type ORDER BY d) AS balance
        FROM [case_quarter]""",
    "monthly_return": f"""
        SELECT o_custkey AS id, last_day({_DAY}) AS return_date, o_orderkey % 5 AS employer,
               CASE WHEN o_orderkey % 4 = 0 THEN last_day({_DAY}) - CAST(o_orderkey % 90 AS INT)
                    WHEN o_orderkey % 4 = 1 THEN last_day({_DAY}) + 3 END AS given_start,
               CASE WHEN o_orderkey % 6 < 3 THEN last_day({_DAY}) - CAST(o_orderkey % 40 AS INT)
                    WHEN o_orderkey % 6 = 3 THEN last_day({_DAY}) + 40 END AS given_end
        FROM {{orders}}""",
    "snapshot": f"""
        SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS seen,
               CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_orderkey % 3 END AS household,
               CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 5 END AS old_household
        FROM {{lineitem}}""",
    "sequence": """
        SELECT o_custkey AS id, o_orderkey % 4 AS seq, o_orderkey AS record_no FROM {orders}""",
    "code_table": """
        SELECT code, second_code, valid_from, valid_to,
               CONCAT(code, '/', COALESCE(second_code, '-'), '/', CAST(year(valid_from) AS VARCHAR(4))) AS level1
        FROM (SELECT DISTINCT o_orderpriority AS code,
                     CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS VARCHAR(9)) END AS second_code,
                     CASE WHEN o_orderstatus = 'F' THEN DATE '1990-01-01' ELSE DATE '1998-07-01' END AS valid_from,
                     CASE WHEN o_orderstatus = 'F' THEN DATE '1998-06-30' ELSE DATE '2000-12-31' END AS valid_to
              FROM {orders}) combination""",
    "coded_spell": """
        SELECT id, code, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 3 THEN 'null' ELSE CAST(id % 4 AS VARCHAR(9)) END AS extra,
               start_date, end_date
        FROM [spell]""",
    "population": """
        SELECT c_custkey AS id, c_mktsegment AS segment, '1998' AS period,
               DATE '1998-01-01' AS period_start, DATE '1998-12-31' AS period_end FROM {customer}
        UNION ALL
        SELECT c_custkey, c_mktsegment, '1999', DATE '1999-01-01', DATE '1999-12-31' FROM {customer}""",
    "wide": """
        SELECT c_custkey AS id, 1935 + c_custkey % 85 AS birth_year, c_mktsegment AS segment,
               CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance,
               CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal * (c_custkey % 3 - 1) END AS other_balance,
               CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal END AS repaid,
               CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 90 END AS score,
               CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 12 END AS level,
               CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 366 END AS days_a,
               CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 7 % 366 END AS days_b,
               CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 13 % 366 END AS days_c,
               CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 6 END AS children,
               CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS f_one,
               CASE WHEN c_custkey % 4 = 0 THEN 1 END AS f_two,
               CASE WHEN c_custkey % 10 = 7 THEN 2 WHEN c_custkey % 10 < 3 THEN 1 ELSE 0 END AS f_three,
               CASE WHEN c_custkey % 8 <> 0 THEN c_nationkey % 10 END AS deprivation,
               CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 5 END AS band,
               CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal + 1 END AS a_q1, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal END AS a_q2,
               CASE WHEN c_custkey % 5 <> 1 THEN c_acctbal + 3 END AS a_q3,
               CASE WHEN c_custkey % 6 = 1 THEN c_acctbal + 4 END AS b_q1, CASE WHEN c_custkey % 5 = 1 THEN c_acctbal END AS b_q2,
               CASE WHEN c_custkey % 7 = 1 THEN c_acctbal + 5 END AS b_q3
        FROM {customer}""",
    # ---- source tables of the measures ----------------------------------------------
    "residents_in": """
        SELECT o_custkey AS snz_uid, CAST(o_orderdate AS DATE) AS srp_ref_date FROM {orders}""",
    "persons": """
        SELECT id AS snz_uid, CASE WHEN id % 31 = 0 THEN 0 ELSE 1 END AS snz_person_ind,
               CASE WHEN id % 37 = 0 THEN 0 ELSE 1 END AS snz_spine_ind,
               CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN 2030 ELSE birth_year END AS snz_birth_year_nbr,
               CASE WHEN id % 107 = 0 THEN NULL ELSE birth_month END AS snz_birth_month_nbr,
               make_date(CAST(birth_year AS INT), CAST(birth_month AS INT), 15) AS snz_birth_date_proxy,
               CASE WHEN id % 91 = 0 THEN 2025 ELSE death_year END AS snz_deceased_year_nbr,
               CASE WHEN id % 77 = 0 THEN NULL ELSE death_month END AS snz_deceased_month_nbr,
               CASE WHEN id % 2 = 0 THEN 'D' ELSE 'M' END AS snz_deceased_date_source_code,
               parent1 AS snz_parent1_uid, parent2 AS snz_parent2_uid
        FROM [person]""",
    "study_people": """
        SELECT c_custkey AS snz_uid FROM {customer}""",
    "marriages": """
        SELECT partner1 AS partnr1_snz_uid, partner2 AS partnr2_snz_uid,
               CASE WHEN union_no % 47 = 0 THEN NULL ELSE since END AS dia_mar_marriage_date, dissolved AS dia_mar_disolv_order_date
        FROM [union_record] WHERE kind <> '5-LOW'""",
    "civil_unions": """
        SELECT partner1 AS partnr1_snz_uid, partner2 AS partnr2_snz_uid, since AS dia_civ_civil_union_date,
               dissolved AS dia_civ_disolv_order_date
        FROM [union_record] WHERE kind = '5-LOW'""",
    "births": """
        SELECT id AS snz_uid, parent1 AS parent1_snz_uid, parent2 AS parent2_snz_uid, birth_year AS dia_bir_birth_year_nbr,
               birth_month AS dia_bir_birth_month_nbr, CASE WHEN id % 23 = 0 THEN 'S' END AS dia_bir_still_birth_code
        FROM [person]""",
    "overseas": f"""
        SELECT o_custkey AS snz_uid, CAST({_LATER} AS TIMESTAMP) AS pos_applied_date,
               CAST(CASE WHEN o_orderkey % 67 = 0 THEN DATE '9999-12-31' ELSE {_LATER} + CAST(o_orderkey % 60 AS INT) END AS TIMESTAMP)
                   AS pos_ceased_date,
               CASE WHEN o_orderkey % 3 = 0 THEN 'y' ELSE 'n' END AS pos_first_arrival_ind,
               CASE WHEN o_orderkey % 4 = 0 THEN 'y' ELSE 'n' END AS pos_last_departure_ind, o_orderstatus AS pos_source_code
        FROM {{orders}}""",
    "returns": f"""
        SELECT o_custkey AS snz_uid, CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE o_custkey + 1000000 END AS snz_ird_uid,
               o_orderkey % 5 AS snz_employer_ird_uid, last_day({_LATER}) AS ir_ems_return_period_date,
               CASE WHEN o_orderkey % 4 = 0 THEN last_day({_LATER}) - CAST(o_orderkey % 90 AS INT) END AS ir_ems_employee_start_date,
               CASE WHEN o_orderkey % 6 < 3 THEN last_day({_LATER}) - CAST(o_orderkey % 40 AS INT) END AS ir_ems_employee_end_date,
               CASE WHEN o_orderkey % 7 < 3 THEN 'W&S' WHEN o_orderkey % 7 = 3 THEN 'WHP' WHEN o_orderkey % 7 = 4 THEN 'PEN'
                    ELSE 'BEN' END AS ir_ems_income_source_code
        FROM {{orders}}""",
    "enrolment": f"""
        SELECT o_custkey AS snz_uid, {_LATER} AS moe_enr_prog_start_date,
               {_LATER} + CAST(o_orderkey % 150 AS INT) - 4 AS moe_enr_prog_end_date
        FROM {{orders}}""",
    "targeted_training": f"""
        SELECT o_custkey AS snz_uid, {_LATER} AS moe_ttr_placement_start_date,
               {_LATER} + CAST(o_orderkey % 45 AS INT) AS moe_ttr_placement_end_date
        FROM {{orders}}""",
    "industry_training": f"""
        SELECT o_custkey AS snz_uid, {_LATER} AS moe_itl_start_date,
               CASE WHEN o_orderkey % 8 <> 0 THEN {_LATER} + CAST(o_orderkey % 300 AS INT) END AS moe_itl_end_date,
               o_orderkey % 2 AS moe_itl_level1_qual_awarded_nbr, o_orderkey % 3 - 1 AS moe_itl_level2_qual_awarded_nbr,
               o_orderkey % 4 - 2 AS moe_itl_level3_qual_awarded_nbr, o_orderkey % 5 - 3 AS moe_itl_level4_qual_awarded_nbr,
               o_orderkey % 6 - 4 AS moe_itl_level5_qual_awarded_nbr, o_orderkey % 7 - 5 AS moe_itl_level6_qual_awarded_nbr,
               o_orderkey % 9 - 7 AS moe_itl_level7_qual_awarded_nbr, o_orderkey % 11 - 9 AS moe_itl_level8_qual_awarded_nbr
        FROM {{orders}}""",
    "census_2018": """
        SELECT c_custkey AS snz_uid, 1940 + c_custkey % 60 AS cen_ind_birth_year_nbr,
               LPAD(CAST(c_custkey % 6 AS VARCHAR(9)), 2, '0') AS cen_ind_scdry_scl_qual_code,
               CASE WHEN c_custkey % 17 <> 0 THEN LPAD(CAST(c_custkey % 13 AS VARCHAR(9)), 2, '0') END AS cen_ind_standard_hst_qual_code
        FROM {customer}""",
    "census_2013": """
        SELECT c_custkey AS snz_uid, 1940 + c_custkey % 60 AS cen_ind_birth_year_nbr,
               CASE WHEN c_custkey % 19 <> 0 THEN LPAD(CAST(c_custkey % 5 AS VARCHAR(9)), 2, '0') END AS cen_ind_sndry_scl_qual_code,
               LPAD(CAST(c_custkey % 12 AS VARCHAR(9)), 2, '0') AS cen_ind_std_highest_qual_code
        FROM {customer}""",
    "student_qualification": """
        SELECT o_custkey AS snz_uid, year(o_orderdate) AS moe_sql_attained_year_nbr,
               CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 14 END AS moe_sql_nqf_level_code
        FROM {orders} WHERE o_orderstatus = 'F'""",
    "completion": """
        SELECT o_custkey AS snz_uid, year(o_orderdate) + 5 AS moe_com_year_nbr, o_orderkey % 12 AS moe_com_qual_level_code
        FROM {orders} WHERE o_orderstatus <> 'F'""",
    "survey": """
        SELECT c_custkey AS snz_uid, DATE '2016-04-01' + CAST(c_custkey % 300 AS INT) AS gss_pq_PQinterview_date,
               CASE WHEN c_custkey % 3 = 0 THEN 'GSS2016' ELSE 'GSS2014' END AS gss_pq_collection_code,
               LPAD(CAST(c_custkey % 11 AS VARCHAR(9)), 2, '0') AS gss_pq_feel_life_code,
               CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 12 AS VARCHAR(9)) END AS gss_pq_life_worthwhile_code,
               CAST(c_custkey % 71 AS VARCHAR(9)) AS gss_pq_ment_health_code, CAST(c_custkey % 70 AS VARCHAR(9)) AS gss_pq_phys_health_code,
               CAST(c_custkey % 4 AS VARCHAR(9)) AS gss_pq_item_300_limit_code, CAST(c_custkey % 6 AS VARCHAR(9)) AS gss_pq_not_pay_bills_time_code,
               CAST(c_custkey % 8 AS VARCHAR(9)) AS gss_pq_enough_inc_code, CAST(c_custkey % 78 AS VARCHAR(9)) AS gss_pq_material_wellbeing_code
        FROM {customer}""",
    "benefit_spell": f"""
        SELECT o_custkey AS snz_uid, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS msd_spel_servf_code,
               CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 4 AS VARCHAR(9)) END AS msd_spel_add_servf_code,
               CASE WHEN o_orderkey % 59 <> 0 THEN {_LATER} END AS msd_spel_spell_start_date,
               CASE WHEN o_orderkey % 29 <> 0 THEN {_LATER} + CAST(o_orderkey % 180 AS INT) - 3 END AS msd_spel_spell_end_date
        FROM {{orders}}""",
    "benefit_partner": f"""
        SELECT CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN o_custkey ELSE -o_custkey END AS snz_uid, o_custkey + 1 + o_orderkey % 2 AS partner_snz_uid, {_LATER} + 20 AS msd_ptnr_ptnr_from_date,
               CASE WHEN o_orderkey % 61 <> 0 THEN {_LATER} + CAST(o_orderkey % 250 AS INT) END AS msd_ptnr_ptnr_to_date
        FROM {{orders}}""",
    "benefit_codes": """
        SELECT code AS serv, second_code AS additional_service_data,
               valid_from + 6940 AS ValidFromtxt, valid_to + 6940 AS ValidTotxt,
               level1, CONCAT('two ', code) AS level2, COALESCE(second_code, 'none') AS level3,
               CASE WHEN second_code = '1' THEN 'Sickness' WHEN second_code = '2' THEN 'Invalids' ELSE 'Job Seeker' END AS level4
        FROM [code_table]""",
    "tenancy": """
        SELECT id AS snz_uid, CAST(date_trunc('month', seen + 6220) AS DATE) AS hnz_ths_snapshot_date,
               household AS snz_household_uid, old_household AS snz_legacy_household_uid
        FROM [snapshot]""",
    "management": f"""
        SELECT o_custkey AS snz_uid, o_orderkey % 4 AS cor_mmp_max_period_nbr,
               CASE WHEN o_orderkey % 7 < 2 THEN 'PRISON' WHEN o_orderkey % 7 = 2 THEN 'AGED_OUT' WHEN o_orderkey % 7 = 3 THEN 'ALIVE'
                    WHEN o_orderkey % 7 = 4 THEN 'REMAND' WHEN o_orderkey % 7 = 5 THEN 'NA' END AS cor_mmp_mmc_code,
               'a' AS cor_mmp_prev_mmc_code, 'b' AS cor_mmp_next_mmc_code, o_orderpriority AS cor_mmp_index_offence_code,
               o_orderkey % 900 AS cor_mmp_imposed_sentence_length_nbr, o_orderstatus AS cor_mmp_sentence_location_text,
               CASE WHEN o_orderkey % 73 <> 0 THEN {_DAY} END AS cor_mmp_period_start_date,
               {_DAY} + CAST(o_orderkey % 400 AS INT) - 6 AS cor_mmp_period_end_date
        FROM {{orders}}""",
    "police_links": f"""
        SELECT o_custkey AS snz_uid, CASE WHEN o_orderkey % 71 <> 0 THEN {_DAY} END AS nia_links_rec_date,
               o_orderstatus AS nia_links_role_type_text,
               CASE WHEN o_orderkey % 10 = 0 THEN '1D' ELSE CAST(1578 + o_orderkey % 12 AS VARCHAR(9)) END AS nia_links_latest_inc_off_code
        FROM {{orders}}""",
    "address": """
        SELECT o_custkey AS snz_uid, CAST(o_orderdate AS DATE) AS ant_notification_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 AS INT) AS ant_replacement_date,
               CASE WHEN o_orderkey % 39 <> 0 THEN o_orderkey % 500 END AS snz_idi_address_register_uid,
               LPAD(CAST(o_orderkey % 17 AS VARCHAR(9)), 2, '0') AS ant_region_code,
               CASE WHEN o_orderkey % 33 <> 0 THEN o_orderkey % 250 END AS ant_meshblock_code
        FROM {orders}""",
    "mb_concordance": """
        SELECT p_partkey AS MB2019_code, p_partkey + 5 AS MB2018_code, p_partkey + 9 AS MB2013_code FROM {part}""",
    "mb_geography": """
        SELECT CASE WHEN p_size > 5 THEN p_partkey END AS MB2018_V1_00, CAST(p_size AS VARCHAR(9)) AS IUR2018_V1_00, p_brand AS IUR2018_V1_00_NAME,
               CAST(p_partkey AS VARCHAR(9)) AS SA22018_V1_00, p_name AS SA22018_V1_00_NAME
        FROM {part}""",
    "mb_deprivation": """
        SELECT CASE WHEN p_size > 12 THEN p_partkey END AS Meshblock2013, p_size % 10 + 1 AS DepIndex2013, p_retailprice AS DepScore2013
        FROM {part}""",
    "income_summary": """
        SELECT o_custkey AS snz_uid, year(o_orderdate) AS inc_tax_yr_sum_year_nbr, """
    + ", ".join(
        f"ROUND(SUM(CASE WHEN o_orderkey % 18 = {i} THEN o_totalprice ELSE 0 END), 2) AS inc_tax_yr_sum_{c}_tot_amt"
        for i, c in enumerate("WAS WHP BEN ACC PEN PPL STU C00 C01 C02 P00 P01 P02 S00 S01 S02 S03 all_srces".split())
    )
    + """
        FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "insolvency": f"""
        SELECT o_custkey AS snz_uid, {_DAY} AS ir_xrf_applied_date,
               CASE WHEN o_orderkey % 3 = 0 THEN DATE '9999-12-31' ELSE {_DAY} + CAST(o_orderkey % 50 AS INT) - 8 END AS ir_xrf_ceased_date,
               CASE WHEN o_orderkey % 2 = 0 THEN 'BAN' ELSE 'OTH' END AS ir_xrf_reference_type_code,
               {_DAY} + 9 AS ir_xrf_ird_timestamp_date
        FROM {{orders}}""",
    "tax_customers": f"""
        SELECT o_custkey AS snz_uid, {_DAY} AS ir_cus_applied_date, {_DAY} + CAST(o_orderkey % 50 AS INT) - 8 AS ir_cus_ceased_date,
               CASE WHEN o_orderkey % 6 = 0 THEN 'B' WHEN o_orderkey % 6 = 1 THEN 'U' WHEN o_orderkey % 6 = 2 THEN 'R'
                    WHEN o_orderkey % 6 = 3 THEN 'L' ELSE 'A' END AS ir_cus_client_status_code,
               CASE WHEN o_orderkey % 5 = 0 THEN 'C' ELSE 'I' END AS ir_cus_entity_type_code
        FROM {{orders}}""",
    "concordance": """
        SELECT c_custkey + 500000 AS snz_uid, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey END AS snz_msd_uid,
               CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_custkey END AS snz_ird_uid
        FROM {customer}""",
    "benefit_ledger": f"""
        SELECT o_custkey AS snz_msd_uid, {_SHIPPED_LATER} AS debt_as_at_date, l_orderkey AS debt_id,
               CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS amount_incurred,
               CASE WHEN l_returnflag = 'R' THEN -l_extendedprice * 0.4 END AS amount_repaid,
               CASE WHEN l_returnflag = 'A' THEN -l_extendedprice * 0.4 END AS amount_written_off
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "assessed_txn": """
        SELECT id AS snz_ird_uid, case_id AS snz_dbt_case_uid,
               CASE WHEN case_id = 0 AND tax_type = 'O' THEN 'Child Support' WHEN case_id = 0 THEN 'Families' WHEN case_id = 1 THEN 'GST'
                    WHEN tax_type = 'O' THEN 'Income Tax' ELSE 'Student Loan' END AS dbt_tax_type,
               CONCAT(quarter_name, LPAD(CAST(txn_year + 2 - 2000 AS VARCHAR(9)), 2, '0')) AS dbt_date_processed,
               delta AS dbt_delta, assessment AS dbt_assessment, payment AS dbt_payment
        FROM [case_txn]""",
    "assessed_cases": f"""
        SELECT o_custkey AS snz_ird_uid, {_DAY} AS dbt_date_begin,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN DATE '9999-12-31'
                    ELSE {_DAY} + CAST(o_orderkey % 1500 AS INT) END AS dbt_date_end
        FROM {{orders}}""",
}

_REF = re.compile(r"\[(\w+)\]")
# A name in angle brackets is quoted the way the engine wants.
_NAME = re.compile(r"<([\w= ]+)>")


def _needed(names: list[str]) -> list[str]:
    """Inputs in the order they have to be defined."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _REF.findall(INPUTS[name]):
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def ctes(*names: str) -> str:
    """`name AS (...)` list for DuckDB."""
    tables = {t: t for t in TABLES}
    text = ",\n".join(f"{n} AS ({_REF.sub(r'\1', INPUTS[n]).format(**tables)})" for n in _needed(list(names)))
    return _NAME.sub(r'"\1"', text)


def oracle(text: str, *names: str) -> str:
    """Query over the named inputs. `text` may itself begin with further `name AS (...)` parts."""
    body = text.strip()
    return f"WITH {ctes(*names)}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"


def frame(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}
    inner = {}
    for n in _needed([name]):
        inner[n] = f"({_REF.sub(lambda m: inner[m.group(1)] + ' AS ' + m.group(1), INPUTS[n]).format(**tables)})"
    return spark.sql(_NAME.sub(r"`\1`", inner[name][1:-1]))


def _person_wide() -> str:
    """Wide person table with the columns the tidy step reads, some values missing, zero or out of range."""
    n = Names()
    columns = {
        "snz_uid": "c_custkey",
        "label_summary_period": "'2018'",
        "birth_year": "1935 + c_custkey % 85",
        "residential_population_indicator": "CASE WHEN c_custkey % 10 <> 9 THEN 1 END",
        "highest_qualification": "CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 13 END",
        "number_dependent_children": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 6 END",
        "family_violence_experience": "CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 END",
        "child_at_address": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 END",
        "bankrupt": "CASE WHEN c_custkey % 17 = 0 THEN 1 + c_custkey % 2 END",
        "deprivation": "CASE WHEN c_custkey % 8 <> 0 THEN c_nationkey % 10 + 1 END",
        "sex_code=1": "CASE WHEN c_custkey % 2 = 0 THEN 1 END",
        "sex_code=2": "CASE WHEN c_custkey % 2 = 1 THEN 1 END",
    }
    for i, c in enumerate([*n.ethnicities, "eth_other", "eth_MELAA"]):
        columns[c] = f"CASE WHEN c_custkey % {i + 3} < 2 THEN c_custkey % 2 ELSE 0 END"
    for i, c in enumerate(n.survey):
        columns[c] = f"CASE WHEN c_custkey % {i + 4} <> 0 THEN c_custkey * {i + 3} % 90 END"
    kinds = [k for _, ks in n.support for k in ks]
    for i, k in enumerate(kinds):
        columns[f"ben_type={k}"] = f"CASE WHEN c_custkey % {i + 5} < 2 THEN c_custkey % 3 END"
    for i, d in enumerate(n.days):
        columns[f"days_{d}"] = f"CASE WHEN c_custkey % {i + 4} <> 0 THEN c_custkey * {2 * i + 5} % 366 END"
    for i, c in enumerate(n.incomes):
        columns[c] = f"CASE WHEN c_custkey % {i + 4} <> 0 THEN c_acctbal * {i + 2} END"
    for i, q in enumerate(n.quarters):
        for j, a in enumerate((n.ledger, n.assessed)):
            columns[f"{a}_{q}"] = f"CASE WHEN (c_custkey + {i}) % {j + 4} < 2 THEN c_acctbal + {i * 37} END"
        for j, t in enumerate(n.tax_types):
            columns[f"{n.assessed}_Y{q}_{t}"] = f"CASE WHEN (c_custkey + {i}) % {j + 5} < 2 THEN c_acctbal - {i * 11} END"
    for j, a in enumerate((n.ledger, n.assessed)):
        columns[f"{a}_{n.year}_new_debt"] = f"CASE WHEN c_custkey % {j + 5} <> 0 THEN c_acctbal END"
        columns[f"{a}_{n.year}_repaid"] = f"CASE WHEN c_custkey % {j + 6} <> 0 THEN -c_acctbal END"
        columns[f"{a}_long_term_debtor"] = f"CASE WHEN c_custkey % {j + 7} = 0 THEN 1 END"
        columns[f"{a}_num_debts"] = f"CASE WHEN c_custkey % {j + 3} = 0 THEN 1 + c_custkey % 4 END"
    areas = ["Large urban area", "Major urban area", "Medium urban area", "Rural other", "Rural settlement", "Small urban area"]
    for i, area in enumerate(areas):
        columns[f"area_type={area}"] = f"CASE WHEN c_custkey % 7 = {i} THEN 1 END"
    for i, region in enumerate([*range(1, 10), *range(12, 19)]):
        columns[f"region_code={region:02}"] = f"CASE WHEN c_custkey % 17 = {i} THEN 1 END"
    events = [
        "audit_gss", "bankruptcy_process", "death_in_family", "employment_end", "end_official_relationship", "is_alive",
        "recent_migrant", "recent_parent", "sickness_benefit_start", "spine_indicator", "start_official_relationship",
    ]
    for i, event in enumerate(events):
        columns[event] = f"CASE WHEN c_custkey % {i + 3} < 2 THEN 1 END"
    # Both engines take names with blanks and `=` in their own quotes; see `frame` and `ctes`.
    return "SELECT " + ", ".join(f"{expr} AS <{name}>" for name, expr in columns.items()) + " FROM {customer}"


INPUTS["person_wide"] = _person_wide()

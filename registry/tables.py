"""Recodes of the wide table, and tabulation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from registry.build import i8, query, r2
from registry.inputs import frame
from registry.names import Names
from spanwise.functions import recode as V
from spanwise.plans import reports as P
from spanwise.plans import tabulate as G
from spanwise.plans.tidy import tidy_wide_table

# ---- recodes ------------------------------------------------------------------------


def _recode(name: str, sql: dict[str, str], columns) -> None:
    """A query of new columns of `wide`; `columns` gives the Spark ones by name."""

    @query(name, "SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + " FROM wide", ["wide"])
    def _(spark, sf):
        return frame(spark, sf, "wide").select("id", *[c.alias(n) for n, c in columns().items()])


_recode("v1_indicator", {"owes": i8("CASE WHEN balance > 0 THEN 1 END")}, lambda: {"owes": V.indicator(F.col("balance") > 0)})


@query("v2_null_at_or_above", f"SELECT id, {i8('CASE WHEN score >= 75 THEN NULL ELSE score END')} AS score, {i8('NULLIF(level, GREATEST(level, 75))')} AS level FROM wide", ["wide"])
def _(spark, sf):
    return V.null_at_or_above(frame(spark, sf, "wide").select("id", "score", "level"), ["score", "level"])


@query(
    "v3_null_below",
    f"""SELECT id, {r2('CASE WHEN balance < 1 THEN NULL ELSE balance END')} AS balance,
               {r2('CASE WHEN repaid > -1 THEN NULL ELSE -repaid END')} AS repaid FROM wide""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide").select("id", "balance", "repaid")
    return V.null_below(wide, ["balance"], repayments=["repaid"])


_recode(
    "v4_valid_range",
    {"level": i8("CASE WHEN level IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) THEN level END"),
     "working_level": i8("CASE WHEN level IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AND 2018 - birth_year >= 16 AND 2018 - birth_year <= 65 THEN level END")},
    lambda: {"level": V.valid_range(F.col("level"), 1, 10),
             "working_level": F.when((2018 - F.col("birth_year")).between(16, 65), V.valid_range(F.col("level"), 1, 10))},
)
_recode(
    "v5_cap",
    {"children": i8("CASE WHEN children IS NOT NULL THEN LEAST(children, 3) END"), "balance": r2("CASE WHEN balance IS NOT NULL THEN LEAST(balance, 5000) END")},
    lambda: {"children": V.cap(F.col("children"), 3), "balance": V.cap(F.col("balance"), 5000.0)},
)
_recode(
    "v6_age_band",
    {"age_cat": "CASE WHEN birth_year < 2018 - 65 THEN 'r' WHEN birth_year > 2018 - 16 THEN 'c' ELSE 'a' END"},
    lambda: {"age_cat": V.age_band(F.col("birth_year"), 2018)},
)
_recode(
    "v7_any_positive",
    {"any_f": i8("CASE WHEN COALESCE(f_one, 0) > 0 OR COALESCE(f_two, 0) > 0 OR COALESCE(f_three, 0) > 0 THEN 1 ELSE 0 END")},
    lambda: {"any_f": V.any_positive(["f_one", "f_two", "f_three"])},
)
_DAYS = ["days_a", "days_b", "days_c"]
_recode(
    "v8_main_activity",
    {f"main_{d}": i8(f"CASE WHEN {d} >= 180 AND " + " AND ".join(f"{d} > COALESCE({o}, 0)" for o in _DAYS if o != d) + " THEN 1 END") for d in _DAYS},
    lambda: {f"main_{d}": V.main_activity(_DAYS, d) for d in _DAYS},
)
_recode(
    "v9_round_to",
    {"days_r": r2("FLOOR(days_a / 30.0 + 0.5) * 30"), "balance_r": r2("ROUND(balance / 2000) * 2000")},
    lambda: {"days_r": V.round_to(F.col("days_a"), 30), "balance_r": V.round_to(F.col("balance"), 2000)},
)
_recode(
    "v10_at_least",
    {f"{d}_180": i8(f"CASE WHEN {d} >= 180 THEN 1 END") for d in _DAYS},
    lambda: {f"{d}_180": V.at_least(F.col(d), 180) for d in _DAYS},
)
_BUCKET = "CASE WHEN {x} > 0 THEN 100 + 200 * FLOOR({x} / 200) WHEN {x} < 0 THEN -100 - 200 * FLOOR(-{x} / 200) WHEN {x} = 0 THEN 0 END"
_recode(
    "v11_signed_bucket",
    {"change_r": r2(_BUCKET.format(x="(balance - other_balance)")), "balance_r": r2(_BUCKET.format(x="other_balance"))},
    lambda: {"change_r": V.signed_bucket(F.col("balance") - F.col("other_balance")), "balance_r": V.signed_bucket(F.col("other_balance"))},
)
_recode(
    "v12_floor_to",
    {"score_5": i8("score - score % 5"), "level_2": i8("level - level % 2")},
    lambda: {"score_5": V.floor_to(F.col("score"), 5), "level_2": V.floor_to(F.col("level"), 2)},
)


def _occupied(q: int) -> str:
    return f"(a_q{q} IS NOT NULL OR b_q{q} IS NOT NULL)"


_FLAGS = {}
for _q in (2, 3):
    _FLAGS[f"entry_q{_q}"] = i8(f"CASE WHEN NOT {_occupied(_q - 1)} AND {_occupied(_q)} THEN 1 END")
    _FLAGS[f"exit_q{_q}"] = i8(f"CASE WHEN {_occupied(_q - 1)} AND NOT {_occupied(_q)} THEN 1 END")
_FLAGS["any_entry"] = i8("CASE WHEN (NOT {0} AND {1}) OR (NOT {1} AND {2}) THEN 1 END".format(*[_occupied(q) for q in (1, 2, 3)]))


@query("v13_transitions", "SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in _FLAGS.items()) + " FROM wide", ["wide"])
def _(spark, sf):
    flags = V.transitions(["a", "b"], ["q1", "q2", "q3"])
    wide = frame(spark, sf, "wide").withColumns(flags)
    return wide.select("id", *flags, V.any_flag(["entry_q2", "entry_q3"]).alias("any_entry"))


_recode(
    "v14_amount_where",
    {"a_one": r2("CASE WHEN f_one = 1 THEN a_q1 END"), "a_two": r2("CASE WHEN f_two = 1 THEN a_q1 END")},
    lambda: {"a_one": V.amount_where(F.col("f_one"), F.col("a_q1")), "a_two": V.amount_where(F.col("f_two"), F.col("a_q1"))},
)
_recode(
    "v15_group_flags",
    {"debtor": i8("CASE WHEN balance > 0 OR other_balance > 0 THEN 1 END"),
     "debtor_both": i8("CASE WHEN balance > 0 AND other_balance > 0 THEN 1 END"),
     "short_term": i8("CASE WHEN f_two IS NULL AND balance > 0 THEN 1 END")},
    lambda: V.group_flags({
        "debtor": (F.col("balance") > 0) | (F.col("other_balance") > 0),
        "debtor_both": (F.col("balance") > 0) & (F.col("other_balance") > 0),
        "short_term": F.col("f_two").isNull() & (F.col("balance") > 0),
    }),
)

# ---- the whole tidy step ------------------------------------------------------------

_N = Names()


def _tidy_sql() -> tuple[str, list[str]]:
    """SQL parts that end in `tidy`, and its columns."""
    n, y = _N, _N.year
    led, ass = n.ledger, n.assessed
    q = '"{}"'.format
    age = f"({y} - birth_year)"
    clean = {
        "family_violence_experience": "CASE WHEN family_violence_experience >= 1 THEN 1 END",
        "child_at_address": "CASE WHEN child_at_address >= 1 THEN 1 END",
        "eth_other": "CASE WHEN eth_other + eth_MELAA > 0 THEN 1 END",
        "highest_qualification": f"CASE WHEN highest_qualification BETWEEN 1 AND 10 AND {age} BETWEEN 16 AND 65 THEN highest_qualification END",
        "number_dependent_children": "CASE WHEN number_dependent_children >= 3 THEN 3 ELSE number_dependent_children END",
    }
    clean |= {c: f"CASE WHEN {c} > 0 THEN 1 END" for c in n.ethnicities}
    clean |= {c: f"CASE WHEN {c} >= 75 THEN NULL ELSE {c} END" for c in n.survey}
    money = [*n.balances, *n.incomes, f"{led}_{y}_new_debt", f"{ass}_{y}_new_debt"]
    clean |= {c: f"CASE WHEN {c} < 1 THEN NULL ELSE {c} END" for c in money}
    clean |= {f"{a}_{y}_repaid": f"CASE WHEN {a}_{y}_repaid > -1 THEN NULL ELSE ABS({a}_{y}_repaid) END" for a in (led, ass)}

    derived = {"age_cat": f"CASE WHEN {age} > 65 THEN 'r' WHEN {age} < 16 THEN 'c' ELSE 'a' END"}
    for s, kinds in n.support:
        some = " OR ".join(f"COALESCE({q('ben_type=' + k)}, 0) > 0" for k in kinds)
        derived[f"ben_{s}"] = f"CASE WHEN {some} THEN 1 ELSE 0 END"
    acts = {"employed": "days_employed", "study": "days_study", "NEET": "days_neet"}
    for name, d in acts.items():
        more = " AND ".join(f"{d} > COALESCE({o}, 0)" for o in acts.values() if o != d)
        derived[f"main_activity_{name}"] = f"CASE WHEN {d} >= 180 AND {more} THEN 1 END"
    for d in n.days:
        derived[f"days_{d}_r"] = f"30 * FLOOR(days_{d} / 30.0 + 0.5)"
        derived[f"days_{d}_180"] = f"CASE WHEN days_{d} >= 180 THEN 1 END"
    for c in n.incomes:
        derived[f"{c}_r"] = f"2000 * ROUND({c} / 2000)"
    last, before = f"{y}Q4", f"{y - 1}Q4"
    pair = {"ird": (ass,), "msd": (led,), "dbt": (led, ass)}
    for out, agencies in pair.items():
        now = " + ".join(f"COALESCE({a}_{last}, 0)" for a in agencies)
        then = " + ".join(f"COALESCE({a}_{before}, 0)" for a in agencies)
        none_now = " AND ".join(f"{a}_{last} IS NULL" for a in agencies)
        none_both = " AND ".join(f"{a}_{p} IS NULL" for a in agencies for p in (last, before))
        derived[f"{out}_{last}_r"] = f"CASE WHEN NOT ({none_now}) THEN 2000 * ROUND(({now}) / 2000) END"
        derived[f"{out}_change_r"] = f"CASE WHEN NOT ({none_both}) THEN {_BUCKET.format(x=f'(({now}) - ({then}))')} END"
    for a in (led, ass):
        for f in ("new_debt", "repaid"):
            derived[f"{a}_{y}_{f}_r"] = f"100 + 200 * FLOOR({a}_{y}_{f} / 200)"
    for c, w in n.survey_steps:
        derived[c] = f"{w} * FLOOR({c} / {w}.0)"
    order = [before, *[f"{y}Q{i}" for i in (1, 2, 3, 4)]]
    for p, c in zip(order, order[1:], strict=False):
        had, has = (f"COALESCE({ass}_{x}, {led}_{x}) IS NOT NULL" for x in (p, c))
        derived[f"entry_{c[4:]}"] = f"CASE WHEN NOT ({had}) AND ({has}) THEN 1 END"
        derived[f"exit_{c[4:]}"] = f"CASE WHEN ({had}) AND NOT ({has}) THEN 1 END"

    more = {f"{k}_{y}": f"COALESCE({', '.join(f'{k}_Q{i}' for i in (1, 2, 3, 4))})" for k in ("entry", "exit")}
    for s, _ in n.support:
        for i in (1, 2, 3, 4):
            more[f"{led}_{s}_{y}Q{i}"] = f"CASE WHEN ben_{s} = 1 THEN {led}_{y}Q{i} END"

    msd, ird = f"COALESCE({led}_{last}, 0) > 0", f"COALESCE({ass}_{last}, 0) > 0"
    ben, kids = "days_benefit >= 180", "child_at_address = 1"
    rules = {
        "debtor_MSD": msd, "debtor_IRD": ird, "debtor_2_agencies": f"{msd} AND {ird}", "any_debt": f"({msd} OR {ird})",
        "entered_into_debt": f"entry_{y} = 1", "entered_into_debt_strict": f"entry_{y} = 1 AND exit_{y} IS NULL",
        "exited_from_debt": f"exit_{y} = 1", "exited_from_debt_strict": f"exit_{y} = 1 AND entry_{y} IS NULL",
        "went_bankrupt": "bankrupt = 1", "beneficiary_debtor": f"{ben} AND ({msd} OR {ird})",
        "beneficiary_debtor_in_hhld_w_kids": f"{ben} AND {kids} AND ({msd} OR {ird})",
        "debtor_in_hhld_w_kids": f"{kids} AND ({msd} OR {ird})", "whole_population": "residential_population_indicator = 1",
        "beneficiary": ben, "beneficiary_in_hhld_w_kids": f"{ben} AND {kids}", "in_hhld_w_kids": kids,
        "long_term_MSD_debtor": f"{led}_long_term_debtor >= 1", "short_term_MSD_debtor": f"{led}_long_term_debtor IS NULL AND {msd}",
        "long_term_IRD_debtor": f"{ass}_long_term_debtor >= 1", "short_term_IRD_debtor": f"{ass}_long_term_debtor IS NULL AND {ird}",
    }
    rules |= {f"debtor_IRD_{t}": f"{ass}_Y{last}_{t} > 0" for t in n.tax_types if t != "other"}
    rules |= {f"debtor_msd_{s}": f"{led}_{s}_{last} > 0" for s, _ in n.support if s != "OTH"}
    flags = {name: f"CASE WHEN {rule} THEN 1 END" for name, rule in rules.items()}

    steps, columns, source = [], [], "person_wide"
    for i, new in enumerate((clean, derived, more, flags)):
        replace = ", ".join(f"{e} AS {q(c)}" for c, e in new.items() if c in columns or i == 0)
        add = "".join(f", {e} AS {q(c)}" for c, e in new.items() if not (c in columns or i == 0))
        if i == 0:
            columns = list(dict.fromkeys([*clean]))
        columns = list(dict.fromkeys([*columns, *new]))
        steps.append(f"tidy{i} AS (SELECT *{f' REPLACE ({replace})' if replace else ''}{add} FROM {source})")
        source = f"tidy{i}"
    return ", ".join(steps) + f", tidy AS (SELECT * FROM {source})", columns


_TIDY, _TIDY_COLUMNS = _tidy_sql()
_AS_TEXT = {"age_cat"}
# Columns the tidy step leaves as they are.
_PLAIN_COLUMNS = ["birth_year", "residential_population_indicator", "bankrupt", "deprivation", "sex_code=1", "sex_code=2"]
_PLAIN_COLUMNS += [f"{a}_{what}" for a in (_N.ledger, _N.assessed) for what in ("long_term_debtor", "num_debts")]
_PLAIN_COLUMNS += [
    "area_type=Large urban area", "area_type=Major urban area", "area_type=Medium urban area", "area_type=Rural other",
    "area_type=Rural settlement", "area_type=Small urban area", *[f"region_code={r:02}" for r in (*range(1, 10), *range(12, 19))],
    "audit_gss", "bankruptcy_process", "death_in_family", "employment_end", "end_official_relationship", "is_alive",
    "recent_migrant", "recent_parent", "sickness_benefit_start", "spine_indicator", "start_official_relationship",
]


@query(
    "v_tidy_wide_table",
    _TIDY + " SELECT snz_uid, " + ", ".join(
        f'"{c}"' if c in _AS_TEXT else f'{r2(chr(34) + c + chr(34))} AS "{c}"' for c in _TIDY_COLUMNS
    ) + " FROM tidy",
    ["person_wide"],
)
def _(spark, sf):
    tidy = tidy_wide_table(frame(spark, sf, "person_wide"))
    # One numeric type for all, whatever the source column was.
    return tidy.selectExpr(
        "snz_uid", *[c if c in _AS_TEXT else f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in _TIDY_COLUMNS]
    )


# ---- tabulation ---------------------------------------------------------------------

_GROUPS = ["f_one", "f_two", "f_three"]
_MEMBERS = "member AS (" + " UNION ALL ".join(f"SELECT '{g}' AS group_name, id FROM wide WHERE {g} = 1" for g in _GROUPS) + ")"
_COUNTED = ["segment", "children", "level", "score"]
_SUMMED = ["balance", "other_balance", "repaid", "children"]


@query("g1_group_members", _MEMBERS + " SELECT group_name, id FROM member", ["wide"])
def _(spark, sf):
    return G.group_members(frame(spark, sf, "wide"), "id", _GROUPS)


_DISTRIBUTION = _MEMBERS + ", tab AS (" + " UNION ALL ".join(
    f"SELECT group_name, '{c}' AS measure, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM wide LEFT JOIN member USING (id) GROUP BY group_name, {c}"
    for c in _COUNTED
) + ")"


@query("g2_distribution_by_group", _DISTRIBUTION + " SELECT * FROM tab", ["wide"])
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    return G.distribution_by_group(wide, G.group_members(wide, "id", _GROUPS), "id", _COUNTED)


@query("g2_distribution_by_flags", _DISTRIBUTION + " SELECT * FROM tab", ["wide"])
def _(spark, sf):
    return G.distribution_by_group(frame(spark, sf, "wide"), _GROUPS, "id", _COUNTED)


@query(
    "g3_totals_by_group",
    _MEMBERS + " " + " UNION ALL ".join(
        f"SELECT group_name, '{c}' AS measure, {r2(f'SUM({c})')} AS total, COUNT({c}) AS count FROM wide LEFT JOIN member USING (id) GROUP BY group_name"
        for c in _SUMMED
    ).replace("SELECT", "SELECT", 1),
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    return G.totals_by_group(wide, G.group_members(wide, "id", _GROUPS), "id", _SUMMED)


@query(
    "g4_spread_groups",
    _DISTRIBUTION + " SELECT measure, value, " + ", ".join(
        f"CAST(MAX(count) FILTER (WHERE {w}) AS BIGINT) AS \"{n}\""
        for n, w in [*[(g, f"group_name = '{g}'") for g in _GROUPS], (G.NO_GROUP, "group_name IS NULL")]
    ) + " FROM tab GROUP BY measure, value",
    ["wide"],
)
def _(spark, sf):
    counts = G.distribution_by_group(frame(spark, sf, "wide"), _GROUPS, "id", _COUNTED)
    return G.spread_groups(counts, "count", groups=[*_GROUPS, G.NO_GROUP])


_XTAB_NUMBERS = {
    **{c: f"COALESCE({c}, 0)" for c in ("eth_asian", "eth_european", "eth_maori", "eth_other", "eth_pacific")},
    "sex_code=1": 'COALESCE("sex_code=1", 0)',
    "sex_code=2": 'COALESCE("sex_code=2", 0)',
    **{c: f"COALESCE({c}, 0)" for c in ("total_income", "BEN_income", "WAS_income")},
    **{c: c for c in ("birth_year", "deprivation", "highest_qualification", "life_satisfaction", "msd_2018Q4", "ird_2018Q4")},
    "has_WAS": "CASE WHEN WAS_income >= 1 THEN 1 ELSE 0 END",
    "has_OTH": "CASE WHEN COALESCE(total_income, 0) - COALESCE(WAS_income, 0) - COALESCE(BEN_income, 0) >= 10000 THEN 1 ELSE 0 END",
    "owes_msd": "CASE WHEN msd_2018Q4 >= 1 THEN 1 ELSE 0 END",
    "owes_ird": "CASE WHEN ird_2018Q4 >= 1 THEN 1 ELSE 0 END",
    "msd_2018_trim": "CASE WHEN msd_2018Q4 > 50000 THEN 50000 ELSE msd_2018Q4 END",
    "ird_2018_trim": "CASE WHEN ird_2018Q4 > 50000 THEN 50000 ELSE ird_2018Q4 END",
}
_XTAB_TEXT = {
    "sex": "CASE WHEN \"sex_code=1\" >= 1 THEN 'm' ELSE 'f' END",
    "total_income_band": """CASE WHEN COALESCE(total_income, 0) <= 0 THEN 'none' WHEN total_income > 100000 THEN '100k_up'
        WHEN total_income > 50000 THEN '50k_100k' WHEN total_income > 20000 THEN '20k_50k' WHEN total_income > 5000 THEN '5k_20k' ELSE '0_5k' END""",
    "highest_qual": """CASE WHEN highest_qualification BETWEEN 1 AND 4 THEN 'cert' WHEN highest_qualification BETWEEN 5 AND 7 THEN 'grad'
        WHEN highest_qualification BETWEEN 8 AND 10 THEN 'post' WHEN highest_qualification IS NULL AND birth_year >= 1953 THEN 'none' END""",
}


@query(
    "g5_prepare_crosstab",
    "SELECT " + ", ".join([*[f'{r2(e)} AS "{c}"' for c, e in _XTAB_NUMBERS.items()], *[f"{e} AS {c}" for c, e in _XTAB_TEXT.items()]])
    + " FROM person_wide WHERE birth_year <= 2002",
    ["person_wide"],
)
def _(spark, sf):
    tab = G.prepare_crosstab(frame(spark, sf, "person_wide"))
    return tab.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in _XTAB_NUMBERS], *_XTAB_TEXT)


def adjusted_sql(table: str, value: str, adjusters: list[str], name: str = "adjusted") -> str:
    """SQL parts that end in `name`, with column `adj`: one join to group means per adjuster."""
    parts = [f"{name}0 AS (SELECT *, CAST({value} AS DOUBLE) AS adj, AVG({value}) OVER () AS overall FROM {table} WHERE {value} IS NOT NULL)"]
    for i, a in enumerate(adjusters):
        parts.append(f"{name}m{i} AS (SELECT {a} AS k, AVG({value}) AS mean FROM {name}{i} WHERE {a} IS NOT NULL GROUP BY {a})")
        parts.append(f"{name}{i + 1} AS (SELECT t.* REPLACE (t.adj - mean + overall AS adj) FROM {name}{i} t JOIN {name}m{i} ON {a} = k)")
    parts.append(f"{name} AS (SELECT * FROM {name}{len(adjusters)})")
    return ", ".join(parts)


@query(
    "g6_adjusted_values",
    adjusted_sql("wide", "balance", ["deprivation", "band"]) + f" SELECT id, {r2('balance')} AS balance, {r2('adj')} AS adj FROM adjusted",
    ["wide"],
)
def _(spark, sf):
    return G.adjusted_values(frame(spark, sf, "wide"), "balance", ["deprivation", "band"]).select("id", "balance", "adj")


def means_sql(source: str, group: str, label: str) -> str:
    return f"""SELECT '{group}' AS col, CAST({group} AS VARCHAR) AS subgroup, '{label}' AS label, {r2('AVG(adj)')} AS mean,
        {r2('STDDEV_SAMP(adj)')} AS sdev, {r2('SUM(adj)')} AS total, COUNT(*) AS num FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}"""


@query(
    "g7_tabulate_means",
    adjusted_sql("wide", "balance", ["deprivation"]) + " " + means_sql("adjusted", "segment", "balance_adj_deprivation"),
    ["wide"],
)
def _(spark, sf):
    adjusted = G.adjusted_values(frame(spark, sf, "wide"), "balance", ["deprivation"])
    return G.tabulate_means(adjusted, "segment", G.sweep_label("balance", ["deprivation"]))


_SWEEP_GROUPS = ["segment", "f_two", "children"]
_SWEEP_VALUES = ["balance", "other_balance", "a_q1"]
_SWEEP_SETS = [[], ["deprivation"], ["band"], ["level"], ["deprivation", "band"], ["deprivation", "level", "band"]]


def _sweep_sql() -> str:
    defs, selects = [], []
    for i, (value, adjusters) in enumerate((v, a) for v in _SWEEP_VALUES for a in _SWEEP_SETS):
        defs.append(adjusted_sql("wide", value, adjusters, f"s{i}_"))
        selects += [means_sql(f"s{i}_", g, G.sweep_label(value, adjusters)) for g in _SWEEP_GROUPS]
    return ", ".join(defs) + " " + " UNION ALL ".join(selects)


@query("g8_mean_sweep", _sweep_sql(), ["wide"])
def _(spark, sf):
    return G.mean_sweep(frame(spark, sf, "wide"), _SWEEP_GROUPS, _SWEEP_VALUES, _SWEEP_SETS)


_PAIRED = ["segment", "children", "f_one", "f_two", "deprivation", "band"]


@query(
    "g9_pair_counts",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{a}' AS col1, CAST({a} AS VARCHAR) AS group1, '{b}' AS col2, CAST({b} AS VARCHAR) AS group2, COUNT(*) AS num
            FROM wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"""
        for a, b in combinations(_PAIRED, 2)
    ) + ")",
    ["wide"],
)
def _(spark, sf):
    return G.pair_counts(frame(spark, sf, "wide"), _PAIRED)


# ---- the published tables -----------------------------------------------------------

# Tidy table with every number as DOUBLE, so that both engines print values alike.
_ALL_COLUMNS = list(dict.fromkeys([*_PLAIN_COLUMNS, *_TIDY_COLUMNS]))
_TIDY_PLAIN = _TIDY + ", flat AS (SELECT snz_uid, " + ", ".join(
    f'"{c}"' if c in _AS_TEXT else f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _ALL_COLUMNS
) + " FROM tidy)"


def _tidy_plain(spark, sf):
    tidy = tidy_wide_table(frame(spark, sf, "person_wide"))
    return tidy.selectExpr(
        "snz_uid", *[c if c in _AS_TEXT else f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in _ALL_COLUMNS]
    )


# What is published, written out so that the twins do not depend on the library.
_REPORT_GROUPS = [
    "debtor_MSD", "debtor_IRD", "debtor_2_agencies", "any_debt", "entered_into_debt", "entered_into_debt_strict",
    "exited_from_debt", "exited_from_debt_strict", "went_bankrupt", "beneficiary_debtor", "beneficiary_debtor_in_hhld_w_kids",
    "debtor_in_hhld_w_kids", "whole_population", "beneficiary", "beneficiary_in_hhld_w_kids", "in_hhld_w_kids",
    "long_term_MSD_debtor", "short_term_MSD_debtor", "long_term_IRD_debtor", "short_term_IRD_debtor", "debtor_IRD_child_support",
    "debtor_IRD_families", "debtor_IRD_GST", "debtor_IRD_income_tax", "debtor_IRD_PAYE", "debtor_IRD_student_loan",
    "debtor_msd_JS", "debtor_msd_SPS", "debtor_msd_SLP", "debtor_msd_NZS", "main_activity_employed", "main_activity_study",
    "main_activity_NEET",
]
_REPORT_COUNTED = [
    "area_type=Large urban area", "area_type=Major urban area", "area_type=Medium urban area", "area_type=Rural other",
    "area_type=Rural settlement", "area_type=Small urban area", "region_code=01", "region_code=02", "region_code=03",
    "region_code=04", "region_code=05", "region_code=06", "region_code=07", "region_code=08", "region_code=09", "region_code=12",
    "region_code=13", "region_code=14", "region_code=15", "region_code=16", "region_code=17", "region_code=18", "audit_gss",
    "bankrupt", "bankruptcy_process", "birth_year", "child_at_address", "death_in_family", "deprivation", "employment_end",
    "end_official_relationship", "eth_other", "family_violence_experience", "highest_qualification", "is_alive",
    "number_dependent_children", "recent_migrant", "recent_parent", "residential_population_indicator", "sex_code=1",
    "sex_code=2", "sickness_benefit_start", "spine_indicator", "start_official_relationship", "eth_asian", "eth_european",
    "eth_maori", "eth_pacific", "life_satisfaction", "life_worthwhile", "mwi_afford_300_item", "mwi_enough_income",
    "mwi_material_wellbeing_index", "mwi_not_pay_bills_on_time", "sf12_mental_health", "sf12_physical_health", "ben_JS",
    "ben_SPS", "ben_SLP", "ben_NZS", "ben_OTH", "main_activity_employed", "main_activity_study", "main_activity_NEET",
    "days_benefit_r", "days_benefit_180", "days_corrections_any_r", "days_corrections_any_180", "days_corrections_prison_r",
    "days_corrections_prison_180", "days_dead_r", "days_dead_180", "days_employed_r", "days_employed_180", "days_neet_r",
    "days_neet_180", "days_overseas_r", "days_overseas_180", "days_sickness_benefit_r", "days_sickness_benefit_180",
    "days_social_housing_r", "days_social_housing_180", "days_study_r", "days_study_180", "entry_Q1", "entry_Q2", "entry_Q3",
    "entry_Q4", "entry_2018", "exit_Q1", "exit_Q2", "exit_Q3", "exit_Q4", "exit_2018", "total_income_r", "BEN_income_r",
    "ird_2018Q4_r", "msd_2018Q4_r", "dbt_2018Q4_r", "ird_change_r", "msd_change_r", "dbt_change_r", "ird_2018_new_debt_r",
    "ird_2018_repaid_r", "msd_2018_new_debt_r", "msd_2018_repaid_r", "ird_long_term_debtor", "ird_num_debts",
    "msd_long_term_debtor", "msd_num_debts",
]
_REPORT_SUMMED = [
    "BEN_income", "total_income", "ird_2017Q1", "ird_2017Q2", "ird_2017Q3", "ird_2017Q4", "ird_2018Q1", "ird_2018Q2",
    "ird_2018Q3", "ird_2018Q4", "msd_2017Q1", "msd_2017Q2", "msd_2017Q3", "msd_2017Q4", "msd_2018Q1", "msd_2018Q2", "msd_2018Q3",
    "msd_2018Q4", "ird_Y2017Q1_child_support", "ird_Y2017Q2_child_support", "ird_Y2017Q3_child_support",
    "ird_Y2017Q4_child_support", "ird_Y2018Q1_child_support", "ird_Y2018Q2_child_support", "ird_Y2018Q3_child_support",
    "ird_Y2018Q4_child_support", "ird_Y2017Q1_families", "ird_Y2017Q2_families", "ird_Y2017Q3_families", "ird_Y2017Q4_families",
    "ird_Y2018Q1_families", "ird_Y2018Q2_families", "ird_Y2018Q3_families", "ird_Y2018Q4_families", "ird_Y2017Q1_GST",
    "ird_Y2017Q2_GST", "ird_Y2017Q3_GST", "ird_Y2017Q4_GST", "ird_Y2018Q1_GST", "ird_Y2018Q2_GST", "ird_Y2018Q3_GST",
    "ird_Y2018Q4_GST", "ird_Y2017Q1_income_tax", "ird_Y2017Q2_income_tax", "ird_Y2017Q3_income_tax", "ird_Y2017Q4_income_tax",
    "ird_Y2018Q1_income_tax", "ird_Y2018Q2_income_tax", "ird_Y2018Q3_income_tax", "ird_Y2018Q4_income_tax", "ird_Y2017Q1_other",
    "ird_Y2017Q2_other", "ird_Y2017Q3_other", "ird_Y2017Q4_other", "ird_Y2018Q1_other", "ird_Y2018Q2_other", "ird_Y2018Q3_other",
    "ird_Y2018Q4_other", "ird_Y2017Q1_PAYE", "ird_Y2017Q2_PAYE", "ird_Y2017Q3_PAYE", "ird_Y2017Q4_PAYE", "ird_Y2018Q1_PAYE",
    "ird_Y2018Q2_PAYE", "ird_Y2018Q3_PAYE", "ird_Y2018Q4_PAYE", "ird_Y2017Q1_student_loan", "ird_Y2017Q2_student_loan",
    "ird_Y2017Q3_student_loan", "ird_Y2017Q4_student_loan", "ird_Y2018Q1_student_loan", "ird_Y2018Q2_student_loan",
    "ird_Y2018Q3_student_loan", "ird_Y2018Q4_student_loan", "msd_JS_2018Q1", "msd_JS_2018Q2", "msd_JS_2018Q3", "msd_JS_2018Q4",
    "msd_SPS_2018Q1", "msd_SPS_2018Q2", "msd_SPS_2018Q3", "msd_SPS_2018Q4", "msd_SLP_2018Q1", "msd_SLP_2018Q2", "msd_SLP_2018Q3",
    "msd_SLP_2018Q4", "msd_NZS_2018Q1", "msd_NZS_2018Q2", "msd_NZS_2018Q3", "msd_NZS_2018Q4", "msd_OTH_2018Q1", "msd_OTH_2018Q2",
    "msd_OTH_2018Q3", "msd_OTH_2018Q4", "msd_2018_new_debt", "msd_2018_repaid", "ird_2018_new_debt", "ird_2018_repaid",
]


def _quoted(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


# Every person once per group, and once without a group when in none.
_IN_GROUPS = """, grouped AS (
  SELECT f.*, g.group_name FROM flat f LEFT JOIN (
    SELECT snz_uid, group_name FROM (UNPIVOT (SELECT snz_uid, {groups} FROM flat) ON {groups} INTO NAME group_name VALUE member)
    WHERE member = 1) g USING (snz_uid))""".format(groups=_quoted(_REPORT_GROUPS))


@query(
    "g2_g4_group_counts",
    _TIDY_PLAIN + _IN_GROUPS + f""", cell AS (
      SELECT group_name, measure, value, COUNT(*) AS n FROM (
        SELECT group_name, measure, value FROM
          (SELECT group_name, {', '.join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in _REPORT_COUNTED)} FROM grouped)
          UNPIVOT INCLUDE NULLS (value FOR measure IN ({_quoted(_REPORT_COUNTED)}))) GROUP BY ALL)
      SELECT measure, value, """ + ", ".join(
        f"CAST(MAX(n) FILTER (WHERE group_name IS NOT DISTINCT FROM {w}) AS BIGINT) AS \"{g}\""
        for g, w in [*[(g, f"'{g}'") for g in _REPORT_GROUPS], (G.NO_GROUP, "NULL")]
    ) + " FROM cell GROUP BY measure, value",
    ["person_wide"],
)
def _(spark, sf):
    return P.group_counts(_tidy_plain(spark, sf))


@query(
    "g3_group_totals",
    _TIDY_PLAIN + _IN_GROUPS + f""" SELECT group_name, measure, {r2('SUM(value)')} AS total, COUNT(value) AS count FROM (
        SELECT group_name, measure, value FROM (SELECT group_name, {_quoted(_REPORT_SUMMED)} FROM grouped)
        UNPIVOT INCLUDE NULLS (value FOR measure IN ({_quoted(_REPORT_SUMMED)}))) GROUP BY group_name, measure""",
    ["person_wide"],
)
def _(spark, sf):
    return P.group_totals(_tidy_plain(spark, sf))


_XTAB = "xtab AS (SELECT " + ", ".join(
    [*[f'CAST({e} AS DOUBLE) AS "{c}"' for c, e in _XTAB_NUMBERS.items()], *[f"{e} AS {c}" for c, e in _XTAB_TEXT.items()]]
) + " FROM flat WHERE birth_year <= 2002)"
# Columns of the published cross-tabulations.
_MEAN_GROUPS = ["eth_asian", "eth_european", "eth_maori", "eth_other", "eth_pacific", "sex", "life_satisfaction"]
_MEAN_VALUES = ["owes_ird", "owes_msd", "ird_2018Q4", "msd_2018Q4", "ird_2018_trim", "msd_2018_trim"]
_SINGLE_ADJUSTERS = ["deprivation", "has_WAS", "has_OTH", "total_income_band", "highest_qual"]
_ADJUSTER_SETS = [
    [], *[[a] for a in _SINGLE_ADJUSTERS], ["deprivation", "total_income_band"], ["deprivation", "highest_qual"],
    ["deprivation", "highest_qual", "total_income_band"],
]
_PAIR_COLUMNS = [*_MEAN_GROUPS, "owes_ird", "owes_msd", *_SINGLE_ADJUSTERS]


def _report_means_sql() -> str:
    """One pass per value and adjuster set, all groups of it together."""
    defs, selects = [], []
    groups = ", ".join(f'CAST("{g}" AS VARCHAR) AS "{g}"' for g in _MEAN_GROUPS)
    for i, (value, adjusters) in enumerate((v, a) for v in _MEAN_VALUES for a in _ADJUSTER_SETS):
        defs.append(adjusted_sql("xtab", value, adjusters, f"s{i}_"))
        selects.append(f"""SELECT col, subgroup, '{G.sweep_label(value, adjusters)}' AS label, {r2('AVG(adj)')} AS mean,
            {r2('STDDEV_SAMP(adj)')} AS sdev, {r2('SUM(adj)')} AS total, COUNT(*) AS num
            FROM (UNPIVOT (SELECT adj, {groups} FROM s{i}_) ON {_quoted(_MEAN_GROUPS)} INTO NAME col VALUE subgroup) GROUP BY col, subgroup""")
    return ", ".join(defs) + " " + " UNION ALL ".join(selects)


@query("g9_crosstab_counts", _TIDY_PLAIN + ", " + _XTAB + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS col1, CAST({a} AS VARCHAR) AS group1, '{b}' AS col2, CAST({b} AS VARCHAR) AS group2, COUNT(*) AS num
        FROM xtab WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}""" for a, b in combinations(_PAIR_COLUMNS, 2)
) + ")", ["person_wide"])
def _(spark, sf):
    return _plain_text(P.crosstab_counts(_tidy_plain(spark, sf)), ["group1", "group2"])


@query("g8_crosstab_means", _TIDY_PLAIN + ", " + _XTAB + ", " + _report_means_sql(), ["person_wide"])
def _(spark, sf):
    return _plain_text(P.crosstab_means(_tidy_plain(spark, sf)), ["subgroup"])


def _plain_text(df, cols):
    """Whole numbers that Spark printed from INT columns in the form of a DOUBLE."""
    return df.withColumns({c: F.when(F.col(c).rlike("^-?[0-9]+$"), F.concat(c, F.lit(".0"))).otherwise(F.col(c)) for c in cols})

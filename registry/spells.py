"""Spell algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.build import i8, query, r2, sweep
from registry.inputs import frame
from spanwise.functions.dates import partial_date
from spanwise.operators import overlap as O
from spanwise.operators import spells as S

_OUT = "SELECT id, start_date, end_date FROM isl"


@query("s1_condense_spells", sweep("raw_spell", ["id"]) + _OUT, ["raw_spell"])
def _(spark, sf):
    return S.condense_spells(frame(spark, sf, "raw_spell"), "id")


@query("s1_condense_spells_drop_open", sweep("raw_spell", ["id"]) + _OUT + " WHERE year(end_date) <> 9999", ["raw_spell"])
def _(spark, sf):
    return S.condense_spells(frame(spark, sf, "raw_spell"), "id", open_ended="drop")


@query(
    "s2_condense_spells_touching",
    sweep("raw_spell", ["id", "code"], gap=0) + "SELECT id, code, start_date, end_date FROM isl",
    ["raw_spell"],
)
def _(spark, sf):
    return S.condense_spells(frame(spark, sf, "raw_spell"), ["id", "code"], gap_days=0)


_INVERT = """,
hole AS (SELECT id, end_date + 1 AS start_date,
                COALESCE((SELECT MIN(n.start_date) FROM isl n WHERE n.id = isl.id AND n.start_date > isl.end_date) - 1,
                         DATE '9999-01-01') AS end_date FROM isl
         UNION ALL SELECT id, DATE '1900-01-01', MIN(start_date) - 1 FROM isl GROUP BY id)
SELECT id, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM hole WHERE start_date <= end_date"""


@query("s3_invert_spells", sweep("spell", ["id"]) + _INVERT, ["spell"])
def _(spark, sf):
    return S.invert_spells(frame(spark, sf, "spell"), "id")


def gaps_sql(busy: str, bounds: str) -> str:
    """Gaps as the holes left when time outside the bounds is added to the busy time."""
    padded = f"""
win AS (SELECT * FROM {bounds} WHERE earliest_date <= latest_date),
pad AS (SELECT b.id, b.start_date, b.end_date FROM {busy} b JOIN win USING (id) WHERE b.start_date <= b.end_date
        UNION ALL SELECT id, DATE '0500-01-01', earliest_date - 1 FROM win
        UNION ALL SELECT id, latest_date + 1, DATE '9999-12-31' FROM win),"""
    return padded + sweep("pad", ["id"]) + """,
hole AS (SELECT id, end_date + 1 AS start_date, LEAD(start_date) OVER (PARTITION BY id ORDER BY start_date) - 1 AS end_date FROM isl)
SELECT id, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date FROM hole WHERE end_date IS NOT NULL"""


@query("s4_gaps_within_bounds", gaps_sql("busy", "bounds"), ["busy", "bounds"])
def _(spark, sf):
    return S.gaps_within_bounds(frame(spark, sf, "busy"), frame(spark, sf, "bounds"), "id")


@query(
    "s5_intersect_spells",
    f"""SELECT a.id, a.code, GREATEST(a.start_date, b.start_date) AS start_date, LEAST(a.end_date, b.end_date) AS end_date,
               {r2('a.v')} AS v, {i8('b.partner_id')} AS partner_id
        FROM spell a JOIN partner b ON a.id = b.id AND a.start_date <= b.end_date AND b.start_date <= a.end_date""",
    ["spell", "partner"],
)
def _(spark, sf):
    return O.intersect_spells(frame(spark, sf, "spell"), frame(spark, sf, "partner"), "id")


@query(
    "s6_restrict_spells",
    """SELECT id, start_date, end_date FROM spell WHERE start_date <= DATE '1998-12-31' AND end_date >= DATE '1998-01-01'""",
    ["spell"],
)
def _(spark, sf):
    kept = S.restrict_spells(frame(spark, sf, "spell"), "1998-01-01", "1998-12-31")
    return kept.select("id", "start_date", "end_date")


@query(
    "s7_snapshots_to_spells",
    """seen AS (SELECT DISTINCT id, seen, household, old_household FROM snapshot)
       SELECT DISTINCT a.id, a.seen AS start_date, b.seen AS end_date FROM seen a JOIN seen b ON a.id = b.id
       AND b.seen - a.seen BETWEEN 20 AND 40 AND (a.household = b.household OR a.old_household = b.old_household)""",
    ["snapshot"],
)
def _(spark, sf):
    return S.snapshots_to_spells(
        frame(spark, sf, "snapshot"), "id", "seen", ["household", "old_household"]
    )


_PERIOD_SQL = """CASE WHEN given_start < return_date AND return_date - given_start < 60 THEN given_start
              ELSE date_trunc('month', return_date) END"""
_PERIOD_END_SQL = """CASE WHEN given_end < return_date AND return_date - given_end < 27 AND COALESCE(given_start < given_end, TRUE)
              THEN given_end ELSE return_date END"""


@query(
    "s8_reporting_period_spells",
    f"""SELECT id, {i8('employer')} AS employer, CAST({_PERIOD_SQL} AS DATE) AS start_date, {_PERIOD_END_SQL} AS end_date
        FROM monthly_return""",
    ["monthly_return"],
)
def _(spark, sf):
    spells = S.reporting_period_spells(frame(spark, sf, "monthly_return"), "return_date", "given_start", "given_end")
    return spells.select("id", "employer", "start_date", "end_date")


@query(
    "s9_event_to_window",
    """SELECT id, end_date AS start_date, CAST(CASE WHEN year(end_date) = 9999 THEN end_date
              ELSE end_date + INTERVAL 2 YEAR END AS DATE) AS end_date FROM spell""",
    ["spell"],
)
def _(spark, sf):
    events = frame(spark, sf, "spell").select("id", F.col("end_date").alias("event_date"))
    return S.event_to_window(events, "event_date", 2).select("id", "start_date", "end_date")


@query(
    "s10_stack_roles",
    """SELECT id AS child, parent1 AS parent FROM person WHERE parent1 IS NOT NULL
       UNION ALL SELECT id, parent2 FROM person WHERE parent2 IS NOT NULL AND (parent1 IS NULL OR parent1 <> parent2)""",
    ["person"],
)
def _(spark, sf):
    people = frame(spark, sf, "person").select(F.col("id").alias("child"), "parent1", "parent2")
    return S.stack_roles(people, ["parent1", "parent2"], "parent").select("child", "parent")


@query(
    "s11_partial_date",
    """SELECT id, make_date(birth_year, birth_month, 15) AS born,
              CASE WHEN death_year IS NOT NULL THEN make_date(death_year, death_month, 28) END AS died,
              CASE WHEN birth_month <> 2 OR birth_year % 4 = 0 THEN make_date(birth_year, birth_month, 29) END AS day_29
       FROM person""",
    ["person"],
)
def _(spark, sf):
    return frame(spark, sf, "person").select(
        "id",
        partial_date(F.col("birth_year"), F.col("birth_month"), F.lit(15)).alias("born"),
        partial_date(F.col("death_year"), F.col("death_month"), F.lit(28)).alias("died"),
        partial_date(F.col("birth_year"), F.col("birth_month"), F.lit(29)).alias("day_29"),
    )


@query(
    "s12_keep_longest_sequence",
    """SELECT id, seq, record_no FROM sequence s WHERE seq = (SELECT MAX(seq) FROM sequence m WHERE m.id = s.id)""",
    ["sequence"],
)
def _(spark, sf):
    return S.keep_longest_sequence(frame(spark, sf, "sequence"), "id", "seq")


@query(
    "s13_terminal_events",
    f"""ends AS (SELECT id, employer, MAX(return_date) AS event_date FROM monthly_return GROUP BY id, employer)
       SELECT id, {i8('employer')} AS employer, event_date FROM ends e
       WHERE event_date < (SELECT MAX(return_date) FROM monthly_return m WHERE m.id = e.id)
       AND NOT EXISTS (SELECT 1 FROM monthly_return n WHERE n.id = e.id
                       AND date_trunc('month', n.return_date) = date_trunc('month', e.event_date) + INTERVAL 1 MONTH)""",
    ["monthly_return"],
)
def _(spark, sf):
    return S.terminal_events(frame(spark, sf, "monthly_return"), "id", "employer", "return_date")


@query(
    "s14_combine_sources",
    """SELECT id, start_date, end_date, 'own' AS source FROM spell
       UNION ALL SELECT id, start_date, end_date, 'paired' FROM partner""",
    ["spell", "partner"],
)
def _(spark, sf):
    return S.combine_sources(
        {"own": frame(spark, sf, "spell"), "paired": frame(spark, sf, "partner")}, ["id", "start_date", "end_date"]
    )


def roles_sql(spell: str, partner: str, detail: str) -> str:
    """SQL parts that end in `role_row`: every spell with the role held."""
    spans = "GREATEST(s.start_date, p.start_date) AS start_date, LEAST(s.end_date, p.end_date) AS end_date"
    meet = "s.start_date <= p.end_date AND p.start_date <= s.end_date"
    cols = ", ".join(f"s.{d.strip()}" for d in detail.split(","))
    return (
        sweep(partner, ["id", "partner_id"], 0, "pair")
        + ","
        + sweep("pair", ["id"], 1, "taken")
        + f""",
free AS (SELECT id, end_date + 1 AS start_date,
                COALESCE(LEAD(start_date) OVER (PARTITION BY id ORDER BY start_date) - 1, DATE '9999-01-01') AS end_date FROM taken
         UNION ALL SELECT id, DATE '1900-01-01', MIN(start_date) - 1 FROM taken GROUP BY id),
role_row AS (
  SELECT s.id, 'single' AS role, {spans}, {cols} FROM {spell} s JOIN free p ON s.id = p.id AND {meet} AND p.start_date <= p.end_date
  UNION ALL SELECT s.id, 'single', s.start_date, s.end_date, {cols} FROM {spell} s
            WHERE s.id NOT IN (SELECT id FROM {partner} WHERE start_date <= end_date) AND s.start_date <= s.end_date
  UNION ALL SELECT s.id, 'primary', {spans}, {cols} FROM {spell} s JOIN pair p ON s.id = p.id AND {meet}
  UNION ALL SELECT p.partner_id, 'partner', {spans}, {cols} FROM {spell} s JOIN {partner} p ON s.id = p.id AND {meet})"""
    )


@query(
    "s15_classify_roles",
    roles_sql("spell", "partner", "code")
    + " SELECT id, role, CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date, code FROM role_row",
    ["spell", "partner"],
)
def _(spark, sf):
    return S.classify_roles(frame(spark, sf, "spell").drop("v"), frame(spark, sf, "partner"), "id", "partner_id")


@query(
    "s16_lookup_valid_at",
    """SELECT s.id, s.code, s.extra, s.start_date, s.end_date, c.level1 FROM coded_spell s LEFT JOIN code_table c
       ON s.code = c.code AND (s.extra = c.second_code OR (c.second_code IS NULL AND COALESCE(s.extra, 'null') = 'null'))
       AND s.start_date BETWEEN c.valid_from AND c.valid_to""",
    ["coded_spell", "code_table"],
)
def _(spark, sf):
    return S.lookup_valid_at(
        frame(spark, sf, "coded_spell"),
        frame(spark, sf, "code_table"),
        ("code", "code"),
        ("extra", "second_code"),
        "start_date",
        "valid_from",
        "valid_to",
    )


def relatives_sql(people: str, unions: str) -> str:
    """SQL parts that end in `relation`: (id, event_date, relationship, deceased_id).

    `people` has id, parent1, parent2, died; `unions` has partner1, partner2.
    """
    return f"""
gone AS (SELECT id AS deceased_id, died AS event_date, parent1, parent2 FROM {people} WHERE died IS NOT NULL),
kin AS (SELECT id AS child, parent1 AS parent FROM {people} WHERE parent1 IS NOT NULL
        UNION ALL SELECT id, parent2 FROM {people} WHERE parent2 IS NOT NULL AND parent2 IS DISTINCT FROM parent1),
wed AS (SELECT partner1 AS a, partner2 AS b FROM {unions} WHERE partner1 <> partner2
        UNION ALL SELECT partner2, partner1 FROM {unions} WHERE partner1 <> partner2),
raised AS (SELECT DISTINCT 1 AS way, parent2 AS a, parent1 AS b FROM {people} WHERE parent1 <> parent2
           UNION ALL SELECT DISTINCT 2, parent1, parent2 FROM {people} WHERE parent1 <> parent2),
relation AS (
  SELECT k.parent AS id, g.event_date, 'child' AS relationship, g.deceased_id FROM gone g JOIN kin k ON k.child = g.deceased_id
  UNION ALL SELECT k.child, g.event_date, 'parent', g.deceased_id FROM gone g JOIN kin k ON k.parent = g.deceased_id
  UNION ALL SELECT o.child, g.event_date, 'sibling', g.deceased_id
            FROM gone g JOIN kin k ON k.child = g.deceased_id JOIN kin o ON o.parent = k.parent AND o.child <> k.child
  UNION ALL SELECT a, g.event_date, 'spouse', g.deceased_id FROM gone g JOIN wed ON b = g.deceased_id
  UNION ALL SELECT a, g.event_date, 'coparent', g.deceased_id FROM gone g JOIN raised ON b = g.deceased_id)"""


@query(
    "s17_relative_events",
    """people AS (SELECT id, parent1, parent2, CASE WHEN death_year IS NOT NULL THEN make_date(death_year, death_month, 28) END AS died
                  FROM person),"""
    + relatives_sql("people", "union_record")
    + " SELECT id, event_date, relationship, deceased_id FROM relation",
    ["person", "union_record"],
)
def _(spark, sf):
    people = frame(spark, sf, "person").select(
        "id", "parent1", "parent2", partial_date(F.col("death_year"), F.col("death_month"), F.lit(28)).alias("died")
    )
    return S.relative_events(
        people, frame(spark, sf, "union_record"), "id", "parent1", "parent2", "died", "partner1", "partner2"
    )


@query(
    "s18_as_at",
    "SELECT id, code, start_date, end_date FROM spell WHERE DATE '1999-06-30' BETWEEN start_date AND end_date",
    ["spell"],
)
def _(spark, sf):
    return S.as_at(frame(spark, sf, "spell"), "1999-06-30", "start_date", "end_date").drop("v")


@query(
    "s19_overlap_join",
    """SELECT p.id, p.segment, p.period, p.period_start, p.period_end, s.start_date AS right_start_date, s.end_date AS right_end_date
       FROM population p JOIN spell s ON p.id = s.id AND p.period_start <= s.end_date AND s.start_date <= p.period_end""",
    ["population", "spell"],
)
def _(spark, sf):
    return O.overlap_join(
        frame(spark, sf, "population"),
        frame(spark, sf, "spell").select("id", "start_date", "end_date"),
        "id",
        ("period_start", "period_end"),
    )

"""Sources and sinks, checks, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.build import i8, one_row, query, r2
from registry.inputs import frame
from spanwise.operators import checks as C
from spanwise.operators import reshape as R
from spanwise.sources import tables as IO

# ---- IO -----------------------------------------------------------------------------

_SPELL = f"SELECT id, code, start_date, end_date, {r2('v')} AS v FROM spell"


@query("io1_read_table", f"SELECT {i8('c_custkey')} AS id, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return IO.read_table(spark, f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )


@query("io2_write_table", _SPELL, ["spell"])
def _(spark, sf):
    return IO.write_table(frame(spark, sf, "spell"), IO.scratch_path(spark, "written"), overwrite=True)


@query("io3_materialise", _SPELL, ["spell"])
def _(spark, sf):
    return IO.materialise(frame(spark, sf, "spell"), ["id"])


@query("io4_append_table", f"{_SPELL} UNION ALL {_SPELL}", ["spell"])
def _(spark, sf):
    path = IO.scratch_path(spark, "appended")
    spells = frame(spark, sf, "spell")
    IO.write_table(spells, path)
    # Column order differs on purpose: rows are matched by name.
    return IO.append_table(spells.select("v", "end_date", "start_date", "code", "id"), path, spells.columns)


@query("io5_create_view", f"SELECT code, {i8('COUNT(*)')} AS n FROM spell GROUP BY code", ["spell"])
def _(spark, sf):
    IO.create_view(frame(spark, sf, "spell"), "spells_for_view", overwrite=True)
    return spark.sql("SELECT code, COUNT(*) AS n FROM spells_for_view GROUP BY code")


@query("io6_write_report", f"SELECT code, {i8('COUNT(*)')} AS n FROM spell GROUP BY code", ["spell"])
def _(spark, sf):
    path = IO.scratch_path(spark, "report")
    IO.write_report(frame(spark, sf, "spell").groupBy("code").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("code string, n long").option("header", True).csv(path)


@query("io7_dev_sample", f"{_SPELL} WHERE id % 100 = 0", ["spell"])
def _(spark, sf):
    return IO.dev_sample(frame(spark, sf, "spell"), "id")


# ---- checks -------------------------------------------------------------------------


@query("c1_num_rows", f"SELECT {i8('COUNT(*)')} AS n FROM lineitem")
def _(spark, sf):
    return one_row(spark, n=C.num_rows(spark.read.parquet(f"{sf}/lineitem.parquet")))


@query(
    "c2_num_unique",
    f"""SELECT (SELECT {i8('COUNT(*)')} FROM (SELECT DISTINCT level FROM wide)) AS one,
               (SELECT {i8('COUNT(*)')} FROM (SELECT DISTINCT level, score FROM wide)) AS two""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    return one_row(spark, one=C.num_unique(wide, "level"), two=C.num_unique(wide, ["level", "score"]))


@query(
    "c3_num_missing",
    f"""SELECT {i8('SUM(CASE WHEN score IS NULL THEN 1 ELSE 0 END)')} AS one,
               {i8('SUM(CASE WHEN score IS NULL THEN 1 ELSE 0 END) + SUM(CASE WHEN level IS NULL THEN 1 ELSE 0 END)')} AS both_cols
        FROM wide""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    return one_row(spark, one=C.num_missing(wide, "score"), both_cols=C.num_missing(wide, ["score", "level"]))


@query(
    "c4_check_size",
    """SELECT COUNT(*) > 1000 AS above, COUNT(*) <= 1000 AS not_above, COUNT(*) = 0 AS is_empty FROM orders""",
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return one_row(
        spark,
        above=C.check_size(orders, ">", 1000),
        not_above=C.check_size(orders, "<=", 1000),
        is_empty=C.check_size(orders, "==", 0),
    )


@query(
    "c5_check_size_comparison",
    """SELECT (SELECT COUNT(*) FROM orders) < (SELECT COUNT(*) FROM lineitem) AS fewer,
              (SELECT COUNT(*) FROM orders) = (SELECT COUNT(*) FROM lineitem) AS equal""",
)
def _(spark, sf):
    orders, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    return one_row(
        spark,
        fewer=C.check_size_comparison(orders, "<", lines),
        equal=C.check_size_comparison(orders, "==", lines),
    )


@query(
    "c6_check_size_uniques",
    """SELECT COUNT(DISTINCT o_orderpriority) = 5 AS five, COUNT(DISTINCT o_custkey) <> 5 AS not_five FROM orders""",
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return one_row(
        spark,
        five=C.check_size_uniques(orders, "o_orderpriority", "==", 5),
        not_five=C.check_size_uniques(orders, "o_custkey", "!=", 5),
    )


@query(
    "c7_check_all_unique",
    """SELECT (SELECT COUNT(*) = COUNT(DISTINCT o_orderkey) FROM orders) AS order_key,
              (SELECT COUNT(*) = COUNT(DISTINCT o_custkey) FROM orders) AS customer_key,
              (SELECT MAX(n) = 1 FROM (SELECT COUNT(*) AS n FROM population GROUP BY id, period)) AS person_period""",
    ["population"],
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return one_row(
        spark,
        order_key=C.check_all_unique(orders, "o_orderkey"),
        customer_key=C.check_all_unique(orders, "o_custkey"),
        person_period=C.check_all_unique(frame(spark, sf, "population"), ["id", "period"]),
    )


@query(
    "c8_check_join_covered",
    """SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_covered,
              NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS nations_covered,
              NOT EXISTS (SELECT 1 FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)) AS parts_covered""",
)
def _(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "customer", "nation", "part", "supplier")}
    return one_row(
        spark,
        orders_covered=C.check_join_covered(t["orders"], t["customer"], {"o_custkey": "c_custkey"}),
        nations_covered=C.check_join_covered(t["nation"], t["customer"], {"n_nationkey": "c_nationkey"}),
        parts_covered=C.check_join_covered(t["part"], t["supplier"], {"p_partkey": "s_suppkey"}),
    )


@query(
    "c9_check_size_missing",
    """SELECT SUM(CASE WHEN score IS NULL THEN 1 ELSE 0 END) > 0 AS has_missing,
              SUM(CASE WHEN id IS NULL THEN 1 ELSE 0 END) = 0 AS none_missing FROM wide""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide")
    return one_row(
        spark,
        has_missing=C.check_size_missing(wide, "score", ">", 0),
        none_missing=C.check_size_missing(wide, "id", "==", 0),
    )


@query(
    "c10_check_no_date_overlap",
    """numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id, start_date, end_date, v, code) AS rn FROM spell),
       pair AS (SELECT a.code = b.code AS same_code FROM numbered a JOIN numbered b
                ON a.id = b.id AND a.rn < b.rn AND a.start_date <= b.end_date AND b.start_date <= a.end_date)
       SELECT (SELECT COUNT(*) = 0 FROM pair) AS by_person,
              (SELECT COUNT(*) = 0 FROM pair WHERE same_code) AS by_person_code,
              (SELECT COUNT(*) = 0 FROM (
                 SELECT start_date, MAX(end_date) OVER (ORDER BY rn2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
                 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY start_date, end_date) AS rn2 FROM spell)) WHERE start_date <= until) AS ungrouped,
              (SELECT COUNT(*) = 0 FROM population a JOIN population b
               ON a.id = b.id AND a.period < b.period AND a.period_start <= b.period_end AND b.period_start <= a.period_end) AS periods""",
    ["spell", "population"],
)
def _(spark, sf):
    spell, population = frame(spark, sf, "spell"), frame(spark, sf, "population")
    return one_row(
        spark,
        by_person=C.check_no_date_overlap(spell, "start_date", "end_date", ["id"]),
        by_person_code=C.check_no_date_overlap(spell, "start_date", "end_date", ["id", "code"]),
        ungrouped=C.check_no_date_overlap(spell, "start_date", "end_date"),
        periods=C.check_no_date_overlap(population, "period_start", "period_end", "id"),
    )


@query(
    "c10_date_overlaps",
    """numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id, start_date, end_date, v, code) AS rn FROM spell)
       SELECT DISTINCT b.id, b.start_date FROM numbered a JOIN numbered b ON a.id = b.id AND a.rn <> b.rn
       AND a.start_date <= b.start_date AND b.start_date <= a.end_date""",
    ["spell"],
)
def _(spark, sf):
    return C.date_overlaps(frame(spark, sf, "spell"), "start_date", "end_date", ["id"])


# ---- reshaping ----------------------------------------------------------------------


@query(
    "t1_union_all",
    "SELECT id, start_date, end_date FROM spell UNION ALL SELECT id, start_date, end_date FROM partner",
    ["spell", "partner"],
)
def _(spark, sf):
    return R.union_all(frame(spark, sf, "spell"), frame(spark, sf, "partner"), ["id", "start_date", "end_date"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT = "SELECT id, " + ", ".join(
    f"{r2(f'''SUM(CASE WHEN code = '{p}' THEN v END)''')} AS \"{p}\"" for p in _PRIORITIES
) + " FROM spell GROUP BY id"


@query("t2_pivot_long", _PIVOT, ["spell"])
def _(spark, sf):
    return R.pivot_long(frame(spark, sf, "spell").select("id", "code", "v"), "code", "v", "sum", _PRIORITIES)


@query("t2_pivot_long_unlabelled", _PIVOT, ["spell"])
def _(spark, sf):
    return R.pivot_long(frame(spark, sf, "spell").select("id", "code", "v"), "code", "v")


@query(
    "t3_collapse_indicators",
    """SELECT id, segment, CASE WHEN f_one IN (1, 2) THEN 'one' WHEN f_three IN (1, 2) THEN 'three'
              WHEN f_two IN (1, 2) THEN 'two' END AS f FROM wide""",
    ["wide"],
)
def _(spark, sf):
    wide = frame(spark, sf, "wide").select("id", "segment", "f_one", "f_two", "f_three")
    return R.collapse_indicators(wide, "f_", [1, 2], label="f")

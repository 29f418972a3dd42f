"""Collecting queries with their SQL twins, and giving both sides the same types."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from registry.inputs import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def r2(expr: str) -> str:
    """SQL for a number to two places, ties up, the same in both engines."""
    return f"FLOOR(CAST({expr} AS DOUBLE) * 100 + 0.500001) / 100"


def i8(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, others to two places as `r2` does."""
    columns = []
    for field in df.schema:
        name = expr = f"`{field.name}`"
        if isinstance(field.dataType, T.IntegralType):
            expr = f"CAST({name} AS BIGINT)"
        elif isinstance(field.dataType, T.FractionalType):
            expr = f"CAST(FLOOR(CAST({name} AS DOUBLE) * 100D + 0.500001D) AS DOUBLE) / 100D"
        columns.append(f"{expr} AS {name}")
    return df.selectExpr(*columns)


def query(name: str, sql: str | None = None, inputs: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query. `sql` is completed with the definitions of `inputs`."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: comparable(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = oracle(sql, *inputs) if inputs else sql.strip()
        return fn

    return register


def one_row(spark: SparkSession, **values: bool | int) -> DataFrame:
    """Results of checks, which are Python values, as a one-row table."""
    kinds = [T.StructField(k, T.BooleanType() if isinstance(v, bool) else T.LongType()) for k, v in values.items()]
    return spark.createDataFrame([tuple(values.values())], T.StructType(kinds))


def sweep(source: str, keys: Sequence[str], gap: int = 1, name: str = "isl") -> str:
    """SQL parts that merge spells by counting how many are running.

    Each spell adds one on its first day and takes one off after its last; an
    island runs from a rise above zero to the next fall to zero. Times are half
    days, so that with `gap=0` a spell ending the day before does not touch.
    """
    k = ", ".join(keys)
    off = 2 if gap == 1 else 1
    zero = "DATE '1970-01-01'"
    return f"""
{name}_ev AS (
  SELECT {k}, 2 * (start_date - {zero}) AS t, 1 AS step FROM {source} WHERE start_date <= end_date
  UNION ALL
  SELECT {k}, 2 * (end_date - {zero}) + {off} AS t, -1 AS step FROM {source} WHERE start_date <= end_date),
{name}_at AS (SELECT {k}, t, SUM(step) AS step FROM {name}_ev GROUP BY {k}, t),
{name}_run AS (SELECT {k}, t, SUM(step) OVER (PARTITION BY {k} ORDER BY t) AS n FROM {name}_at),
{name}_edge AS (SELECT *, COALESCE(LAG(n) OVER (PARTITION BY {k} ORDER BY t), 0) AS before FROM {name}_run),
{name}_turn AS (SELECT *, LEAD(t) OVER (PARTITION BY {k} ORDER BY t) AS until FROM {name}_edge
                WHERE (n > 0) <> (before > 0)),
{name} AS (SELECT {k}, {zero} + CAST(t // 2 AS INT) AS start_date, {zero} + CAST((until - {off}) // 2 AS INT) AS end_date
           FROM {name}_turn WHERE n > 0)"""

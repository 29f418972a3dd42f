"""Checks on tables: `check_*` return True or False, `assert_*` raise AssertionError."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwise.functions.columns import as_list, named, require_columns

_COMPARE = {
    "==": operator.eq,
    "=": operator.eq,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "!=": operator.ne,
}


def _compare(left: int, direction: str, right: int) -> bool:
    if direction not in _COMPARE:
        raise ValueError(f"no such comparison: {direction!r}")
    return _COMPARE[direction](left, right)


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise AssertionError(message)


def num_rows(df: DataFrame) -> int:
    """C1."""
    return df.count()


def num_unique(df: DataFrame, cols: str | Sequence[str]) -> int:
    """C2. Distinct combinations; NULL counts as a value."""
    names = as_list(cols)
    require_columns(df, names)
    return df.select(*[named(c) for c in names]).distinct().count()


def num_missing(df: DataFrame, cols: str | Sequence[str]) -> int:
    """C3. NULLs summed over the columns, in one pass."""
    names = as_list(cols)
    require_columns(df, names)
    nulls = sum((named(c).isNull().cast("long") for c in names), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(nulls), F.lit(0))).first()[0]


def check_size(df: DataFrame, direction: str, size: int) -> bool:
    """C4."""
    return _compare(num_rows(df), direction, size)


def assert_size(df: DataFrame, direction: str, size: int) -> None:
    rows = num_rows(df)
    _require(_compare(rows, direction, size), f"table has {rows} rows, wanted {direction} {size}")


def check_size_comparison(df1: DataFrame, direction: str, df2: DataFrame) -> bool:
    """C5."""
    return _compare(num_rows(df1), direction, num_rows(df2))


def assert_size_comparison(df1: DataFrame, direction: str, df2: DataFrame) -> None:
    a, b = num_rows(df1), num_rows(df2)
    _require(_compare(a, direction, b), f"tables have {a} and {b} rows, wanted the first {direction} the second")


def check_size_uniques(df: DataFrame, cols: str | Sequence[str], direction: str, size: int) -> bool:
    """C6."""
    return _compare(num_unique(df, cols), direction, size)


def assert_size_uniques(df: DataFrame, cols: str | Sequence[str], direction: str, size: int) -> None:
    found = num_unique(df, cols)
    names = ", ".join(as_list(cols))
    _require(_compare(found, direction, size), f"{found} unique values of {names}, wanted {direction} {size}")


def check_all_unique(df: DataFrame, cols: str | Sequence[str]) -> bool:
    """C7. No combination of values occurs twice; one aggregation."""
    names = as_list(cols)
    require_columns(df, names)
    repeated = df.groupBy(*[named(c) for c in names]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return repeated.isEmpty()


def assert_all_unique(df: DataFrame, cols: str | Sequence[str]) -> None:
    _require(check_all_unique(df, cols), f"values of {', '.join(as_list(cols))} are not unique")


def _join_columns(join_cols: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    if isinstance(join_cols, Mapping):
        return list(join_cols.items())
    return [(c, c) for c in as_list(join_cols)]


def check_join_covered(df1: DataFrame, df2: DataFrame, join_cols: str | Sequence[str] | Mapping[str, str]) -> bool:
    """C8. Every key of df1 occurs in df2. Names may differ: `{left: right}`.

    Keys are made distinct first, so a common key is a single row on each side.
    """
    pairs = _join_columns(join_cols)
    require_columns(df1, [a for a, _ in pairs], "df1")
    require_columns(df2, [b for _, b in pairs], "df2")
    wanted = df1.select(*[named(a).alias(f"_l{i}") for i, (a, _) in enumerate(pairs)]).distinct()
    known = df2.select(*[named(b).alias(f"_r{i}") for i, (_, b) in enumerate(pairs)]).distinct()
    cond = [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(pairs))]
    return wanted.join(known, cond, "left_anti").isEmpty()


def assert_join_covered(df1: DataFrame, df2: DataFrame, join_cols: str | Sequence[str] | Mapping[str, str]) -> None:
    pairs = _join_columns(join_cols)
    left, right = ", ".join(a for a, _ in pairs), ", ".join(b for _, b in pairs)
    _require(
        check_join_covered(df1, df2, join_cols),
        f"join not covered: keys {left} hold values that are absent from {right}",
    )


def check_size_missing(df: DataFrame, cols: str | Sequence[str], direction: str, size: int) -> bool:
    """C9."""
    return _compare(num_missing(df, cols), direction, size)


def assert_size_missing(df: DataFrame, cols: str | Sequence[str], direction: str, size: int) -> None:
    found = num_missing(df, cols)
    names = ", ".join(as_list(cols))
    _require(_compare(found, direction, size), f"{found} values missing from {names}, wanted {direction} {size}")


def date_overlaps(df: DataFrame, start: str, end: str, group_cols: str | Sequence[str] | None = None) -> DataFrame:
    """Days, per group, on which a spell begins while another is running.

    Spells are reduced to one row per group and start day before ordering, so an
    empty group list (the whole table) orders at most one row per calendar day.
    """
    groups = [named(c) for c in as_list(group_cols)]
    require_columns(df, [start, end, *as_list(group_cols)])
    days = df.groupBy(*groups, named(start).alias("_s")).agg(
        F.max(named(end)).alias("_e"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(named(end).isNull().cast("int")).alias("_open"),
    )
    by_start = W.partitionBy(*groups).orderBy(F.col("_s").asc_nulls_first())
    earlier = by_start.rowsBetween(W.unboundedPreceding, -1)
    return (
        days.withColumn("_reached", F.max("_e").over(earlier))
        .withColumn("_open_before", F.sum("_open").over(earlier))
        .filter(
            (F.col("_n") > 1)
            | (F.col("_s") <= F.col("_reached"))
            | ((F.col("_open") > 0) & (F.col("_open_before") > 0))
        )
        .select(*groups, F.col("_s").alias(start))
    )


def check_no_date_overlap(
    df: DataFrame, start: str, end: str, group_cols: str | Sequence[str] | None = None
) -> bool:
    """C10. No two spells of a group share a day; an end on another's start is shared."""
    return date_overlaps(df, start, end, group_cols).isEmpty()


def assert_no_date_overlap(
    df: DataFrame, start: str, end: str, group_cols: str | Sequence[str] | None = None
) -> None:
    _require(
        check_no_date_overlap(df, start, end, group_cols),
        f"spells from {start} to {end} overlap within {', '.join(as_list(group_cols)) or 'the table'}",
    )

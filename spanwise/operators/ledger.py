"""Ledgers: running balances, balances per quarter, debt cases."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwise.functions.columns import as_list, named
from spanwise.functions.dates import OPEN_END, OPEN_YEAR, as_date
from spanwise.operators.skew import attach_group_stats, attach_summary, hot_keys, left_lookup

Quarters = Mapping[str, tuple[dt.date, dt.date]]


def _zero_if_null(name: str) -> Column:
    return F.coalesce(named(name), F.lit(0.0))


def daily_totals(df: DataFrame, keys: str | Sequence[str], date: str, amounts: Sequence[str]) -> DataFrame:
    """One row per key and day with each amount summed, missing amounts counted as nothing.

    Every per-key window below works on this form, so it holds at most one row
    per calendar day for a key.
    """
    return df.groupBy(*[named(k) for k in as_list(keys)], named(date)).agg(
        *[F.sum(_zero_if_null(a)).alias(a) for a in amounts]
    )


def running_balance(
    df: DataFrame,
    keys: str | Sequence[str],
    date: str,
    amounts: Sequence[str],
    into: str = "balance",
    one_per_day: bool = False,
    min_rows: int | None = None,
) -> DataFrame:
    """L2. Sum of all movements of the key up to and including the row's day.

    All rows of one day share the balance at the end of that day. Balances are sums over
    time of daily totals, which are few for any key, and rows take that of their key
    and day. So the rows of a common key spread over its days, and those of a common
    day of a key (`min_rows` sets from how many rows) over many tasks. `one_per_day`
    states that the input is already in the form of `daily_totals`; a plain window then does.
    """
    names = as_list(keys)
    moved = reduce(lambda a, b: a + b, [_zero_if_null(a) for a in amounts])
    by_date = W.partitionBy(*[named(k) for k in names]).orderBy(named(date))
    so_far = by_date.rowsBetween(W.unboundedPreceding, W.currentRow)
    if one_per_day:
        return df.withColumn(into, F.sum(moved).over(so_far))
    join_on = [*names, date]
    days = df.groupBy(*[named(c) for c in join_on]).agg(F.sum(moved).alias("_moved"), F.count(F.lit(1)).alias("_n"))
    balances = days.withColumn(into, F.sum("_moved").over(so_far))
    return attach_summary(df.drop(into), join_on, balances, days, [into], min_rows)


def lift_negative_cases(
    df: DataFrame,
    keys: str | Sequence[str],
    balance: str,
    threshold: float = -10.0,
    into: str = "balance_lifted",
    one_per_day: bool = False,
    min_rows: int | None = None,
) -> DataFrame:
    """L3. Where a case's lowest balance is below `threshold`, raise the whole case by it.

    `one_per_day` states that a case has at most one row per day, as above.
    """
    names = as_list(keys)
    lowest = F.min(named(balance))
    if one_per_day:
        marked = df.withColumn("_lowest", lowest.over(W.partitionBy(*[named(k) for k in names])))
    else:
        marked = attach_group_stats(df, names, {"_lowest": lowest}, min_rows)
    lift = F.when(F.col("_lowest") < threshold, F.abs("_lowest")).otherwise(F.lit(0.0))
    return marked.withColumn(into, named(balance) + lift).drop("_lowest")


def balance_validity(
    df: DataFrame, keys: str | Sequence[str], date: str, balance: str, floor: float = 10.0
) -> DataFrame:
    """L4. The last day each recorded balance holds, and its neighbours in time.

    Expects one row per key and date, as `daily_totals` gives. A balance at or
    below `floor` is not carried forward (`end_date` is NULL); the last record of
    a key is open-ended.
    """
    by_date = W.partitionBy(*[named(k) for k in as_list(keys)]).orderBy(named(date))
    neighbours = df.withColumns(
        {
            "lag_balance": F.lag(named(balance)).over(by_date),
            "lead_balance": F.lead(named(balance)).over(by_date),
            "lag_date": F.lag(named(date)).over(by_date),
            "lead_date": F.lead(named(date)).over(by_date),
        }
    )
    holds = F.coalesce(F.date_sub("lead_date", 1), as_date(OPEN_END))
    return neighbours.withColumn("end_date", F.when(named(balance) > floor, holds))


def _in_year(date: str, year: int) -> Column:
    return named(date).between(as_date(dt.date(year, 1, 1)), as_date(dt.date(year, 12, 31)))


def flow_columns(date: str, flows: Mapping[str, tuple[str, int]]) -> list[Column]:
    """Sum of an amount within one calendar year, per output name -> (amount, year)."""
    return [
        F.sum(F.when(_in_year(date, year), _zero_if_null(amount)).otherwise(0.0)).alias(name)
        for name, (amount, year) in flows.items()
    ]


def balance_at_quarters(
    df: DataFrame,
    keys: str | Sequence[str],
    date: str,
    balance: str,
    quarters: Quarters,
    end: str = "end_date",
    prefix: str = "",
    flows: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """L5. Per key, the balances in force at some time in each quarter, summed.

    One aggregation for all quarters; yearly flows may be added to the same pass.
    """
    sums = []
    for name, (first, last) in quarters.items():
        meets = (named(end) >= as_date(first)) & (named(date) <= as_date(last))
        sums.append(F.sum(F.when(meets, named(balance)).otherwise(0.0)).alias(prefix + name))
    return df.groupBy(*[named(k) for k in as_list(keys)]).agg(*sums, *flow_columns(date, flows or {}))


def cumulative_at_quarters(
    df: DataFrame,
    key: str | Sequence[str],
    date: str,
    amounts: Sequence[str],
    quarters: Quarters,
    min_abs: float = 1.0,
    prefix: str = "value_",
    flows: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """L6. Sum of all movements up to the end of each quarter, to the cent.

    Keys whose every quarter is closer to zero than `min_abs` are left out.
    """
    moved = reduce(lambda a, b: a + b, [_zero_if_null(a) for a in amounts])
    sums = [
        F.sum(F.when(named(date) <= as_date(last), moved).otherwise(0.0)).alias(prefix + name)
        for name, (_, last) in quarters.items()
    ]
    names = as_list(key)
    totals = df.groupBy(*[named(k) for k in names]).agg(*sums, *flow_columns(date, flows or {}))
    material = reduce(lambda a, b: a | b, [F.abs(named(prefix + q)) >= min_abs for q in quarters])
    values = [c for c in totals.columns if c not in names]
    return totals.filter(material).select(
        *[named(k) for k in names], *[F.round(named(c), 2).alias(c) for c in values]
    )


def flow_in_year(
    df: DataFrame, keys: str | Sequence[str], date: str, year: int, incurred: str, repaid: str
) -> DataFrame:
    """L7. Amounts incurred and repaid within one calendar year, per key."""
    flows = {f"incurred_{year}": (incurred, year), f"repaid_{year}": (repaid, year)}
    return df.groupBy(*[named(k) for k in as_list(keys)]).agg(*flow_columns(date, flows))


def debt_cases(
    df: DataFrame,
    key: str,
    date: str,
    incurred: str,
    repaid: str,
    written_off: str,
    tolerance: float = 10.0,
    start: str = "debt_start_date",
    end: str = "debt_end_date",
) -> DataFrame:
    """L8. Each day with new debt opens a case.

    It closes on the first day from then on when all debt up to the opening plus
    all payments up to that day come to `tolerance` or less. Payments may be
    reversed, so paid-to-date is not monotone and the first qualifying day has to
    be searched for. A key's days are kept per calendar year with the lowest
    paid-to-date of the year: the search passes over years and then over the days
    of one year, never over all days. A key holds at most one entry per calendar
    day, and the movements are read and shuffled once.
    """
    days = df.groupBy(named(key).alias("_key"), named(date).alias("_day")).agg(
        F.sum(_zero_if_null(incurred)).alias("_in"),
        F.sum(_zero_if_null(repaid) + _zero_if_null(written_off)).alias("_out"),
        F.count(named(incurred)).alias("_new"),
    )
    by_day = W.partitionBy("_key").orderBy("_day").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Rounded well below a cent, so that the order of addition does not decide a case.
    owed, paid = (F.round(F.sum(c).over(by_day), 6) for c in ("_in", "_out"))
    state = days.select(
        "_key",
        "_day",
        F.year("_day").alias("_year"),
        paid.alias("_paid"),
        F.when(F.col("_new") > 0, F.round(F.lit(tolerance) - owed, 6)).alias("_target"),
    )
    by_year = state.groupBy("_key", "_year").agg(
        F.min("_paid").alias("_low"),
        F.array_sort(F.collect_list(F.struct(F.col("_day").alias("day"), F.col("_paid").alias("paid")))).alias("_days"),
        F.collect_list(
            F.when(F.col("_target").isNotNull(), F.struct(F.col("_day").alias("day"), F.col("_target").alias("target")))
        ).alias("_opened"),
    )
    year = F.struct(F.col("_year").alias("year"), F.col("_low").alias("low"), F.col("_days").alias("days"))
    histories = by_year.groupBy("_key").agg(
        F.array_sort(F.collect_list(year)).alias("_years"), F.flatten(F.collect_list("_opened")).alias("_opened")
    )

    def closing(opened: Column) -> Column:
        this_year = F.get(F.filter("_years", lambda y: y["year"] == F.year(opened["day"])), 0)["days"]
        in_this = F.filter(this_year, lambda p: (p["day"] >= opened["day"]) & (p["paid"] <= opened["target"]))
        later = F.filter(
            "_years", lambda y: (y["year"] > F.year(opened["day"])) & (y["low"] <= opened["target"])
        )
        in_later = F.filter(F.get(later, 0)["days"], lambda p: p["paid"] <= opened["target"])
        return F.coalesce(F.get(in_this, 0)["day"], F.get(in_later, 0)["day"], as_date(OPEN_END))

    cases = F.transform("_opened", lambda o: F.struct(o["day"].alias("start"), closing(o).alias("end")))
    return histories.select(F.col("_key").alias(key), F.explode(cases).alias("_c")).select(
        named(key), F.col("_c.start").alias(start), F.col("_c.end").alias(end)
    )


def case_duration(df: DataFrame, start: str, end: str, long_days: int = 1000) -> DataFrame:
    """L9. Length of closed cases and a flag for the long ones."""
    closed = df.filter(
        named(end).isNotNull() & (F.year(named(end)) != OPEN_YEAR) & (named(start) != named(end))
    )
    days = F.datediff(named(end), named(start))
    return closed.withColumns({"days_debt": days, "long_term_debt": F.when(days > long_days, 1).otherwise(0)})


def link_ids(
    df: DataFrame, concordance: DataFrame, key: str, spine: str, many_per_key: bool = True, min_rows: int | None = None
) -> DataFrame:
    """L10. Put the spine identity in front; rows without a link keep a NULL one.

    The concordance has one row per identity, `df` may have any number: common ones are
    spread, found by a pass over the key column. `many_per_key=False` states that `df`
    has at most one row per identity and type or day, and saves that pass. Rows
    without an identity are spread in either case.
    """
    link = concordance.select(named(key).alias("_link"), named(spine))
    hot = hot_keys(df.filter(named(key).isNotNull()), [key], min_rows) if many_per_key else None
    joined = left_lookup(df, link, key, "_link", hot)
    return joined.select(named(spine), *[named(c) for c in df.columns])


def spread_by_type(
    df: DataFrame, type_col: str, types: Mapping[str, str], value_cols: Sequence[str]
) -> DataFrame:
    """L11. A copy of each value column per type, zero on rows of other types."""
    copies = {
        f"{value}_{suffix}": F.when(named(type_col) == name, named(value)).otherwise(0.0)
        for name, suffix in types.items()
        for value in value_cols
    }
    return df.withColumns(copies)

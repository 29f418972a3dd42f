"""Column recodes for wide person-period tables.

"Nothing" is NULL rather than zero throughout, so that counting values counts ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named


def indicator(condition: Column) -> Column:
    """V1. 1 where the condition holds, else NULL."""
    return F.when(condition, 1)


def null_at_or_above(df: DataFrame, cols: Sequence[str], limit: float = 75) -> DataFrame:
    """V2. Drop codes from `limit` up (non-response) from each column."""
    return df.withColumns({c: F.when(named(c) < limit, named(c)) for c in cols})


def null_below(df: DataFrame, cols: Sequence[str], limit: float = 1, repayments: Sequence[str] = ()) -> DataFrame:
    """V3. Drop amounts below `limit`; repayments are negative and come out positive."""
    changed = {c: F.when(named(c) >= limit, named(c)) for c in cols}
    changed |= {c: F.when(named(c) <= -limit, F.abs(named(c))) for c in repayments}
    return df.withColumns(changed)


def valid_range(value: Column, low: float, high: float, whole: bool = True) -> Column:
    """V4. The value when within [low, high] (and whole), else NULL."""
    ok = value.between(low, high)
    if whole:
        ok = ok & (value == F.floor(value))
    return F.when(ok, value)


def cap(value: Column, limit: float) -> Column:
    """V5. Top-code; NULL stays NULL."""
    return F.when(value > limit, F.lit(limit)).otherwise(value)


def age_band(birth_year: Column, year: int, child_below: int = 16, retired_above: int = 65) -> Column:
    """V6. `c` child, `a` adult, `r` retiree."""
    age = F.lit(year) - birth_year
    return F.when(age > retired_above, "r").when(age < child_below, "c").when(age.isNotNull(), "a")


def any_positive(cols: Sequence[str]) -> Column:
    """V7. 1 when any of the columns is above zero, else 0."""
    return F.when(reduce(lambda a, b: a | b, [named(c) > 0 for c in cols]), 1).otherwise(0)


def main_activity(cols: Sequence[str], which: str, min_days: int = 180) -> Column:
    """V8. 1 when `which` has strictly more days than each other column and at least `min_days`."""
    days = {c: F.coalesce(named(c), F.lit(0)) for c in cols}
    longest = reduce(lambda a, b: a & b, [days[which] > days[c] for c in cols if c != which])
    return indicator(longest & (days[which] >= min_days))


def round_to(value: Column, width: float) -> Column:
    """V9. Nearest multiple of `width`."""
    return F.round(value / width) * width


def at_least(value: Column, limit: float = 180) -> Column:
    """V10. 1 from `limit` up, else NULL."""
    return indicator(value >= limit)


def signed_bucket(value: Column, width: float = 200) -> Column:
    """V11. Middle of the bucket of `width` the value falls in; zero is a bucket of its own.

    With width 200: 1..199 -> 100, -1..-199 -> -100, 0 -> 0.
    """
    return F.signum(value) * (F.lit(width / 2) + F.floor(F.abs(value) / width) * width)


def floor_to(value: Column, width: float) -> Column:
    """V12. Largest multiple of `width` not above the value."""
    return F.floor(value / width) * width


def transitions(
    sources: Sequence[str], periods: Sequence[str], entry: str = "entry_", leave: str = "exit_"
) -> dict[str, Column]:
    """V13. Entry and exit flags between neighbouring periods.

    A period is occupied when any `<source>_<period>` column has a value. The flag
    is named after the later period.
    """

    def occupied(period: str) -> Column:
        return reduce(lambda a, b: a | b, [named(f"{s}_{period}").isNotNull() for s in sources])

    flags = {}
    for before, now in zip(periods, periods[1:], strict=False):
        flags[entry + now] = indicator(~occupied(before) & occupied(now))
        flags[leave + now] = indicator(occupied(before) & ~occupied(now))
    return flags


def any_flag(cols: Sequence[str]) -> Column:
    """1 when any of the flags is set, else NULL."""
    return indicator(F.coalesce(*[named(c) for c in cols]).isNotNull())


def amount_where(flag: Column, amount: Column) -> Column:
    """V14. The amount on rows where the flag is 1, else NULL."""
    return F.when(flag == 1, amount)


def group_flags(rules: Mapping[str, Column | str]) -> dict[str, Column]:
    """V15. One 1/NULL flag per named rule, given as a column or as SQL text."""
    return {name: indicator(F.expr(rule) if isinstance(rule, str) else rule) for name, rule in rules.items()}

"""Small helpers for naming columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Column by literal name; wide tables hold names such as `kind=a b`."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(cols: str | Iterable[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "table") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")

"""Keeping one very common key from landing in one task.

Two means are used across the library:

* spells and ledgers are day-grained, so rows of a key are first collapsed to
  one per day by an aggregation with map-side combine.  A window over the key
  then sees at most one row per calendar day, however common the key is;
* where whole rows must meet another table, the most common keys are found
  with a counting pass over the key column and only those keys are spread over
  many tasks.  Each of them holds more than a fixed share of all rows, so there
  cannot be many, and broadcasting their list is safe at any data size; every
  other key joins in the usual way, and holds at most that share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.columns import named

# A key below this many rows is never worth spreading.
HOT_ROWS = 1_000_000
# A key is common only if it holds 1/HOT_SHARE of all rows, so there are at most
# HOT_SHARE of them, and none is left off the list.
HOT_SHARE = 20_000
# Number of tasks a common key is spread over.
SALTS = 256

_SALT = "_salt"
PARTS = ("_lpart", "_rpart")
_UNSTEADY = (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """All keys with at least `min_rows` rows and 1/HOT_SHARE of all: at most HOT_SHARE rows."""
    return _hot_from_counts(df.groupBy(*[named(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")), keys, min_rows)


def _hot_from_counts(counts: DataFrame, keys: Sequence[str], min_rows: int | None) -> DataFrame:
    return counts.filter(F.col("_n") >= least_rows(counts, min_rows)).select(
        *[named(k).alias(f"_hot_{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot")
    )


def flag_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add boolean `_hot`. `hot` comes from `hot_keys`, hence is short enough to broadcast."""
    cond = [named(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)]
    joined = df.join(F.broadcast(hot), cond, "left")
    return joined.select(*[named(c) for c in df.columns], F.coalesce("_hot", F.lit(False)).alias("_hot"))


def row_draw(df: DataFrame) -> Column:
    """Repeatable 64-bit draw for each row, also for identical copies.

    The value depends on the row and on the partition it is read in, both of
    which are the same when a lost task is run again. Fractions are left out: a sum
    of them may differ in its last digits then. Rows alike in all else spread by
    partition only, and so do rows of fractions alone.
    """
    steady = [named(f.name) for f in df.schema if not isinstance(f.dataType, _UNSTEADY)]
    return F.xxhash64(*steady, F.spark_partition_id())


def row_salt(df: DataFrame, salts: int) -> Column:
    """Repeatable spread of rows over `salts` numbers, see `row_draw`."""
    return F.pmod(row_draw(df), F.lit(salts)).cast("int")


def salted(
    many: DataFrame, few: DataFrame, keys: Sequence[str], hot: DataFrame, salts: int = SALTS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Prepare an equi-join on `keys` so that common keys spread over `salts` tasks.

    Rows of `many` with a common key draw a salt; rows of `few` with that key are
    repeated once per salt. Joining the results on `keys` plus the returned salt
    column gives the same pairs as joining the inputs on `keys`.
    """
    spread = flag_hot(many, keys, hot)
    spread = spread.withColumn(_SALT, F.when(F.col("_hot"), row_salt(many, salts)).otherwise(F.lit(0))).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    repeated = flag_hot(few, keys, hot)
    repeated = repeated.withColumn(
        _SALT, F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return spread, repeated, [_SALT]


def dealt(df: DataFrame, cells: DataFrame, same: Sequence[Column], columns: Sequence[Column], draw: Column, is_left: bool) -> DataFrame:
    """`columns` of each row with the numbers of the parts that it belongs to and meets, as `PARTS`.

    `cells` tells by `_lparts` and `_rparts` into how many parts the rows of either side
    are cut, `same` which cell is a row's own; other rows are in one part. A row belongs to
    the part of its side that `draw` picks, and comes once to each part of the other side.
    """
    own, other = ("_lparts", "_rparts") if is_left else ("_rparts", "_lparts")
    one = F.lit(1).cast("long")
    part, meets = PARTS if is_left else PARTS[::-1]
    return df.join(F.broadcast(cells), list(same), "left").select(
        *columns,
        F.pmod(draw, F.coalesce(own, one)).alias(part),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1)).alias(meets),
    )


def least_rows(counts: DataFrame, min_rows: int | None = None) -> Column:
    """Rows (`_n` of `counts`, summed) from which a key is common: `min_rows`, and a fixed share of all rows."""
    limit = HOT_ROWS if min_rows is None else min_rows
    return F.greatest(F.lit(limit).cast("double"), counts.agg(F.sum("_n") / HOT_SHARE).scalar())


def part_count(rows: Column, least: Column) -> Column:
    """Number of parts for so many rows, each a quarter of what makes a key common."""
    return F.ceil(rows / F.greatest(least / 4, F.lit(1.0)))


def in_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of an inner equi-join on `keys` with `PARTS` as further keys.

    Rows of a common key are cut into numbered parts on both sides, and each part of the
    left meets each part of the right. One aggregation over both key columns counts them.
    """
    marks = [f"_cell_{i}" for i in range(len(keys))]

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(*[named(k).alias(m) for k, m in zip(keys, marks, strict=True)], F.lit(is_left).alias("_left"))

    both = side(left, True).unionByName(side(right, False))
    ours, theirs = (F.count_if(x) for x in (F.col("_left"), ~F.col("_left")))
    counts = both.groupBy(*marks).agg(F.count(F.lit(1)).alias("_n"), ours.alias("_ln"), theirs.alias("_rn"))
    least = least_rows(counts, min_rows)
    parts = {name: part_count(F.greatest(F.col(n), F.lit(1)), least) for n, name in (("_ln", "_lparts"), ("_rn", "_rparts"))}
    cells = counts.filter(F.col("_n") >= least).select(*marks, *[expr.alias(name) for name, expr in parts.items()])
    sides = []
    for df, is_left in ((left, True), (right, False)):
        same = [named(k) == F.col(m) for k, m in zip(keys, marks, strict=True)]
        drawn = df.withColumn("_draw", row_draw(df))
        sides.append(dealt(drawn, cells, same, [named(c) for c in df.columns], F.col("_draw"), is_left))
    return sides[0], sides[1]


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """Inner equi-join on `keys` of tables that may both have very many rows of one key.

    Every pair of parts of such a key is the work of another task. Columns other than
    the keys must have names of their own.
    """
    ours, theirs = in_blocks(left, right, keys, min_rows)
    return ours.join(theirs, [*keys, *PARTS], "inner").drop(*PARTS)


def left_lookup(
    df: DataFrame, table: DataFrame, key: str, table_key: str, hot: DataFrame | None = None, salts: int = SALTS
) -> DataFrame:
    """Left join of `df.key` to `table.table_key`; columns of `table` must have names of their own.

    Rows without a key match nothing and are spread over tasks. So are rows of the keys
    in `hot`, a result of `hot_keys` on `df`, for which `table` is repeated per salt.
    """
    draw = row_salt(df, salts)
    if hot is None:
        spread, repeated = df.withColumn(_SALT, F.lit(0)), table.withColumn("_with", F.lit(0))
    else:
        keyed = table.withColumnRenamed(table_key, key)
        spread, repeated, _ = salted(df, keyed, [key], hot, salts)
        repeated = repeated.withColumnRenamed(key, table_key).withColumnRenamed(_SALT, "_with")
    # A missing key draws a negative salt, which the table does not have; in one struct both are a key of the join.
    at = F.struct(named(key).alias("k"), F.when(named(key).isNull(), -1 - draw).otherwise(F.col(_SALT)).alias("s"))
    spread = spread.withColumn("_at", at).drop(_SALT)
    known = repeated.filter(named(table_key).isNotNull())
    known = known.withColumn("_to", F.struct(named(table_key).alias("k"), F.col("_with").alias("s"))).drop("_with")
    return spread.join(known, F.col("_at") == F.col("_to"), "left").drop("_at", "_to")


def attach_group_stats(
    df: DataFrame, keys: Sequence[str], stats: dict[str, Column], min_rows: int | None = None
) -> DataFrame:
    """Add per-key aggregates to every row, as a window over `keys` would.

    The aggregates are built with map-side combine and joined back; the row count
    that tells which keys are common comes out of the same aggregation.
    """
    summary = df.groupBy(*[named(k) for k in keys]).agg(
        *[expr.alias(name) for name, expr in stats.items()], F.count(F.lit(1)).alias("_n")
    )
    return attach_summary(df, keys, summary, summary, list(stats), min_rows)


def attach_summary(
    df: DataFrame, keys: Sequence[str], summary: DataFrame, counts: DataFrame, columns: Sequence[str], min_rows: int | None = None
) -> DataFrame:
    """Add `columns` of `summary`, which has one row per value of `keys`, to every row; missing keys are equal.

    `counts` tells the number of rows of each key as `_n`. Rows of common keys are
    spread over many tasks, and their row of `summary` is repeated for each.
    """
    hot = _hot_from_counts(counts, keys, min_rows)
    left, right, salt = salted(df, summary.select(*[named(k) for k in keys], *[named(c) for c in columns]), keys, hot)
    right = right.select(
        *[named(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[named(c) for c in columns],
        *[F.col(s).alias(f"_r{s}") for s in salt],
    )
    cond = [named(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    cond += [F.col(s) == F.col(f"_r{s}") for s in salt]
    joined = left.join(right, cond, "inner")
    return joined.select(*[named(c) for c in df.columns], *[named(c) for c in columns])

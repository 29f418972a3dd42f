"""Joins of dated tables: equal key and overlapping days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import as_list, named
from spanwise.operators.skew import PARTS, dealt, least_rows, part_count, row_draw

SPAN = ("start_date", "end_date")

# Tile widths as powers of two days; the last one spans all dates.
_WIDTHS = (5, 10, 15, 23)
_TILE_TYPE = "array<struct<level:int,tile:int,meets:int>>"
# Who is at home in a tile, on the level of its own length: the left row, or the right row alone.
_LEFT_HOME, _RIGHT_HOME = 0, 1
_TILE = ("_level", "_tile", "_meets")


@dataclass(frozen=True)
class TilePlan:
    """How rows of common keys are dealt: both tables are short enough to broadcast.

    `levels` has a row per common key with the levels on which either side has rows
    at home, `cells` a row per tile that holds many rows, with the number of parts
    that its rows of the left and of the right are cut into.
    """

    levels: DataFrame
    cells: DataFrame


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """True when two closed spells share a day."""
    return (a_start <= b_end) & (b_start <= a_end)


def _shifted(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def _at_home(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    """Add `_own`, the narrowest level whose tiles are longer than the spell, and its first and last tile there."""
    start, end = named(span[0]), named(span[1])
    length = F.abs(F.datediff(end, start))
    own = F.lit(len(_WIDTHS) - 1)
    for lv in reversed(range(len(_WIDTHS) - 1)):
        own = F.when(length < (1 << _WIDTHS[lv]), lv).otherwise(own)
    width = F.element_at(F.array(*map(F.lit, _WIDTHS)), own + 1)
    tiles = {name: _shifted(F.unix_date(day), width) for name, day in (("_first", start), ("_last", end))}
    return df.withColumns({"_own": own, **tiles})


def _touched_tiles(is_left: Column, others: Column) -> Column:
    """Tiles touched, at most two on a level, of a row that `_at_home` described.

    A row is at home on its own level, where it meets rows of the other side that are
    as long or shorter. On a wider one it can only meet rows that are at home there.
    It stays away from levels where there are none.
    """
    own, none = F.col("_own"), F.array().cast(_TILE_TYPE)
    width = F.element_at(F.array(*map(F.lit, _WIDTHS)), own + 1)
    levels = []
    for lv, wide in enumerate(_WIDTHS):
        tiles = F.sequence(*[_shifted(F.col(c), F.lit(wide) - width) for c in ("_first", "_last")])

        def put(meets: Column, tiles: Column = tiles, lv: int = lv) -> Column:
            return F.transform(tiles, lambda t: F.struct(F.lit(lv).alias("level"), t.alias("tile"), meets.alias("meets")))

        left, right = F.lit(_LEFT_HOME), F.lit(_RIGHT_HOME)
        same, shorter = F.array_contains(others, lv), F.array_min(others) < lv
        home = F.concat(
            F.when(same | (is_left & shorter), put(left)).otherwise(none), F.when(~is_left & shorter, put(right)).otherwise(none)
        )
        away = put(F.when(is_left, right).otherwise(left))
        levels.append(F.when(own == lv, home).when((own < lv) & F.array_contains(others, lv), away).otherwise(none))
    return F.concat(*levels)


def tile_counts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str] = SPAN,
    right_span: tuple[str, str] = SPAN,
) -> DataFrame:
    """Rows of either side by key, own level, and first and last tile there: one aggregation over both."""

    def of_side(df: DataFrame, span: tuple[str, str], is_left: bool) -> DataFrame:
        dated = _at_home(df.filter(named(span[0]).isNotNull() & named(span[1]).isNotNull()), span)
        return dated.select(
            *[named(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.lit(is_left).alias("_left"), "_own", "_first", "_last"
        )

    both = of_side(left, left_span, True).unionByName(of_side(right, right_span, False))
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("_n"))


def tile_plan(counts: DataFrame, min_rows: int | None = None, every_key: bool = False) -> TilePlan:
    """Plan from the result of `tile_counts`.

    Keys with at least `min_rows` rows are common, or all keys in `counts` if `every_key`,
    for counts that were taken of the rows of a short list of keys. A tile's rows of one
    side are cut into parts of a quarter of that. Common keys and parts also hold
    more than a fixed share of all rows, so both tables are short however many rows there are.
    """
    keys = [c for c in counts.columns if c.startswith("_key_")]
    least = least_rows(counts, min_rows)
    of_key = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"),
        F.collect_set(F.when(F.col("_left"), F.col("_own"))).alias("_of_left"),
        F.collect_set(F.when(~F.col("_left"), F.col("_own"))).alias("_of_right"),
    )
    # A common key that only one side has needs no tile at all, and is left out before the join.
    levels = (of_key if every_key else of_key.filter(F.col("_rows") >= least)).drop("_rows")
    others = F.when(F.col("_left"), F.col("_of_right")).otherwise(F.col("_of_left"))
    placed = counts.join(F.broadcast(levels), keys).select(*keys, "_left", "_n", F.explode(_touched_tiles(F.col("_left"), others)).alias("_t"))
    cells = placed.groupBy(*keys, *[F.col(f"_t.{c[1:]}").alias(c) for c in _TILE]).agg(
        *[part_count(F.sum(F.when(side, F.col("_n"))), least).alias(name) for name, side in (("_lparts", F.col("_left")), ("_rparts", ~F.col("_left")))]
    )
    # Tiles with rows of one side only are left out by the comparison with nothing.
    return TilePlan(levels, cells.filter(F.col("_lparts") + F.col("_rparts") > 2))


def _tiled(df: DataFrame, keys: Sequence[str], span: tuple[str, str], plan: TilePlan, is_left: bool) -> DataFrame:
    """Rows by the tiles they touch and the parts of the tile they meet.

    A row of a tile that is cut belongs to one part of its own side, by a repeatable
    draw, and comes to each part of the other side.
    """
    columns = [named(c) for c in df.columns]
    marks = [f"_key_{i}" for i in range(len(keys))]
    others = "_of_right" if is_left else "_of_left"
    dated = _at_home(df.filter(named(span[0]).isNotNull() & named(span[1]).isNotNull()), span).withColumn("_draw", row_draw(df))
    same = [named(k) == F.col(m) for k, m in zip(keys, marks, strict=True)]
    met = dated.join(F.broadcast(plan.levels.select(*marks, others)), same, "left")
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("tile"), F.lit(0).alias("meets")))
    tiles = F.when(F.col(others).isNotNull(), _touched_tiles(F.lit(is_left), F.col(others))).otherwise(whole)
    met = met.withColumn("_t", F.explode(tiles)).select(*columns, "_draw", *[F.col(f"_t.{c[1:]}").alias(c) for c in _TILE])
    cells = plan.cells.select(*[F.col(c).alias(f"_c{c}") for c in (*marks, *_TILE)], "_lparts", "_rparts")
    same = [named(k) == F.col(f"_c{m}") for k, m in zip(keys, marks, strict=True)] + [F.col(c) == F.col(f"_c{c}") for c in _TILE]
    return dealt(met, cells, same, [*columns, *map(F.col, _TILE)], F.col("_draw"), is_left)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    left_span: tuple[str, str] = SPAN,
    right_span: tuple[str, str] = SPAN,
    prefix: str = "right_",
    hot: DataFrame | None = None,
    min_rows: int | None = None,
    plan: TilePlan | None = None,
    spread: bool = True,
) -> DataFrame:
    """S19. Pairs of rows with equal key and overlapping days.

    Columns of `right` other than the key come back under `prefix`. Ordinary keys
    meet in one equi-join. A key with very many rows is cut into time tiles, so
    only rows near each other in time are compared: spells are matched on the
    wider of their two own levels, where one of them is at home, and in the tile
    where their overlap begins, which names each pair exactly once. Short spells
    never meet each other in a wide tile. Where a tile still holds many rows, because
    one long spell meets all the short ones or very many begin on the same days, the
    rows of either side are cut into parts, and each part of the left meets each of
    the right in a task of its own.

    What is common is counted over both sides in one aggregation (`min_rows` sets from
    how many rows). `hot`, a result of `hot_keys`, names the common keys instead;
    `plan` brings a plan made of other counts. `spread=False` leaves all that out, for
    tables stored in buckets by key with few rows for each, which then join where they are.
    """
    keys = as_list(on)
    ls, le = named(left_span[0]), named(left_span[1])
    rs, re = named(prefix + right_span[0]), named(prefix + right_span[1])
    if not spread:
        renamed = right.select(*[named(c).alias(prefix + c) for c in right.columns])
        same = [named(k) == named(prefix + k) for k in keys]
        return left.join(renamed, [*same, overlaps(ls, le, rs, re)], "inner").drop(*[prefix + k for k in keys])
    if plan is None:
        sides = left, right
        if hot is not None:
            named_hot = [F.col(f"_hot_{i}") for i in range(len(keys))]
            sides = tuple(
                df.join(F.broadcast(hot), [named(k) == h for k, h in zip(keys, named_hot, strict=True)], "left_semi") for df in sides
            )
        plan = tile_plan(tile_counts(*sides, keys, left_span, right_span), min_rows, every_key=hot is not None)
    left, right = _tiled(left, keys, left_span, plan, True), _tiled(right, keys, right_span, plan, False)
    renamed = right.select(*[named(c).alias(prefix + c) for c in right.columns])

    cond = [named(k) == named(prefix + k) for k in keys]
    level, tile = F.col("_level"), F.col("_tile")
    begins = F.unix_date(F.greatest(ls, rs))
    home = F.lit(None).cast("int")
    for lv, width in enumerate(_WIDTHS):
        home = F.when(level == lv, F.shiftright(begins, width)).otherwise(home)
    helpers = (*_TILE, *PARTS)
    cond += [F.col(c) == named(prefix + c) for c in helpers]
    cond += [(level == -1) | (tile == home), overlaps(ls, le, rs, re)]
    drop = [prefix + k for k in keys] + [*helpers, *[prefix + c for c in helpers]]
    return left.join(renamed, cond, "inner").drop(*drop)


def intersect_spells(
    a: DataFrame,
    b: DataFrame,
    key: str | Sequence[str],
    start: str = "start_date",
    end: str = "end_date",
    hot: DataFrame | None = None,
    plan: TilePlan | None = None,
    spread: bool = True,
) -> DataFrame:
    """S5. Days common to a spell of `a` and a spell of `b` of the same key.

    Non-key columns of `b` other than the dates are kept; they must not clash with `a`.
    """
    joined = overlap_join(a, b, key, (start, end), (start, end), "_b_", hot, plan=plan, spread=spread)
    keys = as_list(key)
    extra = [c for c in b.columns if c not in (*keys, start, end)]
    columns = []
    for c in a.columns:
        if c == start:
            columns.append(F.greatest(named(start), named("_b_" + start)).alias(start))
        elif c == end:
            columns.append(F.least(named(end), named("_b_" + end)).alias(end))
        else:
            columns.append(named(c))
    return joined.select(*columns, *[named("_b_" + c).alias(c) for c in extra])

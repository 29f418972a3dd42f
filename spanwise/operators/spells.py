"""Spell algebra on closed day spells (both ends belong to the spell)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwise.functions.columns import as_list, named
from spanwise.functions.dates import (
    FIRST_DAY,
    LAST_DAY,
    OPEN_END,
    OPEN_YEAR,
    ORIGIN,
    add_years_unless_open,
    as_date,
    month_index,
    reporting_period_end,
    reporting_period_start,
)
from spanwise.operators.overlap import intersect_spells, tile_counts, tile_plan
from spanwise.operators.skew import SALTS, attach_group_stats, block_join, hot_keys, row_salt, salted


def condense_spells(
    df: DataFrame,
    keys: str | Sequence[str],
    start: str = "start_date",
    end: str = "end_date",
    gap_days: int = 1,
    open_ended: str = "keep",
) -> DataFrame:
    """S1/S2. Merge the overlapping spells of each key; other columns are left behind.

    `gap_days=1` also merges a spell that begins the day after another ends,
    `gap_days=0` only spells that share a day. Spells that end before they start
    are ignored. `open_ended='drop'` leaves out merged spells that end in the
    open-ended year, which some published tables did.

    Spells are first reduced to the longest one per key and start day, with
    map-side combine. The ordering window therefore holds one row per key and
    day, so its size is limited by the calendar and not by the data.
    """
    if open_ended not in ("keep", "drop"):
        raise ValueError("open_ended must be 'keep' or 'drop'")
    names = as_list(keys)
    key_cols = [named(k) for k in names]
    valid = df.filter(named(start) <= named(end))
    per_day = valid.groupBy(*key_cols, named(start).alias("_s")).agg(F.max(named(end)).alias("_e"))
    by_start = W.partitionBy(*key_cols).orderBy("_s")
    reached = F.max("_e").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    # The new-island test is in day differences so that an end on the last
    # representable day needs no date beyond it.
    fresh = F.when(F.datediff("_s", reached) <= gap_days, 0).otherwise(1)
    so_far = by_start.rowsBetween(W.unboundedPreceding, W.currentRow)
    islands = per_day.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(so_far))
    merged = (
        islands.groupBy(*key_cols, "_island")
        .agg(F.min("_s").alias(start), F.max("_e").alias(end))
        .drop("_island")
    )
    if open_ended == "drop":
        merged = merged.filter(F.year(named(end)) != OPEN_YEAR)
    return merged


def _gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, floor: Column, ceiling: Column) -> DataFrame:
    """Gaps before, between and after disjoint spells, cut to [floor, ceiling].

    A row whose `start` is NULL stands for a key without spells: all of its
    window is a gap. Every gap comes from the row before or after it, so the
    spells are read once and no union is needed.
    """
    by_start = W.partitionBy(*[named(k) for k in keys]).orderBy(named(start))
    marked = df.withColumns(
        {
            "_floor": floor,
            "_ceil": ceiling,
            "_prev": F.lag(named(end)).over(by_start),
            "_next": F.lead(named(start)).over(by_start),
        }
    )
    before = F.struct(F.col("_floor").alias("s"), F.date_sub(named(start), 1).alias("e"))
    after = F.struct(
        F.date_add(named(end), 1).alias("s"),
        F.coalesce(F.date_sub("_next", 1), F.col("_ceil")).alias("e"),
    )
    whole = F.struct(F.col("_floor").alias("s"), F.col("_ceil").alias("e"))
    pieces = (
        F.when(named(start).isNull(), F.array(whole))
        .when(F.col("_prev").isNull(), F.array(before, after))
        .otherwise(F.array(after))
    )
    exploded = marked.select(*[named(k) for k in keys], "_floor", "_ceil", F.explode(pieces).alias("_g"))
    return exploded.select(
        *[named(k) for k in keys],
        F.greatest(F.col("_g.s"), F.col("_floor")).alias(start),
        F.least(F.col("_g.e"), F.col("_ceil")).alias(end),
    ).filter(named(start) <= named(end))


def invert_spells(
    df: DataFrame,
    keys: str | Sequence[str],
    start: str = "start_date",
    end: str = "end_date",
    origin: str = ORIGIN,
    horizon: str = OPEN_END,
    condensed: bool = False,
) -> DataFrame:
    """S3. Days of [origin, horizon] outside every spell of the key.

    Input is condensed on the same key first unless `condensed` says it already is.
    Keys without any spell do not appear; see `gaps_within_bounds` for those.
    """
    names = as_list(keys)
    busy = df if condensed else condense_spells(df, names, start, end)
    return _gaps(busy, names, start, end, as_date(origin), as_date(horizon))


def restrict_spells(
    df: DataFrame, window_start: str, window_end: str, start: str = "start_date", end: str = "end_date"
) -> DataFrame:
    """S6. Spells that touch the study window; both comparisons reach the scan."""
    return df.filter((named(end) >= as_date(window_start)) & (named(start) <= as_date(window_end)))


def gaps_within_bounds(
    busy: DataFrame,
    bounds: DataFrame,
    key: str,
    start: str = "start_date",
    end: str = "end_date",
    earliest: str = "earliest_date",
    latest: str = "latest_date",
) -> DataFrame:
    """S4. Each key's own window minus the union of its busy spells.

    `bounds` has one row per key. Keys with no busy spell keep their whole window.
    """
    merged = condense_spells(busy, key, start, end).select(
        named(key).alias("_key"), named(start).alias("_s"), named(end).alias("_e")
    )
    # Windows that end before they start are told apart, not filtered: Spark would repeat a filter on what comes
    # from the key for every busy spell. They have no days, so nothing of them is left.
    windows = bounds.select(
        named(key), named(earliest).alias("_lo"), named(latest).alias("_hi"), (named(earliest) <= named(latest)).alias("_open")
    )
    meets = (
        (named(key) == F.col("_key")) & (F.col("_s") <= F.col("_hi")) & (F.col("_e") >= F.col("_lo"))
    )
    inside = windows.join(merged, meets, "left").select(
        named(key), "_open", "_lo", "_hi", F.col("_s").alias(start), F.col("_e").alias(end)
    )
    return _gaps(inside, [key, "_open"], start, end, F.col("_lo"), F.col("_hi")).drop("_open")


def snapshots_to_spells(
    df: DataFrame,
    id_col: str,
    date: str,
    household_keys: Sequence[str],
    min_days: int = 20,
    max_days: int = 40,
) -> DataFrame:
    """S7. Two snapshots of a person in one household, 20 to 40 days apart, make a spell.

    The household may match on any of `household_keys`; each (person, start, end) is
    returned once. Copies of a snapshot are reduced to one first, so the window
    holds at most one row per day and looks `max_days` ahead: the table is not
    joined with itself.
    """
    households = F.array(*[named(h) for h in household_keys])
    seen = (
        df.select(
            named(id_col),
            F.unix_date(named(date).cast("date")).alias("_d"),
            F.posexplode(households).alias("_kind", "_hh"),
        )
        .filter(F.col("_hh").isNotNull() & F.col("_d").isNotNull())
        .distinct()
    )
    ahead = W.partitionBy(named(id_col), "_kind", "_hh").orderBy("_d").rangeBetween(min_days, max_days)
    followed = seen.withColumn("_ends", F.collect_list("_d").over(ahead))
    pairs = followed.select(named(id_col), "_d", F.explode("_ends").alias("_e"))
    return pairs.distinct().select(
        named(id_col), F.date_from_unix_date("_d").alias("start_date"), F.date_from_unix_date("_e").alias("end_date")
    )


def reporting_period_spells(
    df: DataFrame,
    returned: str,
    given_start: str,
    given_end: str,
    start_tol: int = 60,
    end_tol: int = 27,
) -> DataFrame:
    """S8. Monthly return -> spell, using reported dates only when close to the return."""
    r, s, e = (named(c).cast("date") for c in (returned, given_start, given_end))
    return df.withColumns(
        {
            "start_date": reporting_period_start(r, s, start_tol),
            "end_date": reporting_period_end(r, s, e, end_tol),
        }
    )


def event_to_window(df: DataFrame, date: str, years: int) -> DataFrame:
    """S9. Event -> spell of `years` years from the event; open dates stay as they are."""
    day = named(date).cast("date")
    return df.withColumns({"start_date": day, "end_date": add_years_unless_open(day, years)})


def stack_roles(df: DataFrame, role_cols: Sequence[str], into: str) -> DataFrame:
    """S10. One row per record and distinct person named in `role_cols`, in one scan."""
    people = F.array_distinct(F.array_compact(F.array(*[named(c) for c in role_cols])))
    kept = [named(c) for c in df.columns if c != into]
    return df.select(*kept, F.explode(people).alias(into))


def keep_longest_sequence(df: DataFrame, id_col: str, seq: str, min_rows: int | None = None) -> DataFrame:
    """S12. Rows whose sequence number is the person's largest; ties are all kept."""
    known = df.filter(named(id_col).isNotNull())
    stats = attach_group_stats(known, [id_col], {"_longest": F.max(named(seq))}, min_rows)
    return stats.filter(named(seq) == F.col("_longest")).drop("_longest")


def terminal_events(df: DataFrame, person: str, group: str, date: str, event: str = "event_date") -> DataFrame:
    """S13. Last record with each group (employer), unless it is the person's very last
    record or the person has any record in the next calendar month.
    """
    day = named(date).cast("date")
    last = df.groupBy(named(person), named(group)).agg(F.max(day).alias(event))
    final = last.groupBy(named(person).alias("_p")).agg(F.max(event).alias("_final"))
    months = (
        df.select(named(person).alias("_q"), month_index(day).alias("_m")).filter(F.col("_m").isNotNull()).distinct()
    )
    return (
        last.join(final, (named(person) == F.col("_p")) & (F.col(event) != F.col("_final")), "inner")
        .drop("_p", "_final")
        .join(months, (named(person) == F.col("_q")) & (month_index(F.col(event)) + 1 == F.col("_m")), "left_anti")
    )


def combine_sources(sources: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "source") -> DataFrame:
    """S14. Tagged UNION ALL of several tables on common columns."""
    parts = [df.select(*[named(c) for c in columns], F.lit(name).alias(tag)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def classify_roles(
    spells: DataFrame,
    partners: DataFrame,
    id_col: str,
    partner_col: str,
    start: str = "start_date",
    end: str = "end_date",
    role: str = "role",
    gap_days: int = 0,
    min_rows: int | None = None,
) -> DataFrame:
    """S15. Split each person's spells by whether a partnership ran at the time.

    `single`: days of a spell outside all partnerships; `primary`: days inside a
    partnership; `partner`: the same days of the recipient's spell, credited to the
    partner named in the partnership record.
    """
    hot = hot_keys(spells.select(named(id_col)).unionByName(partners.select(named(id_col))), [id_col], min_rows)

    def of_hot(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), named(id_col) == F.col("_hot_0"), "left_semi")

    def times_of(spells: DataFrame, partners: DataFrame) -> DataFrame:
        """When a spell of the person counts for someone in some role: one table, so that spells are joined once."""
        valid = partners.filter(named(start) <= named(end)).select(
            named(id_col), named(partner_col), named(start), named(end)
        )
        paired = condense_spells(valid, [id_col, partner_col], start, end, gap_days)
        # Partnerships with different people may overlap, so the free days need the
        # union over all partners of the person.
        free = invert_spells(paired, id_col, start, end)
        always = (
            spells.select(named(id_col))
            .distinct()
            .join(valid.select(named(id_col)).distinct(), id_col, "left_anti")
            .withColumns({start: as_date(FIRST_DAY), end: as_date(LAST_DAY)})
        )

        def credited(df: DataFrame, name: str, person: str) -> DataFrame:
            return df.select(
                named(id_col), F.lit(name).alias(role), named(person).alias("_credited"), named(start), named(end)
            )

        parts = [
            credited(free, "single", id_col),
            credited(always, "single", id_col),
            credited(paired, "primary", id_col),
            credited(valid, "partner", partner_col),
        ]
        return reduce(lambda a, b: a.unionByName(b), parts)

    # Tiles are counted for common persons alone; where there are none, these steps fall away.
    counts = tile_counts(of_hot(spells), times_of(of_hot(spells), of_hot(partners)), [id_col], (start, end), (start, end))
    plan = tile_plan(counts, min_rows, every_key=True)
    met = intersect_spells(spells, times_of(spells, partners), id_col, start, end, plan=plan)
    detail = [named(c) for c in spells.columns if c not in (id_col, start, end)]
    return met.select(named("_credited").alias(id_col), named(role), named(start), named(end), *detail)


def lookup_valid_at(
    df: DataFrame,
    codes: DataFrame,
    code: tuple[str, str],
    second: tuple[str, str],
    at: str,
    valid_from: str,
    valid_to: str,
    null_text: str = "null",
    hot: DataFrame | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """S16. Left join to a code table whose rows are valid for a range of dates.

    `code` and `second` pair a column of `df` with one of `codes`. A missing second
    code in the table matches a missing or `null_text` second code in the data. No join
    hint: Spark broadcasts the code table when its size allows. Where it does not, rows
    of common pairs of codes are spread over many tasks, for which their rows of the
    table are repeated, and rows without a code are spread too. `hot` names the common
    pairs, as the result of `hot_pairs`; without it they are counted in `df`.
    """
    if hot is None:
        hot = hot_pairs(df, code[0], second[0], null_text, min_rows)
    c_cols = {c: f"_code_{c}" for c in codes.columns}
    table = codes.select(*[named(c).alias(n) for c, n in c_cols.items()])
    table = table.withColumns({"_first": named(c_cols[code[1]]), "_second": F.coalesce(named(c_cols[second[1]]), F.lit(null_text))})
    pair = {"_first": named(code[0]), "_second": F.coalesce(named(second[0]), F.lit(null_text))}
    spread, repeated, salt = salted(df.withColumns(pair), table, list(pair), hot)
    # A missing code draws a negative salt, which the table does not have; in one struct all are a key of the join.
    drawn = F.when(F.col("_first").isNull(), -1 - row_salt(df, SALTS)).otherwise(F.col(salt[0]))
    spread = spread.withColumn("_at", F.struct("_first", "_second", drawn.alias("s")))
    known = repeated.filter(F.col("_first").isNotNull()).withColumn("_to", F.struct("_first", "_second", F.col(salt[0]).alias("s")))
    valid = (named(c_cols[valid_from]) <= named(at)) & (named(at) <= named(c_cols[valid_to]))
    joined = spread.join(known.drop(*pair, *salt), (F.col("_at") == F.col("_to")) & valid, "left")
    used = (code[1], second[1], valid_from, valid_to)
    extra = [named(n).alias(c) for c, n in c_cols.items() if c not in used]
    return joined.select(*[named(c) for c in df.columns], *extra)


def hot_pairs(df: DataFrame, code: str, second: str, null_text: str = "null", min_rows: int | None = None) -> DataFrame:
    """Common pairs of codes of a table, for `lookup_valid_at`."""
    pairs = df.select(named(code).alias("_first"), F.coalesce(named(second), F.lit(null_text)).alias("_second"))
    return hot_keys(pairs.filter("_first IS NOT NULL"), ["_first", "_second"], min_rows)


def relative_events(
    persons: DataFrame,
    unions: DataFrame,
    id_col: str,
    parent1: str,
    parent2: str,
    died: str,
    partner1: str,
    partner2: str,
    distinct: bool = False,
    placeholders: Sequence[int] = (),
    min_rows: int | None = None,
) -> DataFrame:
    """S17. One row per person and deceased close relative.

    `persons` carries the date of death (NULL while alive), `unions` the marriages
    and civil unions. Two people with both parents in common count as siblings
    through each shared parent unless `distinct` is set.

    `placeholders` are numbers that stand for an unknown person: nobody is their child,
    partner or co-parent. A parent of very many children (`min_rows` sets from how many
    rows) is never in one task as a whole: children and lost children are cut into
    parts, and siblings are formed for each pair of parts. So is a deceased person
    whom very many are tied to.
    """
    def someone(col: str) -> Column:
        return F.when(~named(col).isin(*placeholders), named(col)) if placeholders else named(col)

    persons = persons.withColumns({c: someone(c) for c in (parent1, parent2)})
    unions = unions.withColumns({c: someone(c) for c in (partner1, partner2)})
    dead = persons.filter(named(died).isNotNull()).select(
        named(id_col).alias("deceased_id"), named(died).alias("event_date")
    )
    kin = stack_roles(persons.select(named(id_col).alias("child"), named(parent1), named(parent2), named(died)),
                      [parent1, parent2], "parent")
    links = kin.select("child", "parent")

    def rows(df: DataFrame, person: str, label: str) -> DataFrame:
        return df.select(
            F.col(person).alias(id_col), "event_date", F.lit(label).alias("relationship"), "deceased_id"
        )

    lost_children = kin.filter(named(died).isNotNull()).select(
        "parent", named(died).alias("event_date"), F.col("child").alias("deceased_id")
    )
    child = rows(lost_children, "parent", "child")
    siblings = block_join(lost_children, links, ["parent"], min_rows).filter(F.col("child") != F.col("deceased_id"))
    sibling = rows(siblings, "child", "sibling")
    if distinct:
        sibling = sibling.distinct()

    # Everyone tied to someone by descent, union or shared child; the deceased are
    # then looked up once for all kinds of tie.
    by_descent = links.select(F.lit("parent").alias("relationship"), F.col("child").alias("a"), F.col("parent").alias("b"))
    couples = unions.filter(named(partner1) != named(partner2))
    both_ways = F.array(
        F.struct(named(partner1).alias("a"), named(partner2).alias("b")),
        F.struct(named(partner2).alias("a"), named(partner1).alias("b")),
    )
    by_union = couples.select(F.lit("spouse").alias("relationship"), F.explode(both_ways).alias("p"))
    # Pairs are made unique in each direction, so a couple recorded in both orders
    # counts twice; `way` keeps the two directions apart.
    both_parents = F.array(
        F.struct(F.lit(1).alias("way"), named(parent2).alias("a"), named(parent1).alias("b")),
        F.struct(F.lit(2).alias("way"), named(parent1).alias("a"), named(parent2).alias("b")),
    )
    by_child = persons.filter(named(parent1) != named(parent2)).select(F.explode(both_parents).alias("p"))
    ties = (
        by_descent.unionByName(by_union.select("relationship", "p.a", "p.b"))
        .unionByName(by_child.distinct().select(F.lit("coparent").alias("relationship"), "p.a", "p.b"))
        .withColumnRenamed("b", "deceased_id")
    )
    ties = block_join(ties, dead, ["deceased_id"], min_rows)
    tied = ties.select(F.col("a").alias(id_col), "event_date", "relationship", "deceased_id")
    return reduce(lambda x, y: x.unionByName(y), [child, sibling, tied])


def as_at(df: DataFrame, date: str, valid_from: str, valid_to: str) -> DataFrame:
    """S18. Rows valid on a given date."""
    return df.filter((named(valid_from) <= as_date(date)) & (named(valid_to) >= as_date(date)))

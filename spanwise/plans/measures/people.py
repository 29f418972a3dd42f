"""Populations, life events and family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.functions.dates import OPEN_END_LATE, as_date, month_index, partial_date
from spanwise.operators.skew import hot_keys, left_lookup
from spanwise.operators.spells import as_at, event_to_window, relative_events, stack_roles

ID = "snz_uid"
# Day given to births and deaths, of which only the month is known.
BIRTH_DAY = 15
DEATH_DAY = 28


def birth_date(extra_years: int = 0, day: int = BIRTH_DAY) -> Column:
    return partial_date(named("snz_birth_year_nbr") + extra_years, named("snz_birth_month_nbr"), F.lit(day))


def death_date(prefix: str = "") -> Column:
    return partial_date(
        named(prefix + "snz_deceased_year_nbr"), named(prefix + "snz_deceased_month_nbr"), F.lit(DEATH_DAY)
    )


def residents(population: DataFrame, year: int) -> DataFrame:
    """M1. Persons with a reference date in the year; a range filter, so it reaches the scan."""
    day = named("srp_ref_date")
    in_year = (day >= as_date(f"{year}-01-01")) & (day < as_date(f"{year + 1}-01-01"))
    return population.filter(in_year).select(named(ID), day)


def alive(persons: DataFrame, limit_year: int = 2021, longest_life: int = 130) -> DataFrame:
    """M2. Birth to death, or to birth plus 130 years; births and deaths in the future left out."""
    known = persons.filter(
        (named("snz_person_ind") == 1)
        & named("snz_birth_year_nbr").isNotNull()
        & named("snz_birth_month_nbr").isNotNull()
        & (named("snz_birth_year_nbr") <= limit_year)
        & (named("snz_deceased_year_nbr").isNull() | (named("snz_deceased_year_nbr") < limit_year))
    )
    return known.select(
        named(ID),
        birth_date().alias("start_date"),
        F.coalesce(death_date(), birth_date(longest_life, DEATH_DAY)).alias("end_date"),
    ).filter("start_date <= end_date")


def deaths(persons: DataFrame) -> DataFrame:
    """M3. Death events."""
    columns = ["snz_deceased_year_nbr", "snz_deceased_month_nbr", "snz_deceased_date_source_code"]
    known = persons.filter(named(columns[0]).isNotNull() & named(columns[1]).isNotNull())
    return known.select(named(ID), *[named(c) for c in columns], death_date().alias("event_date"))


def relationship_spells(marriages: DataFrame, civil_unions: DataFrame, persons: DataFrame) -> DataFrame:
    """M15. Start to dissolution, else to the earlier death, else open; one row per partner."""
    died = persons.select(named(ID).alias("_person"), death_date().alias("_died"))

    def unions(df: DataFrame, start: str, dissolved: str) -> DataFrame:
        return df.select(
            named("partnr1_snz_uid"),
            named("partnr2_snz_uid"),
            named(start).cast("date").alias("start_date"),
            named(dissolved).cast("date").alias("_dissolved"),
        )

    couples = (
        unions(marriages, "dia_mar_marriage_date", "dia_mar_disolv_order_date")
        .unionByName(unions(civil_unions, "dia_civ_civil_union_date", "dia_civ_disolv_order_date"))
        .filter(F.col("start_date").isNotNull() & (F.col("partnr1_snz_uid") != F.col("partnr2_snz_uid")))
    )
    first = died.select(F.col("_person").alias("_p1"), F.col("_died").alias("_d1"))
    second = died.select(F.col("_person").alias("_p2"), F.col("_died").alias("_d2"))
    dated = couples.join(first, F.col("partnr1_snz_uid") == F.col("_p1")).join(
        second, F.col("partnr2_snz_uid") == F.col("_p2")
    )
    # `least` passes over a missing death.
    ends = dated.withColumn(
        "end_date", F.coalesce("_dissolved", F.least("_d1", "_d2"), as_date(OPEN_END_LATE))
    )
    return stack_roles(ends, ["partnr1_snz_uid", "partnr2_snz_uid"], ID).select(named(ID), "start_date", "end_date")


def family_deaths(
    persons: DataFrame,
    marriages: DataFrame,
    civil_unions: DataFrame,
    distinct: bool = False,
    placeholders: Sequence[int] = (),
    min_rows: int | None = None,
) -> DataFrame:
    """M16. Deaths of children, parents, siblings, spouses and co-parents; `placeholders` stand for unknown persons."""
    died = F.when(named("snz_person_ind") == 1, death_date())
    people = persons.select(
        named(ID), named("snz_parent1_uid"), named("snz_parent2_uid"), died.alias("event_day")
    )
    both = ["partnr1_snz_uid", "partnr2_snz_uid"]
    unions = (
        marriages.filter(named("dia_mar_marriage_date").isNotNull())
        .select(*both)
        .unionByName(civil_unions.filter(named("dia_civ_civil_union_date").isNotNull()).select(*both))
    )
    events = relative_events(
        people, unions, ID, "snz_parent1_uid", "snz_parent2_uid", "event_day", *both, distinct, placeholders, min_rows
    )
    return events.withColumnRenamed("deceased_id", "deceased_snz_uid")


def dependent_children(persons: DataFrame, until_age: int = 16) -> DataFrame:
    """M17. For each parent, the time from a child's birth to its 16th birthday or death."""
    known = persons.filter(
        named(ID).isNotNull() & named("snz_birth_year_nbr").isNotNull() & named("snz_birth_month_nbr").isNotNull()
    ).select(
        named("snz_parent1_uid"),
        named("snz_parent2_uid"),
        named("snz_birth_date_proxy").cast("date").alias("start_date"),
        F.least(birth_date(until_age), death_date()).alias("end_date"),
    )
    return (
        stack_roles(known, ["snz_parent1_uid", "snz_parent2_uid"], ID)
        .filter("start_date <= end_date")
        .select(named(ID), "start_date", "end_date")
    )


def recent_parents(births: DataFrame, years: int = 2) -> DataFrame:
    """M18. For each parent, the two years from a live birth."""
    live = births.filter(named("dia_bir_still_birth_code").isNull()).select(
        named(ID).alias("child_snz_uid"),
        named("parent1_snz_uid"),
        named("parent2_snz_uid"),
        partial_date(named("dia_bir_birth_year_nbr"), named("dia_bir_birth_month_nbr"), F.lit(BIRTH_DAY)).alias("dob"),
    )
    parents = stack_roles(live, ["parent1_snz_uid", "parent2_snz_uid"], ID)
    return event_to_window(parents, "dob", years).select(named(ID), "start_date", "end_date", "child_snz_uid")


def recent_migrants(overseas: DataFrame, years: int = 2) -> DataFrame:
    """M19. The two years from first arrival."""
    arrivals = overseas.filter(named("pos_first_arrival_ind") == "y")
    kept = ["pos_first_arrival_ind", "pos_last_departure_ind", "pos_source_code"]
    return event_to_window(arrivals, "pos_ceased_date", years).select(
        named(ID), "start_date", "end_date", *[named(c) for c in kept]
    )


def address_descriptors(
    addresses: DataFrame,
    concordance: DataFrame,
    geography: DataFrame,
    deprivation: DataFrame,
    persons: DataFrame,
    population: DataFrame,
    on: str = "2018-12-31",
    child_months: int = 180,
    min_rows: int | None = None,
) -> DataFrame:
    """M24. Address on a date with its area, deprivation and whether a child lives there.

    The classification tables carry no join hint: Spark broadcasts them when their
    size allows. Children are counted per address before they meet the addresses, where
    common addresses (from `min_rows` rows) and missing ones are spread.
    """
    current = as_at(addresses, on, "ant_notification_date", "ant_replacement_date")
    year, address = int(on[:4]), "snz_idi_address_register_uid"
    of_age = persons.filter(
        (named("snz_deceased_year_nbr").isNull() | (named("snz_deceased_year_nbr") > year))
        & (month_index(as_date(on)) - month_index(named("snz_birth_date_proxy")) <= child_months)
    ).select(named(ID))
    in_population = population.select(named(ID)).distinct()
    children = (
        current.filter(named(address).isNotNull())
        .select(named(ID), named(address))
        .join(of_age, ID)
        .join(in_population, ID, "left_semi")
        .select(named(address).alias("_address"))
        .distinct()
        .withColumn("_child", F.lit(1))
    )
    mb = concordance.select(
        named("MB2019_code").alias("_mb19"), named("MB2018_code").alias("_mb18"), named("MB2013_code").alias("_mb13")
    )
    area = ["IUR2018_V1_00", "IUR2018_V1_00_NAME", "SA22018_V1_00", "SA22018_V1_00_NAME"]
    index = ["DepIndex2013", "DepScore2013"]
    geo = geography.select(named("MB2018_V1_00").alias("_geo"), *[named(c) for c in area])
    dep = deprivation.select(named("Meshblock2013").alias("_dep"), *[named(c) for c in index])
    placed = (
        current.filter(named("ant_meshblock_code").isNotNull())
        .join(mb, named("ant_meshblock_code") == F.col("_mb19"))
        .join(geo, F.col("_mb18") == F.col("_geo"), "left")
        .join(dep, F.col("_mb13") == F.col("_dep"), "left")
    )
    joined = left_lookup(placed, children, address, "_address", hot_keys(current, [address], min_rows))
    kept = [ID, "ant_notification_date", "ant_replacement_date", address, "ant_region_code"]
    return joined.select(
        *[named(c) for c in kept],
        *[named(c).cast("int").alias(c) if c == "SA22018_V1_00" else named(c) for c in area],
        *[named(c) for c in index],
        F.coalesce("_child", F.lit(0)).alias("child_indicator"),
    )

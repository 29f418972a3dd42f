"""Tabulation: groups, distributions, totals, adjusted means and pairwise counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.functions.recode import cap
from spanwise.operators.reshape import pivot_long
from spanwise.operators.skew import attach_group_stats

NO_GROUP = "<NA>"


def _flagged_groups(flags: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(named(f) == 1, F.lit(f)) for f in flags]))


def group_members(df: DataFrame, id_col: str, flags: Sequence[str]) -> DataFrame:
    """G1. (group_name, id) for every flag equal to 1, in one pass over the table."""
    return df.select(F.explode(_flagged_groups(flags)).alias("group_name"), named(id_col))


# Flags held as the bits of one number; more flags take more numbers.
_MAX_FLAGS = 62


def _membership(df: DataFrame, groups: DataFrame | Sequence[str], id_col: str, cols: Sequence[str]) -> DataFrame:
    """`cols` with columns `_in0`, `_in1`, ... telling the groups a row counts for.

    Given flag columns of the same table, membership is read off the row, without a
    join: the flags are packed as bits into as many numbers as they need. A separate
    membership table is joined on the identity and `_in0` is the group's name, one row
    per membership.
    """
    picked = [named(c) for c in cols]
    if isinstance(groups, DataFrame):
        members = groups.select(named(id_col), F.col("group_name").alias("_in0"))
        return df.select(named(id_col), *picked).join(members, id_col, "left").drop(id_col)
    words = []
    for first in range(0, max(len(groups), 1), _MAX_FLAGS):
        bits = [F.when(named(g) == 1, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(groups[first : first + _MAX_FLAGS])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")).alias(f"_in{len(words)}"))
    return df.select(*words, *picked)


def _words(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.fullmatch(r"_in\d+", c)]


def _by_group(cells: DataFrame, groups: DataFrame | Sequence[str]) -> DataFrame:
    """Replace membership by `group_name`, repeating a reduced row for each of its groups."""
    words = _words(cells)
    rest = [named(c) for c in cells.columns if c not in words]
    if isinstance(groups, DataFrame):
        return cells.select(F.col(words[0]).alias("group_name"), *rest)
    held = F.array_compact(
        F.array(
            *[F.when(F.col(words[i // _MAX_FLAGS]).bitwiseAND(F.lit(1 << i % _MAX_FLAGS)) != 0, F.lit(g)) for i, g in enumerate(groups)]
        )
    )
    return cells.select(F.explode_outer(held).alias("group_name"), *rest)


def distribution_by_group(
    df: DataFrame, groups: DataFrame | Sequence[str], id_col: str, cols: Sequence[str]
) -> DataFrame:
    """G2. Rows per group and value of each column: one aggregation for all columns.

    Persons in no group count under a NULL group. With flag columns as `groups`, rows
    are reduced per combination of flags first and only then counted for each group.
    """
    tall = F.array(*[F.struct(F.lit(c).alias("measure"), named(c).cast("string").alias("value")) for c in cols])
    members = _membership(df, groups, id_col, cols)
    cells = (
        members.select(*_words(members), F.explode(tall).alias("_m"))
        .groupBy(*_words(members), F.col("_m.measure").alias("measure"), F.col("_m.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return _by_group(cells, groups).groupBy("group_name", "measure", "value").agg(F.sum("_n").alias("count"))


def totals_by_group(
    df: DataFrame, groups: DataFrame | Sequence[str], id_col: str, cols: Sequence[str]
) -> DataFrame:
    """G3. Sum and number of values per group for each column, as in `distribution_by_group`."""
    reductions, sums = [], []
    for i, c in enumerate(cols):
        reductions += [F.sum(named(c)).cast("double").alias(f"_s{i}"), F.count(named(c)).alias(f"_n{i}")]
        sums += [F.sum(f"_s{i}").alias(f"_s{i}"), F.sum(f"_n{i}").alias(f"_n{i}")]
    members = _membership(df, groups, id_col, cols)
    cells = members.groupBy(*_words(members)).agg(*reductions)
    wide = _by_group(cells, groups).groupBy("group_name").agg(*sums)
    tall = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), F.col(f"_s{i}").alias("total"), F.col(f"_n{i}").alias("count"))
            for i, c in enumerate(cols)
        ]
    )
    return wide.select("group_name", F.explode(tall).alias("_m")).select("group_name", "_m.*")


def spread_groups(
    df: DataFrame, value: str = "count", group: str = "group_name", groups: Sequence[str] | None = None
) -> DataFrame:
    """G4. One column per group; a missing cell is NULL, the NULL group is `<NA>`."""
    filled = df.withColumn(group, F.coalesce(named(group), F.lit(NO_GROUP)))
    return pivot_long(filled, group, value, "first", groups)


def prepare_crosstab(df: DataFrame, year: int = 2018, first: str = "msd", second: str = "ird", quarter: str = "2018Q4") -> DataFrame:
    """G5. Adults, with missing indicators as zero, bands and class columns.

    `first` and `second` are the prefixes of the two agencies' balance columns.
    """
    # The indicator and money columns read, and the income bands.
    zero_filled = ["eth_asian", "eth_european", "eth_maori", "eth_other", "eth_pacific",
                   "sex_code=1", "sex_code=2", "total_income", "BEN_income", "WAS_income"]
    bands = [(5_000, "0_5k"), (20_000, "5k_20k"), (50_000, "20k_50k"), (100_000, "50k_100k")]
    classes = [((1, 2, 3, 4), "cert"), ((5, 6, 7), "grad"), ((8, 9, 10), "post")]
    balances = {first: f"{first}_{quarter}", second: f"{second}_{quarter}"}
    kept = ["birth_year", "deprivation", "highest_qualification", "life_satisfaction", *balances.values()]

    adults = df.filter(F.lit(year) - named("birth_year") >= 16).select(
        *[named(c) for c in kept], *[F.coalesce(named(c), F.lit(0)).alias(c) for c in zero_filled]
    )
    income = named("total_income")
    band = F.when(income <= 0, "none")
    for top, label in bands:
        band = band.when(income <= top, label)
    band = band.otherwise("100k_up")
    level = named("highest_qualification")
    degree = F.when(level.isin(*classes[0][0]), classes[0][1])
    for codes, label in classes[1:]:
        degree = degree.when(level.isin(*codes), label)
    degree = degree.when(level.isNull() & (F.lit(year) - named("birth_year") <= 65), "none")
    other = income - named("WAS_income") - named("BEN_income")
    derived = {
        "sex": F.when(named("sex_code=1") >= 1, "m").otherwise("f"),
        "has_WAS": F.when(named("WAS_income") >= 1, 1).otherwise(0),
        "has_OTH": F.when(other >= 10_000, 1).otherwise(0),
        "total_income_band": band,
        "highest_qual": degree,
    }
    for agency, balance in balances.items():
        derived[f"owes_{agency}"] = F.when(F.coalesce(named(balance), F.lit(0)) >= 1, 1).otherwise(0)
        derived[f"{agency}_{year}_trim"] = cap(named(balance), 50_000)
    return adults.withColumns(derived)


def adjusted_values(df: DataFrame, col: str, adjusters: Sequence[str] = (), min_rows: int | None = None) -> DataFrame:
    """G6. `adj`: the value less its mean in each adjuster group plus the overall mean.

    Adjusters are applied in turn, each dropping rows without a value for it; every
    step subtracts the mean of the value itself, not of the adjusted value.
    """
    data = df.filter(named(col).isNotNull())
    adjusted = data.withColumn("adj", named(col).cast("double"))
    if not adjusters:
        return adjusted
    overall = data.agg(F.avg(named(col))).scalar()
    for name in adjusters:
        with_mean = attach_group_stats(
            adjusted.filter(named(name).isNotNull()), [name], {"_avg": F.avg(named(col))}, min_rows
        )
        adjusted = with_mean.withColumn("adj", F.col("adj") - F.col("_avg") + overall).drop("_avg")
    return adjusted


def tabulate_means(df: DataFrame, group_col: str, label: str) -> DataFrame:
    """G7. Mean, sample deviation, total and number of `adj` per value of a column."""
    return (
        df.filter(named(group_col).isNotNull())
        .groupBy(named(group_col).cast("string").alias("subgroup"))
        .agg(
            F.avg("adj").alias("mean"),
            F.stddev_samp("adj").alias("sdev"),
            F.sum("adj").alias("total"),
            F.count(F.lit(1)).alias("num"),
        )
        .select(F.lit(group_col).alias("col"), "subgroup", F.lit(label).alias("label"), "mean", "sdev", "total", "num")
    )


def sweep_label(value: str, adjusters: Sequence[str]) -> str:
    return f"{value}_adj_{'_'.join(adjusters)}" if adjusters else f"{value}_raw"


def mean_sweep(
    df: DataFrame, groups: Sequence[str], values: Sequence[str], adjuster_sets: Sequence[Sequence[str]]
) -> DataFrame:
    """G8. `tabulate_means` for every group, value and set of adjusters, from one scan.

    Rows are first reduced to one per combination of group and adjuster values,
    holding count, mean and sum of squared deviations of each value. An adjustment
    shifts all rows of a combination alike, so means and deviations of the adjusted
    values follow from those, and the table itself is read once however many tables
    are asked for. Windows below hold combinations, never rows of the table.
    """
    adjusters = list(dict.fromkeys(a for s in adjuster_sets for a in s))
    dims = list(dict.fromkeys([*groups, *adjusters]))
    stats = []
    for i, v in enumerate(values):
        x = named(v).cast("double")
        stats += [
            F.count(x).alias(f"_n{i}"),
            F.avg(x).alias(f"_m{i}"),
            (F.var_pop(x) * F.count(x)).alias(f"_q{i}"),
        ]
    cells = df.groupBy(*[named(d).cast("string").alias(f"_d_{d}") for d in dims]).agg(*stats)
    by_value = F.array(
        *[
            F.struct(
                F.lit(v).alias("value"),
                F.col(f"_n{i}").alias("n"),
                F.col(f"_m{i}").alias("m"),
                F.col(f"_q{i}").alias("q"),
            )
            for i, v in enumerate(values)
        ]
    )
    dim_cols = [named(f"_d_{d}") for d in dims]
    tall = cells.select(*dim_cols, F.explode(by_value).alias("_v")).select(*dim_cols, "_v.*").filter("n > 0")
    # Means over combinations are windows, not joins of the table with itself, so
    # that the scan and the reduction above are planned once.
    whole = W.partitionBy("value")
    tall = tall.withColumn("_all", F.sum(F.col("n") * F.col("m")).over(whole) / F.sum("n").over(whole))

    depth = max((len(s) for s in adjuster_sets), default=0)
    sets = F.array(
        *[
            F.struct(
                F.lit(i).alias("set"),
                F.lit("_adj_" + "_".join(s) if s else "_raw").alias("suffix"),
                F.lit(len(s)).alias("len"),
                *[(named(f"_d_{s[k]}") if k < len(s) else F.lit("").cast("string")).alias(f"k{k}") for k in range(depth)],
            )
            for i, s in enumerate(adjuster_sets)
        ]
    )
    group_dims = [named(f"_d_{g}") for g in groups]
    work = tall.select(*group_dims, "value", "n", "m", "q", "_all", F.explode(sets).alias("_s")).select(
        *group_dims, "value", "n", "m", "q", "_all", "_s.*"
    )
    # Deviations from the overall mean; `shift` is what the adjusters add to them.
    work = work.withColumn("dev", F.col("m") - F.col("_all")).withColumn("shift", F.lit(0.0))
    for k in range(depth):
        key = f"k{k}"
        same = W.partitionBy("value", "set", key)
        mean = F.sum(F.col("n") * F.col("dev")).over(same) / F.sum("n").over(same)
        work = work.filter(F.col(key).isNotNull()).withColumn(
            "shift", F.col("shift") - F.when(F.col("len") > k, mean).otherwise(0.0)
        )
    by_group = F.array(
        *[F.struct(F.lit(g).alias("col"), named(f"_d_{g}").alias("subgroup")) for g in groups]
    )
    shifted = F.col("dev") + F.col("shift")
    summed = (
        work.withColumn("a", shifted)
        .select("value", "suffix", "_all", "n", "q", "a", F.explode(by_group).alias("_g"))
        .filter(F.col("_g.subgroup").isNotNull())
        .groupBy("_g.col", "_g.subgroup", "value", "suffix", "_all")
        .agg(
            F.sum("n").alias("num"),
            F.sum(F.col("n") * F.col("a")).alias("_sum"),
            F.sum(F.col("q") + F.col("n") * F.col("a") * F.col("a")).alias("_sq"),
        )
    )
    centre = F.col("_sum") / F.col("num")
    spread = F.greatest(F.col("_sq") - F.col("num") * centre * centre, F.lit(0.0))
    return summed.select(
        "col",
        "subgroup",
        F.concat("value", "suffix").alias("label"),
        (centre + F.col("_all")).alias("mean"),
        F.when(F.col("num") > 1, F.sqrt(spread / (F.col("num") - 1))).alias("sdev"),
        (F.col("_sum") + F.col("num") * F.col("_all")).alias("total"),
        "num",
    )


def pair_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """G9. Counts for each unordered pair of columns, rows with a NULL in the pair left out.

    Rows are first reduced to one per combination of all the columns.
    """
    cells = df.groupBy(*[named(c).cast("string").alias(f"_d_{c}") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("col1"),
                named(f"_d_{a}").alias("group1"),
                F.lit(b).alias("col2"),
                named(f"_d_{b}").alias("group2"),
            )
            for i, a in enumerate(cols)
            for b in cols[i + 1:]
        ]
    )
    return (
        cells.select(F.explode(pairs).alias("_p"), "_n")
        .select("_p.*", "_n")
        .filter(F.col("group1").isNotNull() & F.col("group2").isNotNull())
        .groupBy("col1", "group1", "col2", "group2")
        .agg(F.sum("_n").alias("num"))
    )

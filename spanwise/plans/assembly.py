"""Assembly: every population joined to every measure over a period, summarised, long then wide."""

from __future__ import annotations

import datetime as dt
import re
import warnings
import zlib
from collections import defaultdict
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.columns import named
from spanwise.functions.dates import as_date, days_inclusive, literal_day
from spanwise.operators.overlap import overlaps
from spanwise.operators.reshape import pivot_long
from spanwise.operators.skew import block_join
from spanwise.sources.tables import append_table, create_table, never_missing, read_table, write_table


@dataclass(frozen=True)
class Col:
    """Take the value from a column of the table."""

    name: str


@dataclass(frozen=True)
class Lit:
    """Use the same value on every row."""

    value: object


Input = Col | Lit


@dataclass(frozen=True)
class Population:
    table: str
    identity: Input
    label: Input
    start: Input
    end: Input
    period: Input


@dataclass(frozen=True)
class Measure:
    table: str
    identity: Input
    start: Input
    end: Input
    label: Input
    value: Input
    summary: str
    proportional: bool | str = False


SUMMARIES = ("SUM", "COUNT", "EXISTS", "MIN", "MAX", "DURATION", "HISTOGRAM", "DISTINCT", "MEAN")
_NUMERIC_ONLY = ("SUM", "MIN", "MAX", "MEAN")
_IGNORE_PROPORTION = ("COUNT", "EXISTS", "HISTOGRAM", "DISTINCT")
_TRUTH = {"true": True, "t": True, "false": False, "f": False}

RESULT_COLUMNS = (
    "identity_column",
    "label_identity",
    "summary_period_start_date",
    "summary_period_end_date",
    "label_summary_period",
    "label_measure",
    "value_measure",
)
_PERIOD = RESULT_COLUMNS[:5]
# Never NULL in stored output.
_REQUIRED = (RESULT_COLUMNS[0], *RESULT_COLUMNS[2:4], "label_measure")
# Partitions of output whose measures are replaced one by one.
PARTITION_COLUMNS = ("population_key", "measure_key")
DEV_ROWS = 1000


def _is_proportional(measure: Measure) -> bool:
    value = measure.proportional
    if isinstance(value, bool):
        return value
    if str(value).lower() not in _TRUTH:
        raise ValueError(f"proportional is {value!r}; use true, t, false or f")
    return _TRUTH[str(value).lower()]


def _column(given: Input) -> Column:
    return named(given.name) if isinstance(given, Col) else F.lit(given.value)


def _resolve(spark: SparkSession | None, tables: Mapping[str, DataFrame] | None, name: str) -> DataFrame:
    if tables is not None and name in tables:
        return tables[name]
    if spark is None:
        raise ValueError(f"no table named {name}")
    return read_table(spark, name)


def validate(
    populations: Sequence[Population],
    measures: Sequence[Measure],
    tables: Mapping[str, DataFrame] | None = None,
    spark: SparkSession | None = None,
) -> None:
    """Refuse unknown summaries, missing tables or columns, and sums of text. Reads schemas only."""
    if not populations or not measures:
        raise ValueError("at least one population and one measure are needed")
    for spec in (*populations, *measures):
        schema = {f.name: f.dataType for f in _resolve(spark, tables, spec.table).schema}
        for given in vars(spec).values():
            if isinstance(given, Col) and given.name not in schema:
                raise ValueError(f"table {spec.table} lacks column {given.name}")
        if isinstance(spec, Measure):
            summary = spec.summary.upper()
            if summary not in SUMMARIES:
                raise ValueError(f"summary is {spec.summary!r}; use one of {', '.join(SUMMARIES)}")
            if _is_proportional(spec) and summary in _IGNORE_PROPORTION:
                warnings.warn(f"{summary} does not depend on the share of a spell; proportional has no effect", stacklevel=2)
            if summary in _NUMERIC_ONLY and isinstance(spec.value, Col):
                kind = schema[spec.value.name]
                if not isinstance(kind, (T.NumericType, T.BooleanType)):
                    raise ValueError(
                        f"{summary} needs numbers, but {spec.table}.{spec.value.name} is {kind.simpleString()}"
                    )


def _population_frame(
    populations: Sequence[Population], tables: Mapping[str, DataFrame] | None, spark: SparkSession | None
) -> DataFrame:
    """All populations in one frame. `_spec` keeps them apart where they name the same person and period."""
    frames = []
    for number, spec in enumerate(populations):
        frames.append(
            _resolve(spark, tables, spec.table).select(
                F.lit(number).alias("_spec"),
                _column(spec.identity).cast("long").alias("identity_column"),
                _column(spec.label).cast("string").alias("label_identity"),
                _day(spec.start).alias("summary_period_start_date"),
                _day(spec.end).alias("summary_period_end_date"),
                _column(spec.period).cast("string").alias("label_summary_period"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), frames)


def _day(given: Input) -> Column:
    return named(given.name).cast("date") if isinstance(given, Col) else F.lit(literal_day(given.value))


def _fixed_window(populations: Sequence[Population]) -> tuple[dt.date, dt.date] | None:
    """First and last day of all periods, when every period is given as fixed dates."""
    dates = [(p.start, p.end) for p in populations]
    if any(isinstance(given, Col) for pair in dates for given in pair):
        return None
    return min(literal_day(s.value) for s, _ in dates), max(literal_day(e.value) for _, e in dates)


def _summary(kind: str, proportional: bool, value: Column) -> Column:
    whole_days = days_inclusive(F.col("_ms"), F.col("_me"))
    share = F.col("_overlap").cast("double") / whole_days if proportional else F.lit(1.0)

    def scaled() -> Column:
        return share * value.cast("double")

    if kind == "SUM":
        result = F.sum(scaled())
    elif kind == "MIN":
        result = F.min(scaled())
    elif kind == "MAX":
        result = F.max(scaled())
    elif kind == "MEAN":
        result = F.avg(scaled())
    elif kind == "COUNT":
        result = F.count(value)
    elif kind == "EXISTS":
        result = F.when(F.count(value) >= 1, 1).otherwise(0)
    elif kind == "DURATION":
        result = F.sum(F.col("_overlap") if proportional else whole_days)
    elif kind == "DISTINCT":
        result = F.count_distinct(value)
    else:
        raise ValueError(f"no such summary: {kind!r}")
    return result.cast("double")


def _matched(
    population: DataFrame,
    table: DataFrame,
    like: Measure,
    columns: Mapping[str, Column],
    window: tuple[dt.date, dt.date] | None,
    min_rows: int | None,
    spread: bool,
) -> DataFrame:
    """Population rows with the measure rows of the person that overlap the period.

    `window` is known to hold every period; measure rows outside it are left out at the scan.
    """
    rows = table.select(
        _column(like.identity).cast("long").alias("identity_column"),
        _day(like.start).alias("_ms"),
        _day(like.end).alias("_me"),
        *[expr.alias(name) for name, expr in columns.items()],
    )
    if window is not None:
        rows = rows.filter((F.col("_me") >= as_date(window[0])) & (F.col("_ms") <= as_date(window[1])))
    same_person = block_join(population, rows, ["identity_column"], min_rows) if spread else population.join(rows, "identity_column")
    joined = same_person.filter(
        overlaps(F.col("summary_period_start_date"), F.col("summary_period_end_date"), F.col("_ms"), F.col("_me"))
    )
    first = F.greatest("_ms", "summary_period_start_date")
    last = F.least("_me", "summary_period_end_date")
    return joined.withColumn("_overlap", days_inclusive(first, last))


def assemble(
    populations: Sequence[Population],
    measures: Sequence[Measure],
    tables: Mapping[str, DataFrame] | None = None,
    spark: SparkSession | None = None,
    development: bool = False,
    min_rows: int | None = None,
    spread: bool | Collection[str] = True,
) -> DataFrame:
    """A1-A11. Long table of every population by every measure.

    All measures that read one table over the same dates share one join and one
    aggregation. A person without a matching row of a table gets no row for its
    measures. Identities too common for one task are cut into parts on both sides of
    the join (`min_rows` sets from how many rows). `spread=False` leaves that out, for
    tables stored in buckets by identity, which then join and add up where they are;
    names of measure tables leave it out for all others.
    """
    return _assembled(populations, measures, tables, spark, development, min_rows, spread).select(*RESULT_COLUMNS)


def _assembled(
    populations: Sequence[Population],
    measures: Sequence[Measure],
    tables: Mapping[str, DataFrame] | None,
    spark: SparkSession | None,
    development: bool = False,
    min_rows: int | None = None,
    spread: bool | Collection[str] = True,
) -> DataFrame:
    """The result of `assemble` with the numbers of population (`_spec`) and measure (`_measure`)."""
    population = _population_frame(populations, tables, spark)
    window = _fixed_window(populations)
    together: dict[tuple, list[tuple[int, Measure]]] = defaultdict(list)
    for number, measure in enumerate(measures):
        together[(measure.table, measure.identity, measure.start, measure.end)].append((number, measure))

    results = []
    for group in together.values():
        inputs: dict[Input, str] = {}
        for _, measure in group:
            for given in (measure.value, measure.label):
                if isinstance(given, Col):
                    inputs.setdefault(given, f"_c{len(inputs)}")
        joined = _matched(
            population,
            _resolve(spark, tables, group[0][1].table),
            group[0][1],
            {name: _column(given) for given, name in inputs.items()},
            window,
            min_rows,
            spread if isinstance(spread, bool) else group[0][1].table in spread,
        )

        def as_joined(given: Input, inputs: dict[Input, str] = inputs) -> Column:
            return F.col(inputs[given]) if isinstance(given, Col) else F.lit(given.value)

        # Measures with the same extra grouping columns make a set. Matched rows are
        # repeated once per set inside the task, so that the join is made once and
        # all sets end in one aggregation.
        sets: dict[tuple[str, ...], list[tuple[int, Measure]]] = defaultdict(list)
        for number, measure in group:
            extra = [inputs[measure.label]] if isinstance(measure.label, Col) else []
            if measure.summary.upper() == "HISTOGRAM" and isinstance(measure.value, Col):
                extra.append(inputs[measure.value])
            sets[tuple(dict.fromkeys(extra))].append((number, measure))
        extras = list(dict.fromkeys(c for extra in sets for c in extra))
        numbers = F.array(*[F.lit(i) for i in range(len(sets))])
        repeated = joined.withColumn("_set", F.explode(numbers) if len(sets) > 1 else F.lit(0))
        for c in extras:
            used = [i for i, extra in enumerate(sets) if c in extra]
            repeated = repeated.withColumn(f"_by{c}", F.when(F.col("_set").isin(*used), F.col(c)))

        totals, cells = [], []
        for set_number, same in enumerate(sets.values()):
            of_set = []
            for number, measure in same:
                kind, label, value = measure.summary.upper(), as_joined(measure.label), as_joined(measure.value)
                total = F.count(value).cast("double") if kind == "HISTOGRAM" else _summary(
                    kind, _is_proportional(measure), value
                )
                totals.append(total.alias(f"_t{len(totals)}"))
                shown = F.col(f"_by{inputs[measure.label]}") if isinstance(measure.label, Col) else label
                if kind == "HISTOGRAM":
                    bar = F.col(f"_by{inputs[measure.value]}") if isinstance(measure.value, Col) else value
                    shown = F.concat(shown.cast("string"), F.lit("="), F.coalesce(bar.cast("string"), F.lit("")))
                of_set.append(
                    F.struct(
                        F.lit(number).alias("measure"),
                        shown.cast("string").alias("label"),
                        F.col(f"_t{len(totals) - 1}").alias("value"),
                    )
                )
            cells.append(F.when(F.col("_set") == set_number, F.array(*of_set)))
        summed = repeated.groupBy("_spec", *_PERIOD, "_set", *[f"_by{c}" for c in extras]).agg(*totals)
        results.append(
            summed.select("_spec", *_PERIOD, F.explode(F.coalesce(*cells)).alias("_m")).select(
                "_spec",
                *_PERIOD,
                F.col("_m.measure").alias("_measure"),
                F.col("_m.label").alias("label_measure"),
                F.col("_m.value").alias("value_measure"),
            )
        )
    long = reduce(lambda a, b: a.unionByName(b), results)
    if development:
        # The rank limit is applied in every task before rows of a pair meet.
        per_pair = W.partitionBy("_spec", "_measure").orderBy("identity_column", *_PERIOD[1:], "label_measure")
        long = long.withColumn("_rank", F.row_number().over(per_pair)).filter(F.col("_rank") <= DEV_ROWS)
    return long


def fixed_labels(measures: Sequence[Measure]) -> list[str] | None:
    """Labels known without looking at data, or None when some depend on it."""
    if any(isinstance(m.label, Col) or m.summary.upper() == "HISTOGRAM" for m in measures):
        return None
    return list(dict.fromkeys(str(m.label.value) for m in measures))


def rectangular(long: DataFrame, identity: str = "identity_column", labels: Sequence[str] | None = None) -> DataFrame:
    """A13. One row per person and period, one column per measure label."""
    renamed = long.withColumnRenamed("identity_column", identity)
    return pivot_long(renamed, "label_measure", "value_measure", "sum", labels)


def require_same_schema(target: DataFrame, rows: DataFrame, name: str) -> None:
    """Refuse a stored table that has other columns or types than the rows to be added. Order does not matter."""
    has = {f.name: f.dataType.simpleString() for f in target.schema}
    wants = {f.name: f.dataType.simpleString() for f in rows.schema}
    wrong = [f"{c} is {has.get(c, 'absent')} for {wants.get(c, 'nothing')}" for c in {**wants, **has} if has.get(c) != wants.get(c)]
    if wrong:
        raise ValueError(f"table {name} does not fit: {'; '.join(wrong)}")


def run_assembly(
    spark: SparkSession,
    populations: Sequence[Population],
    measures: Sequence[Measure],
    output: str,
    tables: Mapping[str, DataFrame] | None = None,
    overwrite: bool = False,
    checks_only: bool = False,
    skip_checks: bool = False,
    development: bool = False,
) -> DataFrame | None:
    """A12. Check, assemble and store.

    Without `overwrite`, rows are added to an existing output, which must have exactly
    the columns and types of the result. A missing identity, date or measure label stops
    the write, and nothing is stored.
    """
    if not skip_checks:
        validate(populations, measures, tables, spark)
    if checks_only:
        return None
    long = never_missing(assemble(populations, measures, tables, spark, development), _REQUIRED)
    if overwrite:
        return write_table(long, output, overwrite)
    if not _exists(spark, output):
        return create_table(long, output)
    require_same_schema(read_table(spark, output), long, output)
    return append_table(long, output, RESULT_COLUMNS)


def _key(spec: Population | Measure) -> str:
    """Name of a population or measure that stays the same from run to run, fit for a folder."""
    given = [v for k, v in vars(spec).items() if k in ("label", "period", "value")]
    parts = [spec.table, *[v.name if isinstance(v, Col) else str(v.value) for v in given]]
    if isinstance(spec, Measure):
        parts.append(spec.summary.upper())
    whole = repr(spec).encode()
    return "-".join([*[re.sub(r"[^A-Za-z0-9]+", "_", p) for p in parts], f"{zlib.crc32(whole):08x}"])


def replace_measures(
    spark: SparkSession,
    populations: Sequence[Population],
    measures: Sequence[Measure],
    output: str,
    tables: Mapping[str, DataFrame] | None = None,
    skip_checks: bool = False,
) -> DataFrame:
    """A12 on output with a partition per population and measure: those given are replaced, others stay untouched.

    `output` is a path. Populations and measures are known by table, label, period,
    value and summary. One that no longer has rows is emptied. Rows are computed once:
    which partitions have rows is noted while they are written.
    """
    if "/" not in output:
        raise ValueError("output with partitions is kept under a path")
    if not skip_checks:
        validate(populations, measures, tables, spark)
    names = [[_key(spec) for spec in specs] for specs in (populations, measures)]
    if any(len(set(n)) < len(n) for n in names):
        raise ValueError("two populations or two measures are the same")
    long = never_missing(_assembled(populations, measures, tables, spark), _REQUIRED)
    keys = [
        F.element_at(F.array(*[F.lit(k) for k in of]), F.col(number) + 1).alias(c)
        for of, number, c in zip(names, ("_spec", "_measure"), PARTITION_COLUMNS, strict=True)
    ]
    seen = Observation()
    keyed = long.select(*RESULT_COLUMNS, *keys).observe(seen, F.collect_set(F.struct(*PARTITION_COLUMNS)).alias("filled"))
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION_COLUMNS)
    existed = _exists(spark, output)
    writer.parquet(output)
    filled = {tuple(k) for k in seen.get["filled"]}
    stored = spark.read.schema(keyed.schema).parquet(output)
    if existed:
        # A partition is overwritten where there are rows for it; one without is emptied by itself.
        for key in sorted({(p, m) for p in names[0] for m in names[1]} - filled):
            held = [F.col(c) == k for c, k in zip(PARTITION_COLUMNS, key, strict=True)]
            if not stored.filter(held[0] & held[1]).isEmpty():
                folder = "/".join(f"{c}={k}" for c, k in zip(PARTITION_COLUMNS, key, strict=True))
                stored.select(*RESULT_COLUMNS).limit(0).write.mode("overwrite").parquet(f"{output.rstrip('/')}/{folder}")
                stored = spark.read.schema(keyed.schema).parquet(output)
    return stored


def _exists(spark: SparkSession, name: str) -> bool:
    if "/" not in name:
        return spark.catalog.tableExists(name)
    try:
        read_table(spark, name)
    except AnalysisException:  # nothing there, or no table in it
        return False
    return True

"""Reading, storing and publishing tables, by catalogue name or by path."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.columns import as_list, named, require_columns


def _is_path(name: str) -> bool:
    return "/" in name


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """IO1. Lazy handle on a catalogue table or view, or on a parquet path."""
    if _is_path(name):
        return spark.read.parquet(name)
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table or view named {name}")
    return spark.table(name)


def _write(df: DataFrame, name: str, mode: str) -> DataFrame:
    if _is_path(name):
        df.write.mode(mode).parquet(name)
    else:
        df.write.mode(mode).saveAsTable(name)
    return read_table(df.sparkSession, name)


def write_table(df: DataFrame, name: str, overwrite: bool = False) -> DataFrame:
    """IO2. Store and return a handle on what was stored."""
    return _write(df, name, "overwrite" if overwrite else "errorifexists")


def create_table(df: DataFrame, name: str) -> DataFrame:
    """Store under a name that holds no table yet; the empty folder that a failed write leaves is no obstacle."""
    return _write(df, name, "append")


def scratch_path(spark: SparkSession, label: str) -> str:
    """New location under the folder the session names for shared intermediate data.

    A session on one machine may leave it unset and gets a local folder; on a cluster
    that would leave each executor with files no other one sees, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "spanwise-scratch")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_cols: str | Sequence[str] | None = None) -> DataFrame:
    """IO3. Store an intermediate table and continue from the stored copy.

    Lineage ends at files on shared storage, so the copy outlives lost executors.
    `partition_cols` puts rows of a key into the same files, which tightens the
    column statistics that scans skip by. The rebalance hint lets Spark split a
    key that is too common for one task.
    """
    keys = as_list(partition_cols)
    clustered = df
    if keys:
        clustered = df.hint("rebalance", *keys).sortWithinPartitions(*[named(c) for c in keys])
    path = scratch_path(df.sparkSession, "step")
    clustered.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Steps:
    """Intermediate tables of one piece of work, stored once and removed together.

    Tables are kept in a database of their own under the shared folder, bucketed and
    sorted by a key where one is given, so that what groups or joins them by it needs no
    exchange. That fits tables with few rows per key, such as condensed spells: all rows
    of a key are in one bucket. What is still needed afterwards is to be stored elsewhere.

        with Steps(spark) as steps:
            work = steps.keep(employment_spells(returns), "work", "snz_uid")
            report = materialise(summary(work))
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"steps_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{scratch_path(spark, 'steps')}'")

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def keep(self, df: DataFrame, label: str, key: str | Sequence[str] | None = None) -> DataFrame:
        """Store a table under a name of its own and continue from the stored copy."""
        keys = as_list(key)
        name = f"{self.database}.{label}"
        if keys:
            # One task writes a bucket, so that there are no more files than buckets.
            clustered = df.repartition(self.buckets, *[named(k) for k in keys])
            clustered.write.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)
        else:
            df.write.saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Remove all tables kept, with their files."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


def write_observed(
    df: DataFrame, name: str, metrics: Mapping[str, Column], overwrite: bool = False
) -> tuple[DataFrame, dict[str, object]]:
    """IO2 with figures gathered on the way: a handle on what was stored, and the value of each aggregate.

    The rows are computed once, for the write and the figures together.
    """
    seen = Observation()
    stored = write_table(df.observe(seen, *[expr.alias(m) for m, expr in metrics.items()]), name, overwrite)
    return stored, seen.get


def never_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows; whoever computes a row with a NULL in one of the columns fails, so nothing of it is stored."""
    kinds = {f.name: f.dataType for f in df.schema}
    checked = {c: F.coalesce(named(c), F.raise_error(F.lit(f"{c} is missing")).cast(kinds[c])) for c in columns}
    return df.withColumns(checked)


def append_table(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """IO4. Add rows to an existing table, matched by column name."""
    spark = df.sparkSession
    require_columns(df, columns, "table to append")
    target = read_table(spark, name)
    require_columns(target, columns, "target table")
    types = {f.name: f.dataType for f in target.schema}
    fitted = df.select(
        *[
            named(c).cast(types[c]).alias(c) if c in columns else F.lit(None).cast(types[c]).alias(c)
            for c in target.columns
        ]
    )
    return _write(fitted, name, "append")


def create_view(df: DataFrame, name: str, overwrite: bool = False) -> DataFrame:
    """IO5. Named lazy definition."""
    if overwrite:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)
    return df.sparkSession.table(name)


def write_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """IO6. Final table as CSV with a header."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def dev_sample(df: DataFrame, key: str, mod: int = 100) -> DataFrame:
    """IO7. Repeatable sample for development: identities divisible by `mod`."""
    return df.filter(named(key) % mod == 0)

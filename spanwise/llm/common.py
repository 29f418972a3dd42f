"""Helpers shared by the text operators: shared storage, map over whole texts, row keys."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.columns import named

#: Bytes of text handled at a time within a task; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parents[2]
    return shutil.make_archive(f"{tempfile.mkdtemp()}/spanwise", "zip", root, "spanwise")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions that were not started with it on their path."""
    if "spanwise.zip" not in {Path(f).name for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addPyFile(_archive())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a session on one machine may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/spanwise-llm"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so nothing is computed twice or lost."""
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about `most` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    start: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    fields: str,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: its id and the columns `fields` computed from its whole text.

    `start` runs once in each task and returns the function applied to lists of texts.
    No shuffle; a task holds one slice of about `most` bytes of text at a time.
    """
    source = docs.select(named(id_col), named(text_col).cast("string"))
    id_field = source.schema[0]
    schema = f"`{id_col}` {id_field.dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in text_slices(batches, most=most):
            columns = work(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=wanted)

    wanted = [id_col, *T.StructType.fromDDL(fields).fieldNames()]
    return source.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null ids count as empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % mod


#: Numbers of 64 bits in a table of key bits; more keys than bits only make it name more rows.
BIT_WORDS = 1 << 18


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """Table of bits of hashed keys: rows `word` and `bits`, at most `BIT_WORDS` whatever the number of keys."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    return keys.select(_word(F.col(key)).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(BIT_WORDS - 1))


def with_named(df: DataFrame, key: Column, bits: DataFrame, out_col: str) -> DataFrame:
    """Add whether the table names the row's key: true for each of its keys, and for some others. Null keys are not named."""
    word, held = fresh(df, "word"), fresh(df, "held")
    met = df.join(F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(held))), _word(key) == named(word), "left")
    bit = F.call_function("shiftright", F.coalesce(named(held), F.lit(0).cast("long")), key.bitwiseAND(F.lit(63)).cast("int"))
    return met.select(*[named(c) for c in df.columns], F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False)).alias(out_col))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a result whose size has a bound; a result beyond it is refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows

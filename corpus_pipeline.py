"""From raw documents to token ids: toxicity, repeated lines, near duplicates, mix of sources, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.columns import named
from spanwise.llm.byte_bpe import decode, encode
from spanwise.llm.common import fresh, ship, store, table
from spanwise.llm.line_dedup import drop_repeated_lines
from spanwise.llm.mixing import fit_mix, sample_mix
from spanwise.llm.near_dedup import drop_near_duplicates
from spanwise.llm.queries import RANK_FILE, margins
from spanwise.llm.topics import with_profiles
from spanwise.llm.toxicity import drop_toxic, fit_toxicity

#: Share of the token weight that the mix keeps, and how far it moves towards equal shares (0: equal, 1: as they are).
MIX_KEEP = 0.8
MIX_TEMPER = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones."""
    ship(spark)
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents stay in the first one only."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics are nearer to equal shares; all columns keep their values."""
    ship(spark)
    counts = fresh(docs, "profile")
    profiled = with_profiles(docs, "text", counts)
    found = margins(profiled, counts)
    mix = fit_mix(profiled, found, temper=MIX_TEMPER)
    return sample_mix(profiled, found, mix, keep=MIX_KEEP, rate_col=fresh(profiled, "rate")).select(*[named(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text decoded from them."""
    ship(spark)
    path = public_tokenizers.path(RANK_FILE)
    done = decode(encode(docs, path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id", "n_tokens", "ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Scores of a fitted model, hash signatures and the draw of a sample are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

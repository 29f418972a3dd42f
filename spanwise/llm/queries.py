"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.byte_bpe import decode, encode
from spanwise.llm.common import fold_remainder, ship, table
from spanwise.llm.hard_negatives import mine_hard_negatives
from spanwise.llm.language_id import fit_languages, predict_language
from spanwise.llm.line_dedup import dedup_lines
from spanwise.llm.mixing import fit_mix, sample_mix
from spanwise.llm.near_dedup import near_duplicates
from spanwise.llm.neighbours import nearest_neighbours
from spanwise.llm.oracles import HARD_NEGATIVES, LINE_DEDUP
from spanwise.llm.periodic_runs import periodic_runs
from spanwise.llm.quality import classify_quality
from spanwise.llm.sentence_pieces import decode as decode_pieces
from spanwise.llm.sentence_pieces import encode as encode_pieces
from spanwise.llm.token_counts import count_tokens
from spanwise.llm.topics import fit_topics, topic, with_profiles
from spanwise.llm.topk_search import search
from spanwise.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
JSON_FILE, RANK_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON_FILE), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_remainder("doc_id", 4) == 2
    model = fit_languages(docs.filter(~held_out))
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return classify_quality(table(spark, sf_dir, "documents"), trusted)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def margins(docs: DataFrame, profile_col: str) -> dict[str, Column]:
    """Source, language and topic; topics are clusters of the words of all documents, by the profiles of their texts."""
    found = topic(fit_topics(docs, profile_col=profile_col), profile_col=profile_col)
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": found}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_profiles(table(spark, sf_dir, "documents"), "text", "profile")
    found = margins(docs, "profile")
    return sample_mix(docs, found, fit_mix(docs, found)).select("doc_id", "source", "lang", "rate")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), keep=lambda c: fold_remainder(c, 5) != 0)
    held_out = (fold_remainder("doc_id", 5) == 0).alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.filter("doc_id % 100 = 0"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_FILE)
    done = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def planted(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` of documents, of which one in ten, by its id, repeats a stretch of its own words to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # The words are a column of their own: each of the steps below reads them, none splits the text again.
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    measured = split.withColumn("n", F.size("words")).withColumn("begin", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("begin")
    period = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil(rest / period).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("begin") + 1, period), times))
    whole = F.concat(F.slice("words", F.lit(1), F.col("begin")), F.slice(repeated, F.lit(1), rest))
    return measured.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    best = F.reduce(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        F.get(runs, F.lit(0)),
        lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b),
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_token_counts, op2_language_id, op3_line_dedup, op4_quality, op5_near_dedup,
        op6_mixing, op7_neighbours, op8_byte_bpe, op9_toxicity, op10_search,
        op11_hard_negatives, op12_sentence_pieces, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP, "op11_hard_negatives": HARD_NEGATIVES}

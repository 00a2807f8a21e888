"""A corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, language_id, mixing, near_dups, token_files

#: A text whose likeliest language has less than this share of its words is no text of one language; it goes.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no language."""
    model = language_id.fit(docs)
    told = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model, id_col="row")
    return told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class, that of the smallest doc_id (rows without one come last), and all rows without words once for each doc_id."""
    # a row's key is its doc_id and text: rows that share it are copies, whichever of them stays
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    told = near_dups.join_near(docs.select(key.alias("key"), "text"), id_col="key")
    kept = told.where("set_id is not null and doc_id = class_id").select(F.col("doc_id").alias("kept_key")).distinct()
    wordless = told.where("set_id is null").select(F.col("doc_id").alias("kept_key")).distinct()
    keyed = docs.withColumn("row_key", key)
    named = keyed.join(kept.unionByName(wordless.where("not kept_key.unnamed")), F.col("row_key").eqNullSafe(F.col("kept_key")), "left_semi").dropDuplicates(["row_key"])
    rest = keyed.where("doc_id is null").join(wordless.where("kept_key.unnamed"), F.col("row_key").eqNullSafe(F.col("kept_key")), "left_semi")
    return named.unionByName(rest).drop("row_key")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark; cut what the others have of it."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rest = [c for c in docs.columns if c != "text"]
    got = decontaminate.decontaminate(docs.select(F.struct(*map(common.name, rest)).alias("row"), "text"), bench, with_text=True, id_col="row")
    got = got.where((F.col("n_hit") == 0) | (20 * F.col("n_hit") < F.col("n_words"))).select("doc_id.*", "text", "n_hit")
    if "n_chars" in rest:
        got = got.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.select(*map(common.name, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say of each document."""
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Tokenizing, trained models and index searches are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table documents. What a stage wrote on its way goes once its rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with common.freed(spark, kept=("stage",)):
            docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

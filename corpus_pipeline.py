"""Cleans a text collection and packs it into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from factorlake.llm import latent_decontam, line_bitmaps, near_copies, packing, span_language
from factorlake.llm.workers import importable
from factorlake.session import stable

ORACLE_SQL = None  # language models, SimHash groups and packing have no SQL form; tested against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that name a language; rows without any letter (``und``) go, and only they if none does."""
    importable(spark)
    model = span_language.learn(docs)
    if not model.langs:
        return docs.where(span_language.has_letter("text"))
    return span_language.identify(docs, model, name="__language").where(F.col("__language.lang_pred") != "und").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go, but one of each stays: the first one, if it has 100 code
    points or shared lines are at least half of its document, so a document with many copies is left once
    and short boilerplate in texts of their own goes everywhere. n_chars follows the text."""
    importable(spark)
    kept = line_bitmaps.drop_lines(docs, min_docs=10, min_chars=1, keep_first=True, long_chars=100, counts=("__lines", "__dropped"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a Jaccard similarity of 0.8 or more with an earlier one go.

    SimHash fingerprints in tiles name the groups, exact sets decide; what lies beyond three bits is found by MinHash bands."""
    importable(spark)
    return near_copies.one_per_group(docs, similarity=0.8, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    importable(spark)
    return latent_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096 tokens."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, keep_ids=False)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

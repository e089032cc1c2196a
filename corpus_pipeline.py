"""Corpus pipeline: language ID, quality rules, SimHash near-duplicates, best-fit packing, each over what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridproof.llm import language_id, packing, quality_rules, simhash
from gridproof.llm.common import packed, read_table, written

#: Learned languages must have this share of a document together, or it is of no language.
LEAST_KNOWN = 0.5
#: With fewer trigrams than this a text is too short to be told from gibberish, and stays.
LEAST_GRAMS = 30
#: Fewer words than this say nothing about quality; such documents go.
LEAST_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, no text, or, from LEAST_GRAMS trigrams on, that learned languages explain by less than LEAST_KNOWN.

    ``lang`` is the predicted language from here on. Every row is judged by its own text; nothing is shuffled, repeated rows
    are judged each, an empty table stays one, and no column of ``documents`` can clash.
    """
    found = packed(docs, "text").select("row", language_id.mixture_of(F.col("text"), language_id.fitted(docs)).alias("found"))
    told = (F.col("found.known") >= LEAST_KNOWN) | (F.col("found.n_grams") < LEAST_GRAMS)
    kept = found.where((F.col("found.lang_pred") != "und") & told)
    return kept.select(*[F.col("found.lang_pred" if c == "lang" else f"row.`{c}`").alias(c) for c in docs.columns])


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have fewer than LEAST_WORDS words, repeat themselves, or whose perplexity is outside their language's band."""
    return quality_rules.rows_in_bands(docs, min_words=LEAST_WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays; of equal rows, one."""
    return simhash.first_of_groups(docs, words=4, radius=4)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences of 1024 tokens."""
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Language models, fingerprints and packing aren't SQL: the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

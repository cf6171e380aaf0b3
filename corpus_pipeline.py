"""A training corpus from raw documents: quality, language, near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a
stage returns to the shared folder and gives it, read again, to the next one.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import kneser_ney, langid, mixing, ngram_join, sentencepieces
from kinfold.llm.common import table
from kinfold.shared import shared

#: A document is rejected if its words are less than so many times as likely in its language as in the others on average.
LEAST_LANGUAGE_LEAD = 1.6


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the perplexity under trusted text's model lets pass."""
    return kneser_ney.keep_good(docs.select(*COLUMNS), kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language does not lead the others, however many there are."""
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs, model, keep=COLUMNS)
    leads = F.col("score") * (len(model.langs) - 1) >= LEAST_LANGUAGE_LEAD * (1 - F.col("score"))  # with one language both sides are 0
    return judged.where((F.col("lang_pred") != langid.UND) & leads).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document of the mix."""
    return sentencepieces.token_digests(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("tokens", tokens)]

#: Language models and SentencePiece are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

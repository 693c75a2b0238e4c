"""A training corpus from `documents`: language, near duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermobox.llm import language_id, near_dedup, pii, source_mix, token_packing
from thermobox.llm.common import stored, table, tokenizer_file

#: Words that the mix may add, as a share of all words, and copies of a document at most.
REPEATED_SHARE, MOST_COPIES = 0.25, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters and doubtful ones go."""
    return language_id.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 5-word shingles at 0.8 or more.

    Rows of one doc_id with different texts are judged one by one. Rows without a doc_id stay.
    """
    return near_dedup.distinct_documents(docs, width=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data or secrets is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, those of light sources repeated.

    Each source's target is its size and a share of REPEATED_SHARE of all words, by the square root of
    its size and at most its size again, so no document is lost and small sources gain weight.
    Light sources come late. A document without a word is trained on once, at the start.
    """
    rows = source_mix.prepare(docs, docs.columns)
    sums = source_mix.range_sums(rows)
    sources = source_mix.list_sources(sums).withColumn("weight", F.sqrt("size"))
    totals = sources.agg(F.sum("size").alias("words"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size DESC)").alias("middle")).first()
    words, middle = totals["words"] or 0, totals["middle"] or 0
    more = source_mix.fill_targets(sources, REPEATED_SHARE * words, MOST_COPIES - 1)
    mix = more.withColumn("target", F.col("size") + F.col("target"))
    late = (F.col("size") < middle).cast("int")
    schedules = (source_mix.FLAT, ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
    assigned = source_mix.assign_positions(rows, sums, mix, schedules, late, cut=False)
    return source_mix.training_order(assigned).select("mix_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens."""
    return token_packing.op6(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A random field and a tokenizer have no SQL form; tests/llm/test_corpus_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

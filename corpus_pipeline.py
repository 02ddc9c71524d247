"""A corpus pipeline: documents to training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, those that a table has besides among them.

Cases, of every stage: an empty table gives an empty one of the same columns; null ids, languages, sources and counts are
kept as they are; repeated rows are rows of their own until near duplicates go; other columns pass whatever their names.
What a stage does with null, empty and very long texts, and with ties, stands with it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import language_kernel, line_spread, ngram_join, sentencepiece_unigram, source_mix
from folioflow.llm.common import remove, scratch, shared_folder, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letters, so null and empty texts, or a score no better than chance.

    Texts are scored whole. Where no row has a language to learn from, none can be told, and all go.
    """
    return language_kernel.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites are cut from the texts; n_chars follows where a line went. Copies of a text are left to the next stage.

    Null texts stay null, empty lines stay, and a text may become empty; texts of any length are read whole.
    """
    own = ["doc_id", "text", "source", "n_chars"]
    others = [c for c in docs.columns if c not in own]
    # other columns travel as one, so that none is taken for one of the operator's
    packed = docs.select(*own, F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in others)).alias("__others"))
    cut = line_spread.remove_spread_lines(packed, copies_count=False)
    changed = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*(F.col(c) if c in own else F.col("__others").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id, nulls last, and of rows of one id that of the least hash.

    Null texts and those without words are like nothing and stay.
    """
    return ngram_join.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of a seeded hash; rows of one id and text are taken alike.

    Null and empty texts have no words and are not taken; null sources are one source.
    """
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; null and empty texts have none. Other columns than the id and the text are not read."""
    return sentencepiece_unigram.encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", tokens),
]

#: Seeded hashes, kernels and trained scores are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written and takes the place of the one before, with all that it staged on its way."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        before, path = path, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = stage(function(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the docs of the
next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontaminate, language_id, line_chunks, minhash, packing
from marquee.llm.common import stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; texts without a letter go."""
    return language_id.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and passages of lines go; so does a document of which nothing else is left."""
    done = line_chunks.dedup_lines(docs, passages=True)
    emptied = (F.col(done.columns[-1]) > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    left = done.filter(~emptied).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the language model nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

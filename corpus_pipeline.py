"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage gives the columns of its input, whatever others there are besides those of documents and however they are
named, and an empty table for an empty one. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, language, mixing, neardup, substrings
from siltstone.llm.common import table, written


#: Percent of shared five-word shingles from which documents are near copies.
NEAR = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the network is sure of, go.

    Null and empty texts have no letters. Rows that repeat an id are judged each by itself, equal texts alike.
    """
    return language.keep_known(docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; of rows that repeat an id the first text.

    Texts without words, null ones among them, are copies of nothing; rows without an id stay.
    """
    return neardup.keep_first(docs, percent=NEAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has are cut out; a document left without text goes.

    Characters that a cut splits go with it, and n_chars is set anew. Rows without an id stay as they are, a null text
    becomes an empty one.
    """
    return substrings.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go.

    Null and empty texts, and an empty benchmark, hit nothing.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities that rake tokens to the marginals.

    Rows without an id, or that repeat one, are drawn alike; null sources and languages are one of their own; a
    document without tokens stays.
    """
    return mixing.sample(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", first_of_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("mix_sources", mixed),
]

#: The trained network and the sketches are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

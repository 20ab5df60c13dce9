"""Five stages from raw documents to packed training sequences, each written as Parquet and read again by the next.

Defined cases of all stages: an empty table gives an empty one; other columns come through every stage but the last
as they are; very long texts are read whole.  Null and empty texts, and those without a letter, go in the first stage, which says so.
A null doc_id is nobody's copy, so its row stays where its text does; repeated rows with one doc_id and text are one document and all stay;
of rows with one doc_id and several texts, those of a doc_id that is a copy go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeprobe.llm import jaccard_join, language_id, packing, positional_index, secret_scan
from lakeprobe.llm.common import Scratch, without
from lakeprobe.llm.queries import read, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language stay; lang becomes the one that was identified.  Null texts and those without a letter go."""
    return language_id.keep_identified(docs, language_id.sample_texts(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked ones stays, and so do those without a doc_id or a word."""
    found = jaccard_join.components(docs)
    return without(docs, found.where("component_id < doc_id").select("doc_id"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark stay, null texts too; rows are judged one by one, whatever their doc_id."""
    return positional_index.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark.  A null text stays null."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, a power of two at the end; a null or empty text has its end id alone."""
    return packing.pack(docs, tokenizer_path(), with_ids=False).drop("ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packed)]

#: Tokens and automata can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs

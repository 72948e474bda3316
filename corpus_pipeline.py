"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet in the shared folder and read again as the next one's docs. All but the last return the columns of documents.

In every stage: an empty table gives an empty one; rows are never told apart by id alone, so repeated rows and rows with one id are judged as rows; nulls in other columns, and columns whose names operators use themselves, pass through as they are. What null, empty and long texts and ties give stands with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, linededup, neardup, pieces, quality
from leafmill.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the lines that fail. Null and empty texts have under ten words and go; long ones are judged whole. Rules look at one row, so there are no ties."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or nearly equal lines the first stays; documents that lose their last word go. Null and empty texts have no lines and stay; of a document's lines any number may go. First is by id, null first, then text, then line number; equal rows keep the same lines."""
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five-word shingles stays: that with the smallest id, null last; of ties one. Null texts and texts without words are one group; long ones are compared whole."""
    return neardup.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go (eight words of it, or all where it has fewer). Null and empty texts hold none and stay; long ones are searched whole. Each row is judged alone, so there are no ties; a null item counts for nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and the text they decode to, for each row. Null and empty texts have no ids and decode to an empty one; long ones are encoded whole. No row depends on another."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("SentencePiece", token_ids),
]

#: SQL can express neither classes of near copies nor piece ids; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.

Every stage takes empty tables (and gives none, or no rows), null and empty texts, repeated rows and further columns of any
name. Null and empty texts score as the constant does in the first stage and fail the fixed rule of the second; rows without an
id pass the others as documents of their own. Ties go to the lowest id. Very long texts are read whole, each in one task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import lines, minhash, packing, quality, toxicity
from marlpit.llm.tables import remove, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the classifier learns from the labels of the tables given.

    Without labels, or texts that bear them, the score is a constant below that, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor the learnt decision list rejects; without labels the list is empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near copies of an earlier one; n_chars follows the text.

    A document that loses all its lines stays, with an empty text; of rows that share an id and a text each keeps the same lines.
    """
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; rows that share the id all stay."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 4096 tokens; a null or empty text is one piece, its end alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Tokens and learnt models can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written in the shared folder and read again. A stage's intermediate tables
    and the table it has read are deleted when it is written, so that the last stage's input is all that stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scope(spark) as result:
            docs = result(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = os.path.dirname(docs.inputFiles()[0])
    return STAGES[-1][1](spark, docs, sf_dir)

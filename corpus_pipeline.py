"""A corpus pipeline of five stages, each one operator of tidalframe.llm on all that the stage before kept.

Every stage takes any columns beside doc_id, text, source and n_chars, whatever their names, and an empty table gives an
empty one.  Null texts count as empty; texts may be of any length; rows are rows, whatever ids they share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm.line_dedup import PASSAGE_RUN, PASSAGE_UNIT, without_repeats
from tidalframe.llm.mixing import mixed
from tidalframe.llm.ngram_join import one_per_group
from tidalframe.llm.packing import pack
from tidalframe.llm.queries import tokenizer_file
from tidalframe.llm.storage import settle
from tidalframe.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go.

    Null and empty texts stay, as a text without marked words does; repeated rows fare alike; a null doc_id is judged by its text; without
    labels of both kinds all stay.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row with the smallest doc_id, null being the largest.

    Texts without words are near nothing and stay.  Of rows repeated whole one stays; different texts under one doc_id that is the
    smallest of its group all stay.
    """
    return one_per_group(docs)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 25 words or more that occur earlier in the corpus go; n_chars follows the text where any went.

    Earlier is a smaller doc_id, null being the largest, then the row read first, then the place in the text.  Null and empty
    texts stay as they are; a document of which nothing is left stays with an empty text.
    """
    out = without_repeats(docs, unit_words=PASSAGE_UNIT, run_words=PASSAGE_RUN)
    left = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", left).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights, by whole documents: a row stays 0, 1 or 2 times.

    A null source is one of its own, ordered last; rows that share a doc_id and source are taken alike; sources without words
    have no target, so their rows go.
    """
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens: a row a piece, see packing.pack.

    Null and empty texts are one end token; repeated rows and null ids are packed as often as they occur.
    """
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("substring_dedup", repeated_passages_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: A learnt model and a tokenizer can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs

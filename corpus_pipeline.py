"""Corpus pipeline: documents in, token ids of the cleaned documents out.

Each stage takes the table that the one before it wrote.  All but the last
return the columns of ``documents``.

Defined results: extra columns stay as they are, whatever their names, up to
the last stage, which adds ``ids``.  Rows without doc_id are judged by the
classifier like others (null, empty and wordless texts are rejected) and pass
the stages between unchanged; of rows that repeat doc_id and text one stays, of
near duplicates the least doc_id; a text whose passages all occurred before
becomes empty and stays; without labels of both kinds, or without a benchmark,
the stage concerned keeps all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.bpe import encode
from tabulon.llm.contamination import drop_leaks
from tabulon.llm.groups import unused
from tabulon.llm.near import keep_one
from tabulon.llm.quality import keep_good
from tabulon.llm.session import Scratch
from tabulon.llm.suffix import remove_repeats


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), column=f"{unused(docs)}score").select(docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occurred before."""
    return remove_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return encode(docs)


STAGES = [("quality classifier", good), ("near duplicates", unlike), ("suffix-array dedup", unrepeated), ("decontamination", clean), ("byte-level BPE", encoded)]
#: Classifier, alignment and BPE can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = s.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        s.drop(f"stage-{k - 1}")
    return docs

"""The corpus pipeline: stages over documents, each writing what the next one reads.

Edge cases are those of the operators, stage by stage:

* a document whose text is null, empty or without a letter goes in the first stage;
* null or repeated doc_ids, sources and languages are rows like others; of repeated rows that are near
  copies of each other, those with the smallest doc_id of the group stay;
* a document whose lines all go keeps its row until the mix, which takes no words from it;
* very long texts are handled whole; an empty table gives an empty result;
* all but the last stage return the columns of documents, extra ones with their own values whatever
  their names (names that begin with two underscores are kept for the operators).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import langid, line_dedup, minhash, mixing, packing
from tidewater.llm.common import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that can be told."""
    return langid.reject_unknown(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many sources share from the texts; every document stays."""
    return line_dedup.dedup_lines(docs, counts=False)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8)."""
    return minhash.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source the words of its target: a row for each pass over a document."""
    return mixing.mix_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the mix took into sequences of 4096 tokens: a row a piece, with its token ids.

    Rows of one doc_id are passes of the mix over that document, told apart by their ids.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages learn models and sketch sets, which SQL cannot express; tests/llm/test_pipeline.py
#: compares each stage with plain Python on what its predecessor kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: documents in, packed training bins out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents. Nulls, empty and very long texts, repeated
rows, empty tables and extra columns are treated as the operators' docstrings define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import exact_dedup, mixing, near_dedup, packing, quality
from lodegraph.llm.common import table
from lodegraph.plans.steps import remove, scope, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; its labels come from the labels table."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text: of the half that came before by itself, then of the other half against its hash."""
    history, batch = exact_dedup.halves(docs)
    return exact_dedup.keep_first(history).unionByName(exact_dedup.keep_first(batch, exact_dedup.index(history)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources, repeated where a source falls short."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: doc_id, piece, tokens, class, bin_id, slot."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("source mixing", mix), ("packing", pack)]

#: A trained classifier and SimHash groups are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a table in the shared folder, the last of which stays."""
    docs = table(spark, sf_dir, "documents", "doc_id")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs

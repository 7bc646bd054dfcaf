"""The corpus pipeline: quality rules, line and near de-duplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
its result is written as Parquet to the shared folder and read again. All stages but the
last return the columns of ``documents``. A row without a doc_id passes the stages that compare
documents, as nothing can refer to it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwright.llm.decontaminate import find_items
from pinwright.llm.lines import drop_lines
from pinwright.llm.pieces import digests, round_trip
from pinwright.llm.quality import quality_rules
from pinwright.llm.simhash import fingerprints, near_components
from pinwright.sources.shared import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller id holds too; n_chars follows the text."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    prints = staged(fingerprints(docs), "simhash")
    others = near_components(prints).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(staged(others, "near-copies"), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = staged(find_items(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and digests of ids and decoded text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(round_trip(docs, model, carry=("doc_id", "source")), ("doc_id", "source", "ids"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]

#: Compression, fingerprints and the tokenizer are beyond SQL; tested by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

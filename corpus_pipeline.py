"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on every row it is given; all but the last
return the columns of `documents`, whatever further columns docs has. Null or letterless texts
go in the first stage, as do those whose language is in doubt; rows without doc_id take part in
all stages, but have no near duplicates; an empty table passes through all stages and packs to
no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadgrid.llm import decontaminate as bench
from quadgrid.llm import langid, line_dedup, near_dedup, packing
from quadgrid.llm.common import cut, table
from quadgrid.llm.id_filter import rows_by_id


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose predicted language has a calibrated score
    below `langid.MIN_SCORE`."""
    return langid.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all texts but one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, report=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, and of its
    equal rows (doc_id, text) one. Texts move only where a document has equal rows."""
    found = near_dedup.near_duplicates(docs)
    out = rows_by_id(docs, found.where(~F.col("kept")).select("doc_id"), inside=False)
    equal = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).count().where("count > 1 AND doc_id IS NOT NULL")
    equal = cut(equal.select("doc_id").distinct(), "equal-rows")
    if not equal.limit(1).count():
        return out
    return rows_by_id(out, equal, inside=False).unionByName(rows_by_id(out, equal, inside=True).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows are named by a hash of id and text, so that
    one without doc_id, or that shares it with a clean one, is judged by itself."""
    row = F.xxhash64("doc_id", "text")
    found = bench.contaminated(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return rows_by_id(docs, found.select("doc_id"), inside=False, key=row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

ORACLE_SQL = None  # no stage but line dedup can be said in SQL; a test compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs

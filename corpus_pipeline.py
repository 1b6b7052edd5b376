"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, line_dedup, piece_codec, quality_lm, shingle_join
from foliospark.llm._common import Scratch, checked_side, drop_ids, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an id that stands on several rows goes if all of them are rejected."""
    verdict = quality_lm.classify(docs, table(spark, sf_dir, "labels"))
    rejected = verdict.groupBy("doc_id").agg(F.max("keep").alias("keep")).where("not keep").select("doc_id")
    return drop_ids(docs, Scratch(spark, "quality-stage").write(rejected, "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks go from the later documents, and documents of which nothing is left."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once; where rows share an id or lack one, one row of the group."""
    scratch = Scratch(spark, "near-copies-stage")
    found = scratch.write(shingle_join.near_duplicates(docs), "found")
    rows = found.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if rows.rows == rows.ids:
        return drop_ids(docs, scratch.write(found.where("doc_id <> component_id").select("doc_id"), "copies"))
    row = f"_row_{uuid.uuid4().hex}"
    numbered = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so that the numbers stay
    again = shingle_join.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    copies = scratch.write(again.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "copies")
    return numbered.join(checked_side(copies), row, "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, restored, agreed, ids``: what is left, encoded."""
    return piece_codec.encode_documents(docs, piece_codec.model_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontaminate", leaks), ("pieces", pieces)]
#: SQL expresses none of the stages; ``tests/llm/test_pipeline.py`` compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs

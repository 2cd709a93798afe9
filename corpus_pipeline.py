"""From documents to a training mix: drop toxic texts, near copies and benchmark leaks, blank secrets, mix sources.

Defined results: a null or empty text is not toxic, no copy, no leak and holds no secret, so it stays, with size 0.
Rows with a null id are judged as any other; a null source is a source of its own. Of repeated rows with words one
stays, and of a group of near copies the row with the smallest id (where that id has several texts, the one of the least
hash); rows without words all stay. Empty tables are no error: without labels the fixed lists of words decide, without benchmark
items nothing leaks, without documents there are no rows. Further columns of the documents, whatever their names, go
through all stages but the last, which returns the columns of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civicspark.llm import decontaminate, mixing, near_dup, secrets, toxicity
from civicspark.llm.common import Tables, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the mix: what it takes of each document, and the shards that its copies go to."""
    mixed = mixing.mix_sources(docs)
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "taken", "copies", "draws.shard AS shards")


STAGES = [("toxicity", toxic_stage), ("near_dup", near_dup_stage), ("leaks", leak_stage), ("secrets", secret_stage), ("mixing", mix_stage)]

#: The label model, the joins on shingle sets and the alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = tables.put(out) if i < len(STAGES) - 1 else out
    return docs

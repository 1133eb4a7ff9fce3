"""The queries pN_... of the operators for training data, over whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docskein.llm import consensus, encoding, leakage, neardup, overlap, packing, pairs, tokenizer

EVALUATION = ["validation", "test"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlap.split_overlap_pairs(_table(spark, folder, "dataset"), "sample_id", "text", "split", ["train"], EVALUATION)
    return found.select(F.least("eval_id", "train_id").alias("sample_id_1"), F.greatest("eval_id", "train_id").alias("sample_id_2"))


def p1_ways(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs each way finds first: equal hashes, the same words, variants."""
    found = overlap.split_overlap_pairs(_table(spark, folder, "dataset"), "sample_id", "text", "split", ["train"], EVALUATION)
    return found.groupBy("way").agg(F.count("*").alias("pairs"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, folder, "dataset"), "sample_id", "text", "split", "source", ["train"], EVALUATION)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "dataset"), "sample_id", "text", "split", _table(spark, folder, "pack_limits"), "split", "max_chars")


def p2_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select(F.col("group").alias("split"), "sequence", "place", F.col("id").alias("sample_id"), "start", "length")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder), _table(spark, folder, "pack_limits"), "split", "max_chars").withColumnRenamed("group", "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, "evaluation_result")).select("question_id", "side", "defect")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, "evaluation_result")).groupBy("side", "defect").agg(F.count("*").alias("responses"), F.min("margin").alias("least_margin"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = consensus.estimate(consensus.usable_votes(_table(spark, folder, "evaluation_result")))
    return items.where("judges >= 3").select(F.col("item").alias("question_id"), "consensus")


def p4_questions(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = consensus.estimate(consensus.usable_votes(_table(spark, folder, "evaluation_result")))
    return items.withColumnRenamed("item", "question_id")


def p4_judges(spark: SparkSession, folder: str) -> DataFrame:
    votes = consensus.usable_votes(_table(spark, folder, "evaluation_result"))
    return consensus.reliability(consensus.estimate(votes)[1], votes)


def p4_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.chance_corrected(consensus.usable_votes(_table(spark, folder, "evaluation_result")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicate_pairs(_table(spark, folder, "combined_all_chunks"), "chunk_id", ["doc", "code_snippet"])
    return found.toDF("chunk_id_1", "chunk_id_2")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_table(spark, folder, "combined_all_chunks"), "chunk_id", ["doc", "code_snippet"])


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(_table(spark, folder, "documents"), "doc_id", "text").toDF("doc_id", "ids")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.token_report(_table(spark, folder, "documents"), "text", "source").withColumnRenamed("group", "source")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["question", "reference_context", "reference_answer"]
    return leakage.leaking_documents(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "golden_dataset"), "item_id", fields)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.restored_texts(_table(spark, folder, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.restored_texts(_table(spark, folder, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_ways, p1_report, p2_packed, p2_report, p3_found, p3_report, p4_found, p4_questions, p4_judges, p4_agreement, p5_found, p5_groups, p6_ids, p6_report, p7_found, p8_found, p8_restored)}

SQL: dict[str, str] = {}

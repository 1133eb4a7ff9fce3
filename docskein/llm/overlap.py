"""Same or near-same records across splits (problem 1).

1. Records are canonicalised by case, punctuation and white space, which leaves their words in order; evaluation hashes are joined
   with training hashes (128 bits). These are the same records.
2. Records are also hashed in parts: the variants of ballhash, over classes of records with the same set of words. Evaluation
   variants meet training variants, and what meets is verified on whole texts. These are the near-same records.

Null, empty or word-free texts are in no pair; rows of other splits, or of none, are not read; repeated rows of an id count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.ballhash import similar_texts


def _records(df: DataFrame, id_col: str, text_col: str, split_col: str, train: list[str], evaluation: list[str]) -> DataFrame:
    """id, text, side (0 for training) of the records that take part."""
    return df.where(F.col(split_col).isin(train + evaluation) & (F.length(text_col) > 0)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(F.col(split_col).isin(train), 0).otherwise(1).alias("side")
    )


def canonical_hashes(records: DataFrame) -> DataFrame:
    """id, side, h1, h2: hashes of the words of each record, in order; none for a record without words."""
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\pL\pN_]+", " "))
    return records.select("id", "side", words.alias("words")).where("words <> ''").select("id", "side", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("2"), "words").alias("h2")).distinct()


def split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: list[str], evaluation: list[str], threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records of evaluation splits and the train records they repeat, exactly or almost; see ballhash."""
    return similar_texts(_records(df, id_col, text_col, split_col, train, evaluation), "id", "text", "side", threshold=threshold)


def split_overlap_pairs(df: DataFrame, id_col: str, text_col: str, split_col: str, train: list[str], evaluation: list[str], threshold: float = 0.7) -> DataFrame:
    """eval_id, train_id, way: every overlapping pair across the sides, once, and how it was found first.

    way: 1 for equal hashes of the canonical text, 2 for the same set of words, 3 for variants that met.
    """
    hashed = canonical_hashes(_records(df, id_col, text_col, split_col, train, evaluation))
    train_hashes = hashed.where("side = 0").select("h1", "h2", F.col("id").alias("train_id"))
    same = hashed.where("side = 1").select("h1", "h2", F.col("id").alias("eval_id")).join(train_hashes, ["h1", "h2"])
    members, links = split_overlaps(df, id_col, text_col, split_col, train, evaluation, threshold)
    sides = [members.where(f"side = {s}").select("class", F.col("id").alias(name)) for s, name in ((0, "train_id"), (1, "eval_id"))]
    both = links.select("class_1", "class_2").union(links.select("class_2", "class_1"))
    near = both.join(sides[1].withColumnRenamed("class", "class_1"), "class_1").join(sides[0].withColumnRenamed("class", "class_2"), "class_2")
    ways = ((same, 1), (sides[1].join(sides[0], "class"), 2), (near, 3))
    found = None
    for pairs, way in ways:
        pairs = pairs.select("eval_id", "train_id", F.lit(way).alias("way"))
        found = pairs if found is None else found.union(pairs)
    return found.groupBy("eval_id", "train_id").agg(F.min("way").alias("way"))


def overlap_report(df: DataFrame, id_col: str, text_col: str, split_col: str, source_col: str, train: list[str], evaluation: list[str], threshold: float = 0.7) -> DataFrame:
    """For each evaluation split and source: its records, those that overlap train records, those with the same text as one, and pairs.

    Pairs are counted from the sizes of classes and never formed. An id with several texts counts the pairs of each.
    """
    hashed = canonical_hashes(_records(df, id_col, text_col, split_col, train, evaluation))
    exact = hashed.where("side = 1").join(hashed.where("side = 0").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(F.col("id").alias("eval_id")).distinct().withColumn("exact", F.lit(True))
    members, links = split_overlaps(df, id_col, text_col, split_col, train, evaluation, threshold)
    trained = members.where("side = 0").groupBy("class").agg(F.count("*").alias("trained"))
    both = links.select("class_1", "class_2").union(links.select("class_2", "class_1"))
    near = both.join(trained.withColumnRenamed("class", "class_2"), "class_2").groupBy(F.col("class_1").alias("class")).agg(F.sum("trained").alias("near"))
    counted = members.where("side = 1").join(trained, "class", "left").join(near, "class", "left").select(F.col("id").alias("eval_id"), (F.coalesce("trained", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("pairs"))
    counted = counted.groupBy("eval_id").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")
    rows = df.where(F.col(split_col).isin(evaluation)).select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return (
        rows.join(counted, "eval_id", "left")
        .join(exact, "eval_id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("records"),
            F.count("pairs").alias("overlapping"),
            F.count(F.when(F.col("exact"), 1)).alias("exact"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        )
    )

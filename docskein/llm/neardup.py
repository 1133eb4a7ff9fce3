"""Near-duplicate records with small edits (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.ballhash import similar_texts
from docskein.llm.components import connected_components


def whole_text(*columns: str):
    """Several columns as one text, null as empty."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def near_duplicate_classes(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.7, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicates; see ballhash.similar_texts for the columns and the treatment of odd rows."""
    return similar_texts(df.select(F.col(id_col).alias("id"), whole_text(*text_cols).alias("text")), "id", "text", threshold=threshold, min_words=min_words)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.7, min_words: int = 20) -> DataFrame:
    """id_1, id_2: every pair of different ids whose texts overlap, the smaller id first; copies are expanded."""
    members, links = near_duplicate_classes(df, id_col, text_cols, threshold, min_words)
    return expand(members, links)


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of ids from pairs of classes and from classes with several members."""
    x = members.select(F.col("class").alias("class_1"), F.col("id").alias("x"))
    y = members.select(F.col("class").alias("class_2"), F.col("id").alias("y"))
    across = links.select("class_1", "class_2").join(x, "class_1").join(y, "class_2").select("x", "y")
    several = members.groupBy("class").agg(F.count("*").alias("k")).where("k > 1").select("class")
    own = members.join(several, "class").select("class", "id")
    within = own.select("class", F.col("id").alias("x")).join(own.select("class", F.col("id").alias("y")), "class").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.7, min_words: int = 20) -> DataFrame:
    """A row for each id with enough words: id, group (the smallest id it is connected with), class, links.

    links counts the classes of other word sets that the id's class is linked with.
    """
    members, links = near_duplicate_classes(df, id_col, text_cols, threshold, min_words)
    found = connected_components(links, "class_1", "class_2")
    degree = links.select("class_1").union(links.select("class_2")).groupBy("class_1").agg(F.count("*").alias("links"))
    placed = (
        members.join(found.select(F.col("node").alias("class"), "root"), "class", "left")
        .join(degree.select(F.col("class_1").alias("class"), "links"), "class", "left")
        .select("id", "class", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    names = placed.groupBy("root").agg(F.min("id").alias("group"))
    return placed.join(names, "root").select("id", "group", "class", "links")

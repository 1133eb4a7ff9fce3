"""Retrieval metrics of runs against relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics_at(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """run, qid, precision, recall, mrr, ndcg, f1 of every run and judged query.

    runs: run, qid, doc_id, rank; qrels: qid, doc_id, rel. Gains are linear; a query that a run doesn't answer scores 0.
    """
    ideal = Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id")
    judged = qrels.where("rel > 0")
    need = judged.withColumn("at", F.row_number().over(ideal)).groupBy("qid").agg(F.count("*").alias("total"), F.sum(F.when(F.col("at") <= k, F.col("rel") / F.log2(F.col("at") + 1.0)).otherwise(0.0)).alias("idcg"))
    hit = runs.where(F.col("rank") <= k).join(judged, ["qid", "doc_id"])
    got = hit.groupBy("run", "qid").agg(F.count("*").alias("hits"), F.max(1.0 / F.col("rank")).alias("mrr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    every = runs.select("run").distinct().crossJoin(need)  # a handful of run names
    p, r = F.coalesce("hits", F.lit(0)) / k, F.coalesce("hits", F.lit(0)) / F.col("total")
    return every.join(got, ["run", "qid"], "left").select(
        "run", "qid", p.alias("precision"), r.alias("recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
    )


def compare_runs(metrics: DataFrame) -> DataFrame:
    """Means of each run, the overall mean of the four headline metrics, and the rank by it."""
    names = ("precision", "recall", "mrr", "ndcg", "f1")
    means = metrics.groupBy("run").agg(*[F.round(F.avg(m), 6).alias(m) for m in names])
    overall = F.round(0.25 * (F.col("precision") + F.col("recall") + F.col("mrr") + F.col("ndcg")), 6)
    return means.withColumn("overall", overall).withColumn("place", F.rank().over(Window.orderBy(F.col("overall").desc(), "run")))


def run_category(name: Column) -> Column:
    """The kind of system from its name, first rule first."""
    n = F.lower(name)
    return F.when(n.contains("rrf") | n.contains("hybrid"), "fusion").when(n.contains("bm25"), "sparse").when(n.contains("colbert") | n.contains("maxsim"), "late interaction").otherwise("dense")


def unpivot_metrics(table: DataFrame, metrics: list[str]) -> DataFrame:
    """run, metric, value in long form."""
    return table.unpivot(["run"], metrics, "metric", "value")

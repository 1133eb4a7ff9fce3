"""Joining, scoring and summarising answers: merges, statistics, balance, samples, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.session import stage


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row of each key: the one delivered last. A group-by with partial results, not a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(time), F.to_timestamp(F.lit("1970-01-01")))).alias("x")).select(key, "x.*")


def merge_answers(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """Golden questions with the answer to the same trimmed question; the last answer wins, and a missing one leaves nulls and 0.

    golden: item_id, question, reference_answer, question_type; answers: question, answer, at, n_chunks.
    """
    order = ["at", "answer", "n_chunks"]
    last = answers.where(~tx.blank("question")).groupBy(F.trim("question").alias("key")).agg(F.max(F.struct(*order)).alias("x"))
    joined = golden.join(last, F.trim(golden["question"]) == F.col("key"), "left")
    return joined.select("item_id", "question", "reference_answer", F.initcap("question_type").alias("question_type"), F.col("x.answer").alias("answer"), F.coalesce("x.n_chunks", F.lit(0)).alias("n_chunks"))


def valid_rows(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose required fields are not blank."""
    return df.where(~F.exists(F.array(*[tx.blank(c) for c in required]), lambda x: x))


def validation_report(df: DataFrame, required: list[str]) -> DataFrame:
    """field, rows, missing, blank: one row for each required field, in one pass."""
    aggs = []
    for c in required:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}"), F.count(F.when(F.col(c).isNotNull() & tx.blank(c), 1)).alias(f"blank_{c}")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("field"), F.col("rows"), F.col(f"missing_{c}").alias("missing"), F.col(f"blank_{c}").alias("blank")) for c in required])
    return one.select(F.explode(parts).alias("x")).select("x.*")


def statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (population), least, greatest and median of a value in each group; null values don't count."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.round(F.avg(v) + 1e-9, 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.round(F.median(v) + 1e-9, 4).alias("median")
    )


def row_results(cells: DataFrame, key: list[str], falling: tuple[str, ...] = ("hallucination",)) -> DataFrame:
    """keys, valid, mean, passed: for each row of metric cells the valid ones, their mean, and how many pass their threshold.

    cells: keys, metric, score, threshold. A cell passes with a score of at least its threshold; those of falling metrics with
    at most that. Cells without a score are dropped; rows without any have valid 0 and a null mean.
    """
    low = F.exists(F.array(*map(F.lit, falling)), lambda m: F.contains(F.lower("metric"), m))
    ok = F.when(low, F.col("score") <= F.col("threshold")).otherwise(F.col("score") >= F.col("threshold"))
    return cells.groupBy(*key).agg(F.count("score").alias("valid"), F.round(F.avg("score") + 1e-9, 4).alias("mean"), F.count(F.when(ok, 1)).alias("passed"))


def focus_report(cells: DataFrame, focus: str, target: float) -> DataFrame:
    """One row: mean of all cells, mean of the focus metric, its distance to a target and whether that is met."""
    one = cells.agg(F.round(F.avg("score") + 1e-9, 4).alias("overall"), F.round(F.avg(F.when(F.col("metric") == focus, F.col("score"))) + 1e-9, 4).alias("focus"))
    return one.select("overall", "focus", F.round(F.col("focus") - target, 4).alias("above"), (F.col("focus") >= target).alias("met"))


def rubric_summary(cells: DataFrame) -> DataFrame:
    """metric, n, mean, std, least, greatest, yes_rate. cells: metric, score, verdict; verdicts that aren't yes or no don't count in the rate."""
    verdict = F.lower(F.trim("verdict"))
    yes, known = F.count(F.when(verdict == "yes", 1)), F.count(F.when(verdict.isin("yes", "no"), 1))
    return cells.groupBy("metric").agg(
        F.count("score").alias("n"), F.round(F.avg("score") + 1e-9, 4).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"), F.min("score").alias("least"), F.max("score").alias("greatest"),
        F.round(F.when(known > 0, yes / known) + 1e-9, 4).alias("yes_rate"),
    )


def best_models(means: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, model, value: the best model of each metric; of equal ones the first by name. means: model and a column for each metric."""
    long = means.unpivot(["model"], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.min_by("model", F.struct((-F.col("value")).alias("v"), "model")).alias("model"), F.max("value").alias("value"))


def field_inventory(fields: DataFrame) -> DataFrame:
    """field, in_first, in_second, where: which fields two sides have. fields: side (first or second), field."""
    each = fields.groupBy("field").agg(F.count(F.when(F.col("side") == "first", 1)).alias("in_first"), F.count(F.when(F.col("side") == "second", 1)).alias("in_second"))
    return each.withColumn("where", F.when((F.col("in_first") > 0) & (F.col("in_second") > 0), "common").when(F.col("in_first") > 0, "first only").otherwise("second only"))


def component_statistics(cells: DataFrame) -> DataFrame:
    """Mean and count of scores by component and metric, and by question type too, in one pass with grouping sets."""
    return cells.groupingSets([["component", "metric"], ["question_type", "component", "metric"]], "question_type", "component", "metric").agg(
        F.grouping("question_type").cast("int").alias("all_types"), F.count("score").alias("n"), F.round(F.avg("score") + 1e-9, 4).alias("mean")
    )


def comparison_table(cells: DataFrame, models: list[str]) -> DataFrame:
    """A row for each metric with mean and standard deviation of each model."""
    return cells.groupBy("metric").pivot("model", models).agg(F.round(F.avg("score") + 1e-9, 4).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"))


def balance(df: DataFrame, by: str) -> DataFrame:
    """One row: kinds, least and greatest count, their ratio, total, and the total of a sample of three of each kind."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("kinds"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(F.min("n") / F.max("n"), 4).alias("balance"), F.sum("n").alias("total"), F.sum(F.least("n", F.lit(3))).alias("three_each")
    )


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each stratum (all if fewer), in the order of a hash, so that the choice can be repeated."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("place") <= n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))  # the total is one row


def hash_split(df: DataFrame, key: str, percent: int, seed: str = "42") -> DataFrame:
    """part: train or test by a hash of the key, so that a row keeps its part when others come."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 6), 16, 10).cast("int") % 100
    return df.withColumn("part", F.when(bucket < percent, "test").otherwise("train"))


def usage_summary(calls: DataFrame) -> DataFrame:
    """Calls, tokens, errors, error rate and mean latency of each model, and over all. calls: model, tokens_in, tokens_out, error, latency."""
    return calls.rollup("model").agg(
        F.grouping("model").cast("int").alias("all_models"), F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.count(F.when(F.col("error"), 1)).alias("errors"), F.round(F.avg(F.col("error").cast("int")) + 1e-9, 4).alias("error_rate"), F.round(F.avg("latency") + 1e-9, 4).alias("mean_latency"),
    )


def timer_summary(times: DataFrame) -> DataFrame:
    """Count, total, mean, least, greatest and last value of each timer. times: name, seconds, at, seq."""
    last = F.max_by("seconds", F.struct("at", "seq"))
    return times.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("total"), F.round(F.avg("seconds") + 1e-9, 4).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("greatest"), last.alias("last"))


def window_load(times: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Calls of each tumbling window and name, and by how many they exceed the limit."""
    counts = times.groupBy("name", F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("calls"))
    return counts.select("name", F.col("w.start").alias("start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("over"))


def error_runs(events: DataFrame) -> DataFrame:
    """Runs of consecutive errors of each user (gaps and islands): user_id, started, length. events: user_id, at, seq, error."""
    order = Window.partitionBy("user_id").orderBy("at", "seq")
    island = F.sum((~F.col("error")).cast("int")).over(order)
    return events.withColumn("island", island).where("error").groupBy("user_id", "island").agg(F.min("at").alias("started"), F.count("*").alias("length")).drop("island")


def cache_rate(requests: DataFrame, key: list[str]) -> DataFrame:
    """Requests, distinct ones, and the share that an unbounded cache would have answered."""
    each = requests.groupBy(*key).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("requests"), F.count("*").alias("distinct"), F.round(1 - F.count("*") / F.sum("n"), 4).alias("hit_rate"))


def last_known(metrics: DataFrame) -> DataFrame:
    """step, name, value: the latest value that is not null of each step and metric. metrics: step, name, at, seq, value."""
    return metrics.where("value IS NOT NULL").groupBy("step", "name").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def quality_band(score: Column) -> Column:
    return F.when(score >= 4.5, "excellent").when(score >= 3.5, "good").when(score >= 2.5, "fair").when(score >= 1.5, "poor").otherwise("very poor")


def upsert(existing: DataFrame, new: DataFrame, key: str, time: str) -> DataFrame:
    """Rows of both by key, the later one where both have it."""
    return latest(existing.unionByName(new), key, time)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of a unique column: places within ranges, and one running sum over the ranges."""
    ranged = df.repartitionByRange(order).withColumn("range_", F.spark_partition_id())
    ranged = stage(ranged, "ranged")  # ranges are drawn once, so that both reads see the same
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy("range_").orderBy(order))
    return ranged.withColumn("place_", place).join(F.broadcast(before), "range_").withColumn(name, F.col("before_") + F.col("place_")).drop("range_", "place_", "before_")


def missing_keys(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do after an interruption."""
    return wanted.join(done.select(key), key, "left_anti")

"""Statistics of pairwise judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assignments(questions: DataFrame, judges: list[str], rounds: int) -> DataFrame:
    """question_id, judge, round, a_is: every question with every judge and round; the sides change places each round."""
    every = questions.select("question_id", F.explode(F.array(*map(F.lit, judges))).alias("judge"))
    return every.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("a_is", F.when(F.col("round") % 2 == 0, "open_source").otherwise("closed_source"))


def _rates() -> list:
    side = lambda x: F.count(F.when(F.col("winner") == x, 1))
    out = [F.count("*").alias("judgements"), F.count_distinct("question_id").alias("questions")]
    for x, name in (("open_source", "open"), ("closed_source", "closed"), ("tie", "tie")):
        out += [side(x).alias(f"{name}_wins"), F.round(side(x) / F.count("*") + 1e-9, 4).alias(f"{name}_rate")]
    return [*out, F.round(F.avg("confidence") + 1e-9, 4).alias("confidence")]


def win_rates(judged: DataFrame, *by: str) -> DataFrame:
    """Wins, ties, rates and mean confidence, overall or by columns. judged: question_id, judge, question_type, winner, confidence."""
    return judged.groupBy(*by).agg(*_rates()) if by else judged.agg(*_rates())


def win_cube(judged: DataFrame) -> DataFrame:
    """The same for all four combinations of question type and judge at once."""
    return judged.cube("question_type", "judge").agg(F.grouping_id().cast("int").alias("level"), *_rates())


def type_judge_matrix(judged: DataFrame) -> DataFrame:
    """question_type, judge, winner by counts (tie where both have as many)."""
    n = lambda x: F.count(F.when(F.col("winner") == x, 1))
    o, c, t = n("open_source"), n("closed_source"), n("tie")
    return judged.groupBy("question_type", "judge").agg(o.alias("open_wins"), c.alias("closed_wins"), t.alias("ties"), F.when((o > c) & (o > t), "open_source").when((c > o) & (c > t), "closed_source").otherwise("tie").alias("leader"))


def confidence_bands(judged: DataFrame) -> DataFrame:
    """winner, and its judgements with high (> 0.8), middle (0.6 to 0.8) and low confidence, and the mean."""
    c = F.col("confidence")
    return judged.groupBy("winner").agg(
        F.count(F.when(c > 0.8, 1)).alias("high"), F.count(F.when((c >= 0.6) & (c <= 0.8), 1)).alias("middle"), F.count(F.when(c < 0.6, 1)).alias("low"), F.round(F.avg(c) + 1e-9, 4).alias("mean")
    )


def verdict(judged: DataFrame) -> DataFrame:
    """One row: both rates, the gap and what it means, and the most confident judge."""
    total = judged.agg(F.avg((F.col("winner") == "open_source").cast("int")).alias("open"), F.avg((F.col("winner") == "closed_source").cast("int")).alias("closed"))
    by_judge = judged.groupBy("judge").agg(F.round(F.avg("confidence") + 1e-9, 6).alias("c")).agg(F.max_by("judge", F.struct("c", "judge")).alias("most_confident"))
    gap = F.abs(F.col("open") - F.col("closed"))
    return total.join(F.broadcast(by_judge)).select(F.round("open", 4).alias("open_rate"), F.round("closed", 4).alias("closed_rate"), F.round(gap, 4).alias("gap"), F.when(gap > 0.15, "clear").when(gap > 0.05, "slight").otherwise("none").alias("difference"), "most_confident")


def score_columns(judged: DataFrame) -> DataFrame:
    """evaluation_id, mean_a, mean_b, difference, high_confidence from the score maps."""
    mean = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x) / F.size(m)
    a, b = mean("scores_a"), mean("scores_b")
    return judged.select("evaluation_id", F.round(a, 4).alias("mean_a"), F.round(b, 4).alias("mean_b"), F.round(a - b, 4).alias("difference"), (F.col("confidence") > 0.8).alias("high_confidence"))


def position_bias(judged: DataFrame) -> DataFrame:
    """judge, judgements that aren't ties, and the share that chose the first position. judged: judge, choice (A, B or tie)."""
    return judged.where("choice IN ('A', 'B')").groupBy("judge").agg(F.count("*").alias("judgements"), F.round(F.avg((F.col("choice") == "A").cast("int")) + 1e-9, 4).alias("first_share"))

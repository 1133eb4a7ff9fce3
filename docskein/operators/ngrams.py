"""Clipped n-gram scores and greedy selection of dissimilar texts, as joins and group-bys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import text as tx
from docskein.session import release, stage


def ngram_counts(df: DataFrame, key: str, reference: str, candidate: str, longest: int = 4) -> DataFrame:
    """key, n, clipped, candidates, references: n-grams of the words of two texts, and how many they share, each at most as often as in either.

    Counted by a group-by over n-grams with partial sums. A key whose texts have no n-gram of a length has no row for it; repeated
    keys are one text; null texts have no words.
    """
    sides = []
    for name, column in (("r", reference), ("c", candidate)):
        words = df.select(F.col(key).alias("key"), tx.words(column).alias("w"))
        for n in range(1, longest + 1):
            sides.append(words.select("key", F.lit(n).alias("n"), F.explode(tx.ngrams(F.col("w"), n)).alias("gram"), F.lit(int(name == "r")).alias("r"), F.lit(int(name == "c")).alias("c")))
    both = reduce(DataFrame.unionAll, sides).groupBy("key", "n", "gram").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return both.groupBy("key", "n").agg(F.sum(F.least("r", "c")).alias("clipped"), F.sum("c").alias("candidates"), F.sum("r").alias("references"))


def clipped_scores(df: DataFrame, key: str, reference: str, candidate: str, epsilon: float = 0.1) -> DataFrame:
    """key, bleu_1, bleu_2, bleu_4, rouge_1, rouge_2: clipped n-gram precision with the penalty for brevity, and F measures of n-grams.

    An n-gram length without a match counts epsilon matches; without any n-gram of a length the score is 0.
    """
    counts = ngram_counts(df, key, reference, candidate)
    at = lambda n, c: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0))
    wide = counts.groupBy("key").agg(*[at(n, c).alias(f"{c}{n}") for n in (1, 2, 3, 4) for c in ("clipped", "candidates", "references")])
    precision = lambda n: F.when(F.col(f"clipped{n}") == 0, epsilon).otherwise(F.col(f"clipped{n}")) / F.col(f"candidates{n}")
    brevity = F.when(F.col("candidates1") >= F.col("references1"), 1.0).otherwise(F.exp(1 - F.col("references1") / F.col("candidates1")))

    def bleu(longest: int) -> Column:
        mean = reduce(Column.__add__, [F.log(precision(n)) for n in range(1, longest + 1)]) / longest
        return F.when((F.col(f"candidates{longest}") == 0) | (F.col("clipped1") == 0), 0.0).otherwise(F.round(brevity * F.exp(mean), 6))

    def rouge(n: int) -> Column:
        return F.round(tx.f1(tx.ratio(F.col(f"clipped{n}"), F.col(f"candidates{n}")), tx.ratio(F.col(f"clipped{n}"), F.col(f"references{n}"))), 6)

    scored = wide.select("key", *[bleu(n).alias(f"bleu_{n}") for n in (1, 2, 4)], *[rouge(n).alias(f"rouge_{n}") for n in (1, 2)])
    names = scored.columns[1:]
    return df.select(F.col(key).alias("key")).distinct().join(scored, "key", "left").select(F.col("key").alias(key), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def similar_word_sets(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """a, b (a < b): keys whose texts have a word overlap of at least threshold, by a join on the rare words each must share.

    A text of n words shares one of its n - ceil(threshold * n) + 1 rarest with any text that similar, so only these are joined.
    Keys are unique; texts without words are similar to none.
    """
    words = df.select(F.col(key).alias("key"), tx.terms(text).alias("w")).where(F.size("w") > 0)
    flat = words.select("key", F.size("w").alias("n"), F.explode("w").alias("word"))
    counts = flat.groupBy("word").agg(F.count("*").alias("df"))
    ordered = flat.join(counts, "word").groupBy("key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("w"))
    ordered = stage(ordered, "words")
    prefix = ordered.select("key", "n", F.explode(F.slice("w", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))).alias("word"))
    x, y = (prefix.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), "word") for k in ("a", "b"))
    met = x.join(y, "word").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = ordered.select("key", "w")
    both = met.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= threshold * (F.size("wa") + F.size("wb") - shared) - 1e-9).select("a", "b")


def accepted_in_order(df: DataFrame, key: str, text: str, threshold: float = 0.7) -> DataFrame:
    """key, accepted: texts taken in the order of their keys, each only if it isn't similar to one taken before.

    The greedy choice by rounds: a text is taken once all its earlier similar ones are refused, and refused once one of them is
    taken. Each round decides at least the first undecided text of each group of similar ones; most need two or three.
    """
    pairs = stage(similar_word_sets(df, key, text, threshold), "similar")
    state = stage(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().withColumn("taken", F.lit(None).cast("boolean")), "state")
    while state.where("taken IS NULL").limit(1).count():
        earlier = pairs.join(state.toDF("a", "before"), "a").groupBy(F.col("b").alias("key")).agg(F.bool_or(F.coalesce("before", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("before"), F.lit(False))).alias("clear"))
        joined = state.join(earlier, "key", "left")
        decided = F.coalesce(F.col("taken"), F.when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("clear", F.lit(True)), True))
        before, state = state, stage(joined.select("key", decided.alias("taken")), "state")
        release(before)
    return df.select(F.col(key).alias("key")).join(state, "key", "left").select(F.col("key").alias(key), F.coalesce("taken", F.lit(True)).alias("accepted"))

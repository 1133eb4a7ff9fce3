"""Places for models: scorers, encoders and judges in Arrow batches, with defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scorer(score: Callable[[list[str], list[str]], list[float]]):
    """A column function (query, text) -> double from a function on batches, such as a cross-encoder."""

    @F.pandas_udf(T.DoubleType())
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(score(query.fillna("").tolist(), text.fillna("").tolist()), dtype="float64")

    return run


def encoder(encode: Callable[[list[str]], list[list[float]]], prefix: str = ""):
    """A column function text -> vector from a function on batches; prefix goes before each text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(encode([prefix + t for t in text.fillna("")]))

    return run


def judge(ask: Callable[[list[str]], list[str]]):
    """A column function prompt -> answer from a function on batches, such as calls of a judging model."""

    @F.pandas_udf(T.StringType())
    def run(prompt: pd.Series) -> pd.Series:
        return pd.Series(ask(prompt.fillna("").tolist()), dtype="object")

    return run


def splitter(points: Callable[[list[str]], list[list[int]]]):
    """A column function text -> split points from a function on batches; see chunking.split_at for their use."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(points(text.fillna("").tolist()))

    return run


def pair_text(title: Column, content: Column, code: Column) -> Column:
    """What a reranker reads of a hit."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Content: "), F.substring(F.coalesce(content, F.lit("")), 1, 2000)), F.concat(F.lit("Code: "), F.substring(F.coalesce(code, F.lit("")), 1, 1500)))


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """F measure of the longest common subsequence of words; 0 if one is empty."""

    def one(a: str, b: str) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        if not x or not y:
            return 0.0
        # bit-parallel longest common subsequence: one machine word per 2^n words of x, in Python's long integers
        places: dict[str, int] = {}
        for i, w in enumerate(x):
            places[w] = places.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for w in y:
            u = row & places.get(w, 0)
            row = ((row + u) | (row - u)) & full
        common = len(x) - bin(row).count("1")
        p, r = common / len(y), common / len(x)
        return 2 * p * r / (p + r) if p + r else 0.0

    return pd.Series([one(a, b) for a, b in zip(reference, candidate)], dtype="float64")

"""Evaluation: precision, recall and F1 of tokens, longest common subsequence, edit distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rates(hit: Column, predicted: Column, actual: Column) -> list[Column]:
    p = F.when(predicted > 0, hit / predicted).otherwise(0.0)
    r = F.when(actual > 0, hit / actual).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def prf_sets(predicted: Column, actual: Column) -> Column:
    """struct(precision, recall, f1) of the sets of two token arrays."""
    a, b = F.array_distinct(predicted), F.array_distinct(actual)
    return F.struct(*_rates(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)))


def prf_multisets(rows: DataFrame, key: str, predicted: str, actual: str) -> DataFrame:
    """key, precision, recall, f1 with each token counted as often as it occurs; relational."""
    side = lambda name, n: rows.select(key, F.explode(name).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias(n))
    hit = side(predicted, "p").join(side(actual, "a"), [key, "token"], "full").fillna(0, ["p", "a"])
    sums = hit.groupBy(key).agg(F.sum(F.least("p", "a")).alias("h"), F.sum("p").alias("p"), F.sum("a").alias("a"))
    return sums.select(key, *_rates(F.col("h"), F.col("p"), F.col("a")))


def _table(x, y) -> np.ndarray:
    """Lengths of the common subsequences of all prefixes, a row at a time."""
    x, y = list(x), list(y)
    codes = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    right = np.array([codes[t] for t in y], np.int64)
    out = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, t in enumerate(x):
        out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], np.where(right == codes[t], out[i, :-1] + 1, 0)))
    return out


def _diff(x, y) -> list[tuple[str, str]]:
    x, y = list(x), list(y)
    lengths, i, j, out = _table(x, y), len(x), len(y), []
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            out.append((" ", x[i - 1]))
            i, j = i - 1, j - 1
        elif j and (not i or lengths[i, j - 1] >= lengths[i - 1, j]):
            out.append(("+", y[j - 1]))
            j -= 1
        else:
            out.append(("-", x[i - 1]))
            i -= 1
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def lcs_inclusion(x: pd.Series, y: pd.Series) -> pd.Series:
    """For each token of x whether it is in the longest common subsequence of x and y."""
    return pd.Series([None if a is None or b is None else [s == " " for s, _ in _diff(a, b) if s != "+"] for a, b in zip(x, y, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def lcs_diff(x: pd.Series, y: pd.Series) -> pd.Series:
    """Lines ' token', '+ token' and '- token' from x to y."""
    return pd.Series([None if a is None or b is None else [f"{s} {t}" for s, t in _diff(a, b)] for a, b in zip(x, y, strict=True)])


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(x: pd.Series, y: pd.Series) -> pd.Series:
    """Edits, swaps of neighbours included, from x to y (strings or arrays)."""

    def one(a, b) -> int | None:
        if a is None or b is None:
            return None
        before, last = None, list(range(len(b) + 1))
        for i in range(len(a)):
            row = [i + 1]
            for j in range(len(b)):
                best = min(last[j + 1] + 1, row[j] + 1, last[j] + (a[i] != b[j]))
                if before is not None and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    best = min(best, before[j - 1] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    return pd.Series([one(a, b) for a, b in zip(x, y, strict=True)], dtype="Int32")

"""chrF: character n-gram F score (S-33, A-33). Spark has none; an Arrow UDF by the published definition."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER, BETA = 6, 2.0


def _grams(text: str, n: int) -> Counter:
    return Counter(text[i : i + n] for i in range(len(text) - n + 1))


def profile(text: str | None) -> list[Counter]:
    """The n-grams of each order, white space removed; found once for all comparisons of a text."""
    bare = "".join((text or "").split())
    return [_grams(bare, n) for n in range(1, ORDER + 1)]


def both_scores(first: list[Counter], second: list[Counter]) -> tuple[float, float]:
    """chrF of two profiles in both directions, which share their matches."""
    precision = recall = 0.0
    orders = 0
    for a, b in zip(first, second, strict=True):
        if a and b:
            few, many = (a, b) if len(a) <= len(b) else (b, a)
            get = many.get
            same = sum([min(n, get(g, 0)) for g, n in few.items()])
            precision += same / a.total()
            recall += same / b.total()
            orders += 1
    if not orders or not precision + recall:
        return 0.0, 0.0
    p, q = precision / orders, recall / orders
    return (1 + BETA**2) * p * q / (BETA**2 * p + q), (1 + BETA**2) * q * p / (BETA**2 * q + p)


def chrf_score(hypothesis: str | None, reference: str | None) -> float:
    """In [0, 1]; white space removed, mean of precision and recall over the orders both sides have."""
    return both_scores(profile(hypothesis), profile(reference))[0]


_PAIR = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("forward", T.DoubleType()), T.StructField("backward", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_PAIR))
def chrf_within(texts: pd.Series) -> pd.Series:
    """chrF in both directions of all pairs i < j of an array of texts; a text's n-grams are found once."""

    def pairs(listed) -> list[dict]:
        known = [profile(t) for t in listed]
        return [{"i": i, "j": j, **dict(zip(("forward", "backward"), both_scores(known[i], known[j]), strict=True))} for i in range(len(known)) for j in range(i + 1, len(known))]

    return pd.Series([pairs(listed) if listed is not None else None for listed in texts])


@F.pandas_udf(T.DoubleType())
def chrf(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([chrf_score(h, r) for h, r in zip(hypotheses, references, strict=True)])


@F.pandas_udf(T.DoubleType())
def best_chrf(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
    """A-33: the best over an array of references; null if there is none."""
    return pd.Series([max((chrf_score(h, r) for r in rs), default=None) if rs is not None else None for h, rs in zip(hypotheses, references, strict=True)], dtype="float64")

"""Scores, normalisations and affinities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ranked(df, by: list[str], order: list[Column], k: int | None = None, name: str = "rank"):
    """df with its row number in each group, from 1, and only the first k."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if k is None else out.filter(F.col(name) <= k)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.coalesce(F.try_divide(dl, avgdl), F.lit(0.0))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def minmax(x: Column, by: list[str]) -> Column:
    """x on 0 to 1 within its group; a constant group is 1, and non-finite values 0."""
    w = Window.partitionBy(*by)
    good = F.when(finite(x), x)
    lo, hi = F.min(good).over(w), F.max(good).over(w)
    return F.when(x.isNull(), None).when(~finite(x), 0.0).when(hi == lo, 1.0).otherwise(F.try_divide(x - lo, hi - lo))


def rrf(ranks: list[Column], k: float) -> Column:
    """Reciprocal ranks of the channels that hold the item, summed."""
    terms = [F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks]
    return sum(terms[1:], terms[0])


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life) if half_life > 0 else F.lit(1.0)


def price_affinity(price: Column, mean_log: Column, sigma: float = 0.5) -> Column:
    p = price.cast("double")
    return F.when((p > 0) & mean_log.isNotNull(), F.exp(-F.abs(F.ln(p) - mean_log) / max(sigma, 0.1))).otherwise(0.0)


def gain(grade: Column, rank: Column) -> Column:
    """A grade's part of a discounted cumulative gain."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

"""Tokens, weighted item texts and n-gram features as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might can shall not no nor so if then than that this these those it its as into up out about over under also "
    "very just each all both few more most other some such only own same too well rather between during before after above below"
).split()
FIELD_WEIGHTS = {"title": 3, "description": 1, "category": 2, "subcategory": 2, "brand": 2}


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for; plain ASCII goes through untouched."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tokenize(text: Column, remove_stopwords: bool = True, normalise: bool = True) -> Column:
    """Lower-case runs of a-z and 0-9 in order, repeats kept, stop words dropped; null gives an empty list.

    normalise=False leaves out NFKC and with it the only Python in the plan.
    """
    lowered = F.lower(nfkc(text) if normalise else text)
    tokens = F.coalesce(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS)) if remove_stopwords else tokens


def item_text(weights: dict[str, int] | None = None) -> Column:
    """Non-empty fields, each repeated by its weight, joined by spaces in the weights' order."""
    parts = [F.array_repeat(F.nullif(F.col(name), F.lit("")), w) for name, w in (weights or FIELD_WEIGHTS).items() if w > 0]
    return F.array_join(F.flatten(F.array(*parts)), " ")


def words_of(text: Column, pattern: str) -> Column:
    """Lower-case words of a pattern in order; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def word_ngrams(text: Column, lo: int = 1, hi: int = 2, pattern: str = r"(?U)\b\w\w+\b") -> Column:
    """Word n-grams of lo to hi words, joined by spaces."""
    words, grams = words_of(text, pattern), []
    for n in range(lo, hi + 1):
        # shifted copies of the list, joined place by place: each is cut once a row
        size = F.greatest(F.size(words) - n + 1, F.lit(0))
        gram = F.slice(words, F.lit(1), size)
        for k in range(1, n):
            gram = F.zip_with(gram, F.slice(words, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
        grams.append(gram)
    return F.flatten(F.array(*grams))


def char_ngrams(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams within words, each padded by a space on either side; a word no longer than n gives one and no longer ones."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def cut(padded: Column, n: int):
        return lambda i: F.substr(padded, i, F.lit(n))  # one argument: a second would be the index

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        parts = []
        for n in range(lo, hi + 1):
            full = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), cut(padded, n))
            fits = (size > n - 1) if n > lo else F.lit(True)
            parts.append(F.when(fits, full).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts))

    return F.coalesce(F.flatten(F.transform(words, of_word)), F.array().cast("array<string>"))

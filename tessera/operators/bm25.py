"""Okapi BM25: the index as tables, all queries answered at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import bm25, idf, ranked
from ..functions.text import tokenize
from ..storage import stored
from .tfidf import dealt, spread


def term_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, item_id, dl, tf) of an array column of tokens.

    Texts are dealt out by item before they are cut, so terms are counted where their text is: what moves are texts, once, and no postings.
    """
    cut = dealt(docs.select("item_id", "text")).select("item_id", tokens.alias("tokens"))
    return cut.select("item_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "item_id", "dl").agg(F.count("*").alias("tf"))


def term_rows(docs: DataFrame, tokens: Column) -> DataFrame:
    """term_counts() of rows whose ids are a key, as a rule: terms are sorted and counted within their row, so no text moves unless a few large splits hold all."""
    if not docs.groupBy("item_id").count().filter("count > 1").isEmpty():
        return term_counts(docs, tokens)
    cut = spread(docs.select("item_id", "text")).select("item_id", F.array_sort(tokens).alias("tokens")).withColumn("dl", F.size("tokens").cast("long")).filter("dl > 0")
    heads = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: (i == 1) | (F.element_at("tokens", i) != F.element_at("tokens", F.greatest(i - 1, F.lit(1)))))
    runs = cut.withColumn("heads", heads).withColumn("next", F.concat(F.slice("heads", 2, F.size("heads")), F.array(F.size("tokens") + 1)))
    each = F.zip_with("heads", "next", lambda i, k: F.struct(F.element_at("tokens", i).alias("term"), (k - i).cast("long").alias("tf")))
    return runs.select("item_id", "dl", F.inline(each)).select("term", "item_id", "dl", "tf")


@dataclass
class BM25Index:
    """postings (term, item_id, tf, dl), terms (term, df), stats (n, avgdl; one row). stop_words drops such from texts and queries."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = 1.5
    b: float = 0.75
    normalise: bool = True
    stop_words: bool = True

    @classmethod
    def build(cls, docs: DataFrame, k1: float = 1.5, b: float = 0.75, normalise: bool = True, stop_words: bool = True) -> BM25Index:
        """From (item_id, text), or (item_id, tokens) of texts cut already. Empty documents count in the mean length."""
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be above 0, and b in 0 to 1")
        tokens = F.coalesce(F.col("tokens"), F.array().cast("array<string>")) if "tokens" in docs.columns else tokenize(F.col("text"), stop_words, normalise)
        cut = docs.select("item_id", tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
        postings = cut.select("item_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "item_id", "dl").agg(F.count("*").alias("tf"))
        terms = postings.groupBy("term").agg(F.count("*").alias("df"))
        return cls(postings, terms, cut.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), k1, b, normalise, stop_words)

    def search(self, queries: DataFrame, top_k: int = 10, digits: int | None = None) -> DataFrame:
        """(query_id, item_id, score, rank) of (query_id, query_text). A query's repeated terms count each time.

        Query terms are counted first, so the postings of a frequent term are read once a query. digits rounds scores before they rank.
        """
        if top_k <= 0:
            raise ValueError("top_k must be above 0")
        asked = queries.select("query_id", F.explode(tokenize(F.col("query_text"), self.stop_words, self.normalise)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        # stored, so that its size is known: a small batch of queries goes to the postings, not these to it
        known = stored(asked.join(self.terms, "term").crossJoin(F.broadcast(self.stats)), "asked")  # one row
        hits = known.join(self.postings, "term")
        term = bm25(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), self.k1, self.b)
        score = F.sum(F.col("qtf") * term)
        scored = hits.groupBy("query_id", "item_id").agg((F.round(score, digits) if digits else score).alias("score"))
        return ranked(scored, ["query_id"], [F.desc("score"), F.asc("item_id")], top_k)

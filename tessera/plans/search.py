"""Search, evaluation and impact as plans over many queries at once, and the index lifecycle."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BM25Config, FusionConfig, PersonalizationConfig, SemanticConfig
from ..functions.text import item_text
from ..operators.bm25 import BM25Index
from ..operators.fusion import candidates, fuse_linear, fuse_rrf
from ..operators.metrics import evaluate, macro_average, overlap, rank_shifts
from ..operators.rerank import rerank
from ..operators.semantic import SemanticIndex
from ..operators.tfidf import TfidfIndex
from .indices import IndexConfig, IndexStore

MODES = ("bm25", "semantic", "rrf", "linear")


def pool_size(top_k: int, n_items: int) -> int:
    """Candidates that a channel gives: five times what is asked and 50 at least, as far as there are items."""
    return min(max(5 * top_k, 50), n_items)


def pool_of(top_k: Column, n_items: Column) -> Column:
    """pool_size of columns."""
    return F.least(F.greatest(5 * top_k, F.lit(50)), n_items)


@dataclass(frozen=True)
class Snapshot:
    """A generation of items and indices; searches keep the one they began with."""

    items: DataFrame
    bm25: BM25Index
    semantic: SemanticIndex | TfidfIndex | None
    n_items: int
    generation: int = 1

    @classmethod
    def build(cls, items: DataFrame, bm25: BM25Config | None = None, semantic: SemanticConfig | None = None, store: IndexStore | None = None, name: str = "items", words_only: bool = False) -> Snapshot:
        """Indices of items (item_id and the text fields), in a store if one is given: there both are of one generation, made or refreshed only if the items' files changed.

        words_only leaves the semantic index out; such a snapshot serves mode bm25.
        """
        bm25, semantic = (bm25 or BM25Config()).validate(), (semantic or SemanticConfig()).validate()
        docs = items.select("item_id", item_text(bm25.field_weights).alias("text"))
        if store:
            g = store.open(name, docs, IndexConfig(stop_words=bm25.use_stopwords, semantic=None if words_only else semantic))
            return cls(items, g.bm25(bm25.k1, bm25.b), None if words_only else g.semantic(), g.n_items, g.number)
        docs = docs.cache()
        n = docs.count()
        if not n:
            raise ValueError("no items")
        return cls(items, BM25Index.build(docs, bm25.k1, bm25.b, stop_words=bm25.use_stopwords), None if words_only else SemanticIndex.build(docs, semantic), n)

    def rebuilt(self, items: DataFrame, **configs) -> Snapshot:
        """The next generation; if building fails this one is untouched."""
        new = type(self).build(items, **configs)
        return new if configs.get("store") else replace(new, generation=self.generation + 1)


def check_request(top_k: int, mode: str, personalize: bool, columns: list[str]) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be 1 to 100")
    if personalize and "user_id" not in columns:
        raise ValueError("personalised search needs user_id")


def fused(snapshot: Snapshot, queries: DataFrame, mode: str, pool: int, top_k: int, config: FusionConfig | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, item_id, rank, fusion_score and what the mode knows). digits rounds scores before they rank."""
    config = (config or FusionConfig()).validate()
    if mode != "bm25" and snapshot.semantic is None:
        raise ValueError("the snapshot has no semantic index")
    if mode == "bm25":
        return snapshot.bm25.search(queries, pool, digits).withColumnRenamed("score", "fusion_score")
    if mode == "semantic":
        return snapshot.semantic.search(queries, pool, digits).withColumnRenamed("score", "fusion_score")
    both = candidates(snapshot.bm25.search(queries, pool, digits), snapshot.semantic.search(queries, pool, digits))
    if mode == "rrf":
        return fuse_rrf(both, config.rrf_k, top_k, digits)
    return fuse_linear(both, config.bm25_weight, config.semantic_weight, top_k, digits)


def search(snapshot: Snapshot, queries: DataFrame, mode: str = "linear", top_k: int = 10, profiles: tuple[DataFrame, DataFrame] | None = None, personalize: bool = False, config: PersonalizationConfig | None = None, rerank_pool: bool = False, digits: int | None = None) -> DataFrame:
    """Hits of (query_id, query_text, user_id?): items with their columns, rank and scores. Blank queries give none.

    Personalised fused modes re-order their top_k, single channels their whole pool; rerank_pool re-orders the pool in every mode.
    """
    check_request(top_k, mode, personalize, queries.columns)
    asked = queries.withColumn("query_text", F.trim("query_text")).filter("query_text <> ''")
    pool = pool_size(top_k, snapshot.n_items)
    hits = fused(snapshot, asked, mode, pool, pool if personalize and rerank_pool else top_k, digits=digits)
    if personalize:
        if profiles is None:
            return hits.filter(F.col("rank") <= top_k).withColumn("applied", F.lit(False)).withColumn("fallback_reason", F.lit("profiles_not_ready")).withColumn("pool_size", F.lit(pool))
        mine = hits.select("query_id", "item_id", "rank", "fusion_score").join(asked.select("query_id", "user_id"), "query_id")
        return rerank(mine, profiles, snapshot.items, config, top_k).withColumn("source", F.lit("personalized")).withColumn("pool_size", F.lit(pool))
    hits = hits.filter(F.col("rank") <= top_k).withColumn("source", F.lit(mode)).withColumn("pool_size", F.lit(pool))
    original = F.col("rank") if mode in ("bm25", "semantic") else F.lit(None).cast("long")
    return hits.withColumn("original_rank", original).join(snapshot.items, "item_id", "left")


def evaluate_queries(snapshot: Snapshot, query_ids: DataFrame, queries: DataFrame, qrels: DataFrame, config: FusionConfig | None = None, mode: str = "linear", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics by query and k, macro averages) of a mode's search; an unknown query's text is its id.

    The settings say at which k, from which grade, and how many candidates each channel gives.
    """
    config = (config or FusionConfig()).validate()
    asked = query_ids.select("query_id").distinct().join(queries.select("query_id", "query_text"), "query_id", "left")
    asked = asked.withColumn("query_text", F.coalesce("query_text", F.col("query_id").cast("string")))
    results = fused(snapshot, asked, mode, config.candidate_k, config.candidate_k, config, digits)
    metrics = evaluate(results, qrels.withColumnRenamed("relevance_grade", "grade"), asked, list(config.top_k_values), config.relevance_threshold)
    return metrics, macro_average(metrics)


def impact(snapshot: Snapshot, queries: DataFrame, profiles: tuple[DataFrame, DataFrame], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(overlap by query, rank shifts) of linear search with and without personalisation."""
    base, mine = search(snapshot, queries, "linear", k), search(snapshot, queries, "linear", k, profiles, True)
    return overlap(base, mine, k), rank_shifts(base, mine)

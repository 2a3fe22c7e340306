"""Candidates of two channels, fused by reciprocal ranks or by normalised scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import minmax, ranked, rrf


def candidates(bm25: DataFrame, semantic: DataFrame) -> DataFrame:
    """All items of either channel: (query_id, item_id, bm25_score, bm25_rank, semantic_score, semantic_rank, sources)."""
    a, b = (x.select("query_id", "item_id", F.col("score").alias(f"{n}_score"), F.col("rank").alias(f"{n}_rank")) for x, n in ((bm25, "bm25"), (semantic, "semantic")))
    both = a.join(b, ["query_id", "item_id"], "full_outer")
    named = F.array(*(F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in ("bm25", "semantic")))
    return both.withColumn("sources", F.array_compact(named))


def fuse_rrf(both: DataFrame, rrf_k: float = 60, top_k: int = 20, digits: int | None = None) -> DataFrame:
    score = rrf([F.col("bm25_rank"), F.col("semantic_rank")], rrf_k)
    scored = both.withColumn("fusion_score", F.round(score, digits) if digits else score)
    return ranked(scored, ["query_id"], [F.desc("fusion_score"), F.asc("item_id")], top_k)


def fuse_linear(both: DataFrame, bm25_weight: float = 0.5, semantic_weight: float = 0.5, top_k: int = 20, digits: int | None = None) -> DataFrame:
    """Weighted sum of scores on 0 to 1; a channel that lacks the item gives 0 and its normalised score is null."""
    total = bm25_weight + semantic_weight
    wb, ws = (bm25_weight / total, semantic_weight / total) if total > 0 else (0.5, 0.5)
    out = both.withColumn("bm25_norm", minmax(F.col("bm25_score"), ["query_id"])).withColumn("semantic_norm", minmax(F.col("semantic_score"), ["query_id"]))
    score = F.coalesce("bm25_norm", F.lit(0.0)) * wb + F.coalesce("semantic_norm", F.lit(0.0)) * ws
    out = out.withColumn("fusion_score", F.round(score, digits) if digits else score)
    return ranked(out, ["query_id"], [F.desc("fusion_score"), F.asc("item_id")], top_k)

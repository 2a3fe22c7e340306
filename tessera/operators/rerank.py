"""Personalised re-ranking of candidates, with fallback for users without a warm profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PersonalizationConfig
from ..functions.scoring import minmax, price_affinity, ranked
from .profiles import DIMENSIONS


def rerank(hits: DataFrame, profiles: tuple[DataFrame, DataFrame], items: DataFrame, config: PersonalizationConfig | None = None, top_k: int | None = None, digits: int | None = None) -> DataFrame:
    """hits (query_id, user_id, item_id, rank, fusion_score) in personal order.

    A repeated item keeps its best rank; missing items and affinities count 0; users that are not warm keep the order, with their fallback_reason: unknown_user,
    cold_start_user or no_profile. A warm user flagged cold-start is re-ranked and still says cold_start_user.
    """
    config = (config or PersonalizationConfig()).validate()
    wr, wc, ws, wb, wp = config.weights
    affinity, summary = profiles
    first = Window.partitionBy("query_id", "user_id", "item_id").orderBy("rank")
    c = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    c = c.withColumn("retrieval", minmax(F.col("fusion_score"), ["query_id", "user_id"]))
    c = c.join(items.select("item_id", *DIMENSIONS, "price"), "item_id", "left")
    c = c.join(summary.select("user_id", "profile_status", "is_cold_start", "mean_log_price"), "user_id", "left")
    for d in DIMENSIONS:
        mine = affinity.filter(F.col("dim") == d).select("user_id", F.col("key").alias(d), F.col("weight").alias(f"{d}_affinity"))
        c = c.join(mine, ["user_id", d], "left")
    warm = F.coalesce(F.col("profile_status") == "warm", F.lit(False))
    for d in DIMENSIONS:
        c = c.withColumn(f"{d}_affinity", F.when(warm, F.coalesce(f"{d}_affinity", F.lit(0.0))).otherwise(0.0))
    c = c.withColumn("price_affinity", F.when(warm, F.coalesce(price_affinity(F.col("price"), F.col("mean_log_price")), F.lit(0.0))).otherwise(0.0))
    score = F.when(warm, F.col("retrieval") * wr + F.col("category_affinity") * wc + F.col("subcategory_affinity") * ws + F.col("brand_affinity") * wb + F.col("price_affinity") * wp).otherwise(F.col("retrieval"))
    c = c.withColumn("personalized_score", F.round(score, digits) if digits else score)
    reason = F.when(F.col("profile_status").isNull(), "unknown_user").when(F.col("is_cold_start"), "cold_start_user").when(warm, "none").otherwise("no_profile")
    c = c.withColumn("applied", warm).withColumn("fallback_reason", reason).withColumnRenamed("rank", "original_rank")
    order = [F.when(warm, -F.col("personalized_score")).otherwise(0.0).asc(), F.asc("original_rank"), F.asc("item_id")]
    return ranked(c, ["query_id", "user_id"], order, top_k)

"""User profiles: weighted, time-decayed affinities of positive events, their merge and refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PersonalizationConfig
from ..functions.scoring import days_between, decay

DIMENSIONS = ("category", "subcategory", "brand")
#: Weights of base and behaviour in a merge.
BASE, BEHAVIOUR = 0.4, 0.6


def event_weight(event_type: Column, weights: dict[str, float]) -> Column:
    """A type's weight; null for types without a positive one."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, w in weights.items():
        if w > 0:
            out = out.when(event_type == name, F.lit(float(w)))
    return out


def effective(events: DataFrame, items: DataFrame, weights: dict[str, float], half_life: float) -> DataFrame:
    """All events with eff: weight and decay of positive events on known items, null for others.

    Ages count from the latest event of any kind.
    """
    known = items.select("item_id", *DIMENSIONS, "price").withColumn("known", F.lit(True))
    latest = events.agg(F.max("timestamp").alias("latest"))
    out = events.join(known, "item_id", "left").crossJoin(F.broadcast(latest))  # one row
    w = event_weight(F.col("event_type"), weights)
    age = days_between(F.col("latest"), F.col("timestamp"))
    return out.withColumn("eff", F.when(F.col("known"), w * decay(age, half_life)))


def affinities(eff: DataFrame) -> DataFrame:
    """(user_id, dim, key, score, weight): sums by category, subcategory and brand, and their shares; empty keys are skipped."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in DIMENSIONS))
    long = eff.filter(F.col("eff").isNotNull()).select("user_id", "eff", F.explode(pairs).alias("p")).select("user_id", "p.dim", "p.key", "eff")
    sums = long.filter(F.coalesce(F.col("key"), F.lit("")) != "").groupBy("user_id", "dim", "key").agg(F.sum("eff").alias("score"))
    total = F.sum("score").over(Window.partitionBy("user_id", "dim"))
    return sums.withColumn("total", total).filter("total > 0").select("user_id", "dim", "key", "score", (F.col("score") / F.col("total")).alias("weight"))


def status(positive: Column, cold: Column, train: Column) -> Column:
    return F.when(positive > 0, "warm").when(cold, "cold_start").when(train > 0, "no_positive").otherwise("no_history")


def summaries(eff: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, is_cold_start, counts, last positive event, mean log price, profile_status) of all users known or seen in events."""
    p = F.col("price").cast("double")
    priced = F.col("eff").isNotNull() & (p > 0)
    agg = eff.groupBy("user_id").agg(
        F.count("*").alias("train_event_count"),
        F.count("eff").alias("positive_event_count"),
        F.count_distinct("session_id").alias("train_session_count"),
        F.max(F.when(F.col("eff").isNotNull(), F.col("timestamp"))).alias("last_event_at"),
        F.try_divide(F.sum(F.when(priced, F.ln(F.when(p > 0, p)) * F.col("eff"))), F.sum(F.when(priced, F.col("eff")))).alias("mean_log_price"),
    )
    out = users.select("user_id", "is_cold_start").join(agg, "user_id", "full_outer")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("train_event_count", "positive_event_count", "train_session_count")]
    out = out.select("user_id", F.coalesce("is_cold_start", F.lit(False)).alias("is_cold_start"), *counts, "last_event_at", "mean_log_price")
    return out.withColumn("profile_status", status(F.col("positive_event_count"), F.col("is_cold_start"), F.col("train_event_count")))


def build_profiles(events: DataFrame, items: DataFrame, users: DataFrame, config: PersonalizationConfig | None = None, half_life: float | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(affinities, summaries). limit takes the oldest events only; half_life 0 switches decay off."""
    config = (config or PersonalizationConfig()).validate()
    if limit is not None:
        events = events.orderBy("timestamp", "event_id").limit(limit)
    eff = effective(events, items, config.event_weights, config.half_life_days if half_life is None else half_life)
    return affinities(eff), summaries(eff, users)


def merge(base: tuple[DataFrame, DataFrame], behaviour: tuple[DataFrame, DataFrame], base_weight: float = BASE, behaviour_weight: float = BEHAVIOUR, keep_subcategory: bool = False) -> tuple[DataFrame, DataFrame]:
    """Profiles of both, blended where both are warm: (affinities, summaries with source).

    Blends hold categories and brands, and subcategories only if asked; where one side is warm alone it stays as it is; with neither, the base.
    """
    (ba, bs), (ha, hs) = base, behaviour
    b = bs.select("user_id", "is_cold_start", F.col("profile_status").alias("b_status"), F.col("positive_event_count").alias("b_pos"), F.col("mean_log_price").alias("b_price"))
    h = hs.select("user_id", F.col("is_cold_start").alias("h_cold"), F.col("profile_status").alias("h_status"), F.col("positive_event_count").alias("h_pos"), F.col("mean_log_price").alias("h_price"))
    both = b.join(h, "user_id", "full_outer")
    warm_b, warm_h = F.coalesce(F.col("b_status") == "warm", F.lit(False)), F.coalesce(F.col("h_status") == "warm", F.lit(False))
    source = F.when(warm_b & warm_h, "combined").when(warm_h, "behavior").when(F.col("b_status").isNotNull(), "base").otherwise("cold_start")
    both = both.withColumn("source", source)
    mixed = F.coalesce(F.col("b_price") * base_weight + F.col("h_price") * behaviour_weight, F.col("h_price"), F.col("b_price"))
    price = F.when(F.col("source") == "combined", mixed).when(F.col("source") == "behavior", F.col("h_price")).otherwise(F.col("b_price"))
    positive = F.when(F.col("source") == "combined", F.col("b_pos") + F.col("h_pos")).when(F.col("source") == "behavior", F.col("h_pos")).otherwise(F.coalesce("b_pos", F.lit(0)))
    cold = F.when(F.col("source").isin("combined"), F.lit(False)).otherwise(F.coalesce("is_cold_start", "h_cold", F.lit(False)))
    state = F.when(F.col("source").isin("combined", "behavior"), "warm").otherwise(F.coalesce("b_status", F.when(cold, "cold_start").otherwise("no_history")))
    summary = both.select("user_id", cold.alias("is_cold_start"), positive.cast("long").alias("positive_event_count"), price.alias("mean_log_price"), state.alias("profile_status"), "source")
    parts = ba.select("user_id", "dim", "key", "weight", F.lit("b").alias("side")).unionByName(ha.select("user_id", "dim", "key", "weight", F.lit("h").alias("side")))
    parts = parts.join(both.select("user_id", "source"), "user_id")
    share = F.when(F.col("source") == "combined", F.when(F.col("side") == "b", base_weight).otherwise(behaviour_weight)).when((F.col("source") == "behavior") == (F.col("side") == "h"), 1.0)
    if not keep_subcategory:
        parts = parts.filter(~((F.col("source") == "combined") & (F.col("dim") == "subcategory")))
    sums = parts.withColumn("share", share).filter("share IS NOT NULL").groupBy("user_id", "dim", "key").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))
    total = F.sum("score").over(Window.partitionBy("user_id", "dim"))
    return sums.withColumn("weight", F.col("score") / total), summary


def refresh(users: DataFrame, wanted: DataFrame, events: DataFrame, items: DataFrame, current: tuple[DataFrame, DataFrame], config: PersonalizationConfig | None = None, limit: int | None = 5000) -> tuple[DataFrame, DataFrame]:
    """The current profiles merged with the wanted users' (user_id) positive events on known items, each user's oldest limit ones.

    Ages count from each call's latest such event; users not wanted keep their profile.
    """
    config = (config or PersonalizationConfig()).validate()
    mine = events.join(wanted.select("user_id").distinct(), "user_id", "left_semi")
    if limit is not None:
        order = Window.partitionBy("user_id").orderBy("timestamp", "event_id")
        mine = mine.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).drop("nth")
    mine = mine.filter(event_weight(F.col("event_type"), config.event_weights).isNotNull()).join(items.select("item_id"), "item_id", "left_semi")
    half_life = 0.0 if config.half_life_days >= 1e12 else config.half_life_days
    fresh = build_profiles(mine, items, users.join(wanted.select("user_id"), "user_id", "left_semi"), config, half_life)
    return merge(current, fresh)


def status_counts(summary: DataFrame) -> DataFrame:
    warm = (F.col("profile_status") == "warm") & (F.col("positive_event_count") > 0)
    return summary.agg(F.count("*").alias("total_users"), F.count_if(warm).alias("behavior_profiles"), F.count_if(~warm).alias("fallback_profiles"))


def refresh_counts(summary: DataFrame, wanted: DataFrame, events: DataFrame) -> DataFrame:
    """One row of a refresh: users requested, refreshed by behaviour, unchanged, failed (unknown users), and their events."""
    asked = wanted.select("user_id").distinct().join(summary.select("user_id", "source"), "user_id", "left")
    mine = events.join(wanted.select("user_id").distinct(), "user_id", "left_semi").agg(F.count("*").alias("total_events"))
    fresh = F.col("source").isin("combined", "behavior")
    row = asked.agg(F.count("*").alias("requested"), F.count_if(fresh).alias("refreshed"), F.count_if(~fresh).alias("unchanged"), F.count_if(F.col("source").isNull()).alias("failed"))
    return row.crossJoin(F.broadcast(mine))  # one row each

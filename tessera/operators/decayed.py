"""Profiles as mergeable sums: every sum is kept as of a time of its own, so new events add in whatever their order, and a refresh reads no old ones.

A sum of weights that halve every half_life days, taken as of one time, is as of a later time itself times the decay between the two. Two sums of one key meet at the later of
their times; events that come late are a sum as of an earlier time. Shares need sums as of one time, whichever it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import days_between, decay
from .profiles import DIMENSIONS, effective, status

#: The sums behind the mean of logarithms of prices, a dimension of their own.
PRICE = "log_price"
COUNTS = ("train_event_count", "positive_event_count")


@dataclass
class ProfileState:
    """sums (user_id, dim, key, at, score), counts (user_id, train_event_count, positive_event_count, last_event_at, latest), sessions (user_id, session_id)."""

    sums: DataFrame
    counts: DataFrame
    sessions: DataFrame

    def select(self, change) -> ProfileState:
        return ProfileState(change(self.sums), change(self.counts), change(self.sessions))


def observed(events: DataFrame, items: DataFrame, weights: dict[str, float], half_life: float) -> ProfileState:
    """The state of one batch of events, as of the batch's latest."""
    eff = effective(events, items, weights, half_life)  # relative to the batch's latest event
    p = F.col("price").cast("double")
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("key"), F.lit(1.0).alias("by")) for d in DIMENSIONS]
    priced = [F.struct(F.lit(PRICE).alias("dim"), F.when(p > 0, F.lit(k)).alias("key"), v.alias("by")) for k, v in (("sum", F.ln(F.when(p > 0, p))), ("weight", F.lit(1.0)))]
    rows = eff.filter("eff IS NOT NULL").select("user_id", "eff", "latest", F.explode(F.array(*pairs, *priced)).alias("p")).select("user_id", "p.dim", "p.key", "latest", (F.col("eff") * F.col("p.by")).alias("part"))
    sums = rows.filter(F.coalesce(F.col("key"), F.lit("")) != "").groupBy("user_id", "dim", "key").agg(F.max("latest").alias("at"), F.sum("part").alias("score"))
    counts = eff.groupBy("user_id").agg(F.count("*").alias(COUNTS[0]), F.count("eff").alias(COUNTS[1]), F.max(F.when(F.col("eff").isNotNull(), F.col("timestamp"))).alias("last_event_at"), F.max("timestamp").alias("latest"))
    return ProfileState(sums, counts, events.filter("session_id IS NOT NULL").select("user_id", "session_id").distinct())


def merged(a: ProfileState, b: ProfileState, half_life: float) -> ProfileState:
    """The state of all events of both. Sums meet at the later time; counts add; sessions are a set."""

    def sides(x: DataFrame, y: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
        other = y.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
        return x.join(other, key, "full_outer")

    at = F.greatest("at", "_at")
    brought = lambda score, since: F.coalesce(F.col(score) * decay(days_between(at, F.col(since)), half_life), F.lit(0.0))
    sums = sides(a.sums, b.sums, ["user_id", "dim", "key"], ["at", "score"])
    sums = sums.select("user_id", "dim", "key", at.alias("at"), (brought("score", "at") + brought("_score", "_at")).alias("score"))
    counts = sides(a.counts, b.counts, ["user_id"], [*COUNTS, "last_event_at", "latest"])
    added = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in COUNTS]
    counts = counts.select("user_id", *added, *(F.greatest(c, f"_{c}").alias(c) for c in ("last_event_at", "latest")))
    return ProfileState(sums, counts, a.sessions.unionByName(b.sessions).distinct())


def _as_of(latest: Column, half_life: float) -> Column:
    return F.col("score") * decay(days_between(latest, F.col("at")), half_life)


def profiles_of(state: ProfileState, users: DataFrame, half_life: float) -> tuple[DataFrame, DataFrame]:
    """(affinities, summaries) as build_profiles() makes them of all the state's events."""
    latest = F.broadcast(state.counts.agg(F.max("latest").alias("now")))  # one row
    now = state.sums.crossJoin(latest).select("user_id", "dim", "key", _as_of(F.col("now"), half_life).alias("score"))
    affinities = now.filter(F.col("dim") != PRICE).withColumn("total", F.sum("score").over(Window.partitionBy("user_id", "dim"))).filter("total > 0")
    affinities = affinities.select("user_id", "dim", "key", "score", (F.col("score") / F.col("total")).alias("weight"))
    one = lambda k: F.sum(F.when(F.col("key") == k, F.col("score")))
    prices = now.filter(F.col("dim") == PRICE).groupBy("user_id").agg(F.try_divide(one("sum"), one("weight")).alias("mean_log_price"))
    sessions = state.sessions.groupBy("user_id").agg(F.count("*").alias("train_session_count"))
    out = users.select("user_id", "is_cold_start").join(state.counts, "user_id", "full_outer").join(sessions, "user_id", "left").join(prices, "user_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "train_session_count")]
    out = out.select("user_id", F.coalesce("is_cold_start", F.lit(False)).alias("is_cold_start"), *counts, "last_event_at", "mean_log_price")
    return affinities, out.withColumn("profile_status", status(F.col("positive_event_count"), F.col("is_cold_start"), F.col("train_event_count")))

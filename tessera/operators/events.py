"""Event filters, funnel statistics, listings and idempotent capture."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_TYPES


def matching(events: DataFrame, user_id=None, query_id=None, event_type: str | None = None, start=None, end=None) -> DataFrame:
    """Events that meet all given conditions; times are inclusive, empty values set none."""
    if event_type and event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type}")
    if start and end and start > end:
        raise ValueError("start lies after end")
    for column, value in (("user_id", user_id), ("query_id", query_id), ("event_type", event_type)):
        if value not in (None, ""):
            events = events.filter(F.col(column) == value)
    if start:
        events = events.filter(F.col("timestamp") >= F.lit(start))
    return events.filter(F.col("timestamp") <= F.lit(end)) if end else events


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("count"))


def funnel(events: DataFrame) -> DataFrame:
    """One row: total, the five counts, click-through rate, and the rates of favourites, carts and purchases per click; 0 where nothing divides."""
    row = events.agg(F.count("*").alias("total_events"), *(F.count_if(F.col("event_type") == t).alias(f"{t}_count") for t in EVENT_TYPES))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(f"{a}_count"), F.col(f"{b}_count")), F.lit(0.0)), 6)
    return row.withColumns({"ctr": rate("click", "impression"), "favorite_rate": rate("favorite", "click"), "cart_rate": rate("add_to_cart", "click"), "purchase_rate": rate("purchase", "click")})


def for_user(events: DataFrame, user_id, event_type: str | None = None, after=None, before=None, limit: int = 1000) -> DataFrame:
    """A user's events from after up to, not at, before, oldest first."""
    out = matching(events, user_id=user_id, event_type=event_type)
    out = out.filter(F.col("timestamp") >= F.lit(after)) if after else out
    out = out.filter(F.col("timestamp") < F.lit(before)) if before else out
    return out.orderBy("timestamp", "event_id").limit(limit)


def for_query(events: DataFrame, query_id, limit: int = 1000) -> DataFrame:
    return events.filter(F.col("query_id") == query_id).orderBy("timestamp", "event_id").limit(limit)


def for_request(events: DataFrame, request_id, limit: int = 100) -> DataFrame:
    return events.filter(F.col("request_id") == request_id).orderBy("position", "event_id").limit(limit)


def training(events: DataFrame, types: tuple[str, ...] | None = None, limit: int | None = 20_000) -> DataFrame:
    """The oldest events, of some types if given; limit None takes all."""
    out = events.filter(F.col("event_type").isin(*types)) if types else events
    out = out.select("event_id", "user_id", "item_id", "event_type", "timestamp", "session_id")
    return out if limit is None else out.orderBy("timestamp", "event_id").limit(limit)


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The latest events, 100 at most; of equal times the smaller id first."""
    return events.orderBy(F.desc("timestamp"), "event_id").limit(min(limit, 100))


def time_range(start: str | None, end: str | None) -> tuple[datetime | None, datetime | None]:
    """Times of ISO-8601 texts; ValueError 'invalid_time_format' or, if start lies after end, 'invalid_time_range'. Empty texts set no bound."""
    try:
        a, b = (datetime.fromisoformat(t) if t else None for t in (start, end))
    except ValueError as e:
        raise ValueError("invalid_time_format") from e
    if a and b and a > b:
        raise ValueError("invalid_time_range")
    return a, b


def request_name(given: Column) -> Column:
    """A request's id: the given one if it is made of letters, digits, - and _ (128 at most), else 16 random hexadecimal digits."""
    return F.when(given.rlike(r"\A[a-zA-Z0-9\-_]{1,128}\z"), given).otherwise(F.substr(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(1), F.lit(16)))


def refusal(columns: list[str]) -> Column:
    """The first rule that a request for an event breaks, null if none; columns that a table lacks are not looked at.

    A known type, an event id of 1 to 64 characters, other ids of 64 at most, a query text of 512 at most, a position from 1, amounts from 0.
    """
    long_ = lambda c, n: F.length(F.col(c).cast("string")) > n
    rules = {"event_type": ~F.coalesce(F.col("event_type"), F.lit("")).isin(*EVENT_TYPES)} if "event_type" in columns else {}
    if "event_id" in columns:
        rules["event_id"] = F.coalesce(F.length(F.col("event_id").cast("string")), F.lit(0)).between(1, 64) == F.lit(False)
    rules |= {c: long_(c, 64) for c in ("client_event_id", "request_id", "session_id", "user_id", "query_id", "item_id") if c in columns}
    rules |= {"query_text": long_("query_text", 512)} if "query_text" in columns else {}
    rules |= {"position": F.col("position") < 1} if "position" in columns else {}
    rules |= {c: (F.col(c) < 0) | F.isnan(F.col(c).cast("double")) for c in ("click_duration_ms", "add_to_cart_quantity", "purchase_amount") if c in columns}
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules.items())) if rules else F.lit(None).cast("string")


def capture(log: DataFrame, new: DataFrame, checked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events to append, event to answer for each new one): a client_event_id that is in the log, or earlier in new, names the event already there.

    Blank query ids and texts become null; events without client_event_id are always appended. What refusal() names is left out unless checked is False.
    """
    new = new.filter(refusal(new.columns).isNull()) if checked else new
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(F.col(c)).alias(c)
    new = new.select(*(blank(c) if c in ("query_id", "query_text") else F.col(c) for c in new.columns))
    keyed, free = new.filter("client_event_id IS NOT NULL"), new.filter("client_event_id IS NULL")
    firsts = keyed.groupBy("client_event_id").agg(F.min(F.struct("timestamp", "event_id")).alias("f")).select("client_event_id", F.col("f.event_id").alias("first_id"))
    known = log.filter("client_event_id IS NOT NULL").groupBy("client_event_id").agg(F.min("event_id").alias("known_id"))
    answer = keyed.join(firsts, "client_event_id").join(known, "client_event_id", "left").withColumn("answered_by", F.coalesce("known_id", "first_id"))
    fresh = answer.filter("known_id IS NULL AND event_id = first_id").select(*new.columns).dropDuplicates(["client_event_id"])
    answers = answer.select("event_id", "client_event_id", "answered_by").unionByName(free.select("event_id", "client_event_id", F.col("event_id").alias("answered_by")))
    return fresh.unionByName(free), answers


def impressions(hits: DataFrame) -> DataFrame:
    """One impression for each hit (query_id, user_id, item_id, rank)."""
    return hits.select(F.concat_ws(":", "query_id", "user_id", "rank").alias("event_id"), F.lit("impression").alias("event_type"), "user_id", "query_id", "item_id", F.col("rank").alias("position"))

"""Canonical tables, their types and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, I, TS, P = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType(), T.DecimalType(12, 2)
LIST = T.ArrayType(S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


# Column names and order of the CSV files, event types.
TABLES = {
    "items": _table(item_id=S, title=S, description=S, category=S, subcategory=S, brand=S, price=P, quality_score=D, popularity_score=D, is_cold_start=B, created_at=TS),
    "users": _table(user_id=S, preferred_categories=LIST, preferred_brands=LIST, price_preference=S, activity_level=S, is_cold_start=B, created_at=TS),
    "queries": _table(query_id=S, query_text=S, intended_category=S, semantic_intent=S, created_at=TS),
    "events": _table(event_id=S, event_type=S, request_id=S, session_id=S, user_id=S, query_id=S, query_text=S, item_id=S, position=I, timestamp=TS, click_duration_ms=I, add_to_cart_quantity=I, purchase_amount=P),
    "qrels": _table(query_id=S, item_id=S, relevance_grade=I),
}
KEYS = {"items": ["item_id"], "users": ["user_id"], "queries": ["query_id"], "events": ["event_id"], "qrels": ["query_id", "item_id"]}
EVENT_TYPES = ("impression", "click", "favorite", "add_to_cart", "purchase")
POSITIVE_TYPES = EVENT_TYPES[1:]


def raw(name: str) -> T.StructType:
    """The table as text, as CSV holds it."""
    return T.StructType([T.StructField(f.name, S) for f in TABLES[name].fields])

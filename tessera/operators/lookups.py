"""Pages, point and list lookups, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, key: str, offset: int = 0, limit: int = 100, where: Column | None = None) -> DataFrame:
    """limit rows (1 to 100) by key from offset on, of those that meet where."""
    df = df if where is None else df.filter(where)
    return df.orderBy(key).offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def by_ids(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of the ids that exist, once each, by id; none for an empty list."""
    return df.filter(F.col(key).isin(list(dict.fromkeys(values)))).orderBy(key) if values else df.limit(0)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

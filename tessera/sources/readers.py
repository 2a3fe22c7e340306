"""Readers of the canonical tables: CSV with a strict header, Parquet, JDBC; and typed rows from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES, raw


def read_raw(spark: SparkSession, folder: str, name: str, breaks: bool = True) -> DataFrame:
    """folder/name.csv, a file or a folder of parts, as text columns; the header must hold exactly the table's columns in order (checked as the file is read).

    breaks: quoted values may hold line breaks, so a file is read by one task; without, large files are split.
    """
    options = {"header": True, "enforceSchema": False, "escape": '"', "multiLine": breaks, "encoding": "UTF-8", "mode": "FAILFAST"}
    return spark.read.schema(raw(name)).options(**options).csv(f"{folder}/{name}.csv")


def flag(c: Column) -> Column:
    """true/1/yes and false/0/no, trimmed, in any case; null for others."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def moment(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c))


def as_type(c: Column, kind: T.DataType) -> Column:
    """A text column as a table's type; null where it can't be."""
    if isinstance(kind, T.StringType):
        return blank(c)
    if isinstance(kind, T.BooleanType):
        return flag(c)
    if isinstance(kind, T.ArrayType):
        return F.from_json(c, kind)
    if isinstance(kind, T.TimestampType):
        return moment(c)
    return blank(c).try_cast(kind)


def typed(text: DataFrame, name: str) -> DataFrame:
    """Text rows in the table's types; descriptions stay empty rather than null."""
    columns = [as_type(F.col(f.name), f.dataType).alias(f.name) for f in TABLES[name].fields]
    out = text.select(*columns)
    return out.withColumn("description", F.coalesce("description", F.lit(""))) if name == "items" else out


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """df into a table of a database, by one connection a task."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=name, **options).save()

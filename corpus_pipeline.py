"""A training corpus from documents: language, near duplicates, secrets, mix of sources, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, neardup, pieces, secrets
from tessera.llm.common import fresh, stored, table

#: Words in a shingle of the near-duplicate stage.
WORDS = 5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known for sure: neither 'und' nor ambiguous. Learns from docs' own labels.

    Null and empty texts and texts without a letter go; rows that repeat, null ids and all columns, whatever their names, stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*others).alias("_row"))  # so that no column meets the prediction's
    found = langid.predict(packed, langid.fit(docs)).filter((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return found.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates.

    Of a repeated id all different texts stay, of equal texts of one id one row. Documents with a null id all stay, as do texts without words.
    """
    kept = neardup.near_duplicates(docs, WORDS).filter("kept").select("doc_id").distinct()
    print_ = fresh(docs.columns, "_print")
    some = docs.join(kept, "doc_id", "left_semi").withColumn(print_, F.xxhash64("text")).dropDuplicates(["doc_id", print_])
    return some.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; null and empty texts stay as they are."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' copies and parts that the mix takes, rows with a null id among them; texts without words are taken 0 times."""
    null = fresh(docs.columns, "_null")
    # the operator leaves null ids out, so such rows go through it under ids made of their text
    named = docs.withColumn(null, F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "source")))
    mixed = mixing.mixed_documents(named)
    return mixed.withColumn("doc_id", F.when(~F.col(null), F.col("doc_id")).cast(docs.schema["doc_id"].dataType)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the ids of every row, no ids for null and empty texts."""
    return pieces.encode(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("pieces", encoding_stage),
]
#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

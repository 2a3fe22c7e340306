"""Row checks of the canonical tables: every violation of a table as a row (table, key, rule, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_TYPES, KEYS
from .readers import blank, flag, moment

#: Rows of a repeated key that one task makes; parts of the rows of an unknown id.
BLOCK, SALT = 10_000, 32


class ValidationError(ValueError):
    """A table with violations: how many by rule, and some of them by name in errors."""

    def __init__(self, table: str, errors: list[str], counts: dict[str, int]):
        super().__init__(f"{table}: {sum(counts.values())} violations, first: {'; '.join(errors[:5])}")
        self.errors, self.counts = errors, counts


def bad_number(c: Column, lo: float | None = 0, hi: float | None = None, optional: bool = False, kind: str = "double") -> Column:
    """Not a number of kind, NaN, or outside lo to hi; blank is bad unless optional."""
    v = blank(c).try_cast(kind)
    out = v.isNull() | (F.isnan(v.cast("double")))
    if lo is not None:
        out = out | (v < lo)
    if hi is not None:
        out = out | (v > hi)
    return F.coalesce(F.when(blank(c).isNull(), F.lit(not optional)).otherwise(out), F.lit(True))


def bad_list(c: Column) -> Column:
    """Not a JSON list; null and blank are bad too."""
    return F.from_json(c, "array<string>").isNull() | ~F.trim(c).startswith("[")


def checks(name: str) -> dict[str, tuple[str, Column]]:
    """Rules of single rows: name to (column, violated)."""
    c = F.col
    none = lambda x: blank(c(x)).isNull()
    if name == "items":
        return {"item_id": ("item_id", none("item_id")), "price": ("price", bad_number(c("price"), kind="decimal(12,2)")), "quality_score": ("quality_score", bad_number(c("quality_score"), 0, 1)), "popularity_score": ("popularity_score", bad_number(c("popularity_score"), 0, 1)), "is_cold_start": ("is_cold_start", flag(c("is_cold_start")).isNull()), "created_at": ("created_at", moment(c("created_at")).isNull())}
    if name == "users":
        return {"user_id": ("user_id", none("user_id")), "preferred_categories": ("preferred_categories", F.coalesce(bad_list(c("preferred_categories")), F.lit(True))), "preferred_brands": ("preferred_brands", F.coalesce(bad_list(c("preferred_brands")), F.lit(True))), "is_cold_start": ("is_cold_start", flag(c("is_cold_start")).isNull()), "created_at": ("created_at", moment(c("created_at")).isNull())}
    if name == "queries":
        return {"query_id": ("query_id", none("query_id")), "created_at": ("created_at", moment(c("created_at")).isNull())}
    if name == "qrels":
        return {"relevance_grade": ("relevance_grade", bad_number(c("relevance_grade"), 1, 3, kind="int"))}
    return {
        "event_id": ("event_id", none("event_id")), "event_type": ("event_type", ~F.coalesce(F.trim("event_type"), F.lit("")).isin(*EVENT_TYPES)), "timestamp": ("timestamp", moment(c("timestamp")).isNull()),
        "position": ("position", bad_number(c("position"), 1, optional=True, kind="int")), "click_duration_ms": ("click_duration_ms", bad_number(c("click_duration_ms"), 0, optional=True, kind="int")),
        "add_to_cart_quantity": ("add_to_cart_quantity", bad_number(c("add_to_cart_quantity"), 0, optional=True, kind="int")), "purchase_amount": ("purchase_amount", bad_number(c("purchase_amount"), 0, optional=True, kind="decimal(12,2)")),
    }


#: Foreign keys: column, table, whether null is allowed.
REFERENCES = {"qrels": (("query_id", "queries", False), ("item_id", "items", False)), "events": (("user_id", "users", False), ("item_id", "items", False), ("query_id", "queries", True))}


def first_rows(text: DataFrame, key: Column) -> DataFrame:
    """(_key, _n, the columns of text): one row of each key, that of the smallest hash, and how many rows have the key.

    Partial aggregates: of a key that most rows share, each task sends one row.
    """
    row = F.struct(F.xxhash64(*text.columns).alias("_hash"), *text.columns)
    found = text.select(key.alias("_key"), row.alias("_row")).groupBy("_key").agg(F.count("*").alias("_n"), F.min("_row").alias("_row"))
    return found.select("_key", "_n", *(F.col("_row").getField(c).alias(c) for c in text.columns))


def repeats(firsts: DataFrame) -> DataFrame:
    """(_key): each key once for every row of it besides the first; blocks of BLOCK rows are dealt over the tasks before they are made."""
    blocks = firsts.filter("_n > 1").select("_key", "_n", F.explode(F.expr(f"sequence(0L, (_n - 2) div {BLOCK})")).alias("_block"))
    blocks = blocks.repartition("_key", "_block")
    return blocks.select("_key", F.explode(F.expr(f"sequence(1L, least({BLOCK}L, _n - 1 - _block * {BLOCK}))"))).select("_key")


def unknown(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose trimmed column is none of known's (_id); null is unknown.

    Ids are made distinct where the rows are, so it is distinct ids that meet known. The unknown ones lead back to their rows in SALT
    parts, so an unknown or blank id that most rows share is spread.
    """
    ids = rows.select(F.trim(column).alias("_id")).distinct()
    bad = ids.join(known, "_id", "left_anti").select(F.col("_id"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    own = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(SALT)).cast("int"))
    return own.join(bad, F.trim(column).eqNullSafe(bad["_id"]) & (own["_part"] == bad["_part"]), "left_semi")


def violations(name: str, text: DataFrame, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, key, rule, value) of text rows. Repeated keys and unknown event types give one row and no other."""
    key = F.concat_ws("/", *(F.coalesce(F.trim(k), F.lit("")) for k in KEYS[name]))
    firsts = first_rows(text, key)
    flags = F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value"))) for rule, (column, bad) in checks(name).items()))
    found, rows = F.array_compact(flags), firsts
    if name == "events":
        type_bad = checks(name)["event_type"][1]
        found = F.when(type_bad, F.array(F.struct(F.lit("event_type").alias("rule"), F.col("event_type").alias("value")))).otherwise(found)
        rows = firsts.filter(~type_bad)
    row = lambda rule, value: (F.lit(name).alias("table"), F.col("_key").alias("key"), rule.alias("rule"), value.alias("value"))
    out = firsts.select("_key", F.explode(found).alias("v")).select(*row(F.col("v.rule"), F.col("v.value")))
    out = out.unionByName(repeats(firsts).select(*row(F.lit("duplicate"), F.col("_key"))))
    for column, other, nullable in REFERENCES.get(name, ()):
        if not others or other not in others:
            continue
        known = others[other].select(F.trim(KEYS[other][0]).alias("_id")).distinct()
        asked = rows.filter(blank(F.col(column)).isNotNull()) if nullable else rows
        out = out.unionByName(unknown(asked, column, known).select(*row(F.lit(f"unknown_{column}"), F.col(column).cast("string"))))
    return out


def sound(name: str, text: DataFrame, others: dict[str, DataFrame] | None = None) -> bool:
    """Whether violations() of these would be empty, told from keys, flags and distinct ids alone: rows are neither kept nor shuffled."""
    c = F.col
    key = F.concat_ws("/", *(F.coalesce(F.trim(k), F.lit("")) for k in KEYS[name]))
    bad = F.lit(False)
    for _, violated in checks(name).values():
        bad = bad | F.coalesce(violated, F.lit(False))
    # all columns are hashed so that all are read: a reader that skips columns would not check their header and number
    row = text.select(key.alias("_key"), bad.alias("_bad"), F.xxhash64(*text.columns).alias("_hash"))
    keys = row.groupBy("_key").agg(F.count("*").alias("_n"), F.max("_bad").alias("_bad"), F.max("_hash").alias("_hash"))
    if keys.filter("(_n > 1 OR _bad) AND _hash IS NOT NULL").limit(1).collect():
        return False
    asked, known = [], None
    for k, (column, other, nullable) in enumerate(REFERENCES.get(name, ())):
        if not others or other not in others:
            continue
        one = F.struct(F.lit(k).alias("_ref"), F.trim(column).alias("_id"))
        asked.append(F.when(blank(c(column)).isNotNull(), one) if nullable else one)
        ids = others[other].select(F.lit(k).alias("_ref"), F.trim(KEYS[other][0]).alias("_id"))
        known = ids if known is None else known.unionByName(ids)
    if not asked:
        return True
    ids = text.select(F.explode(F.array_compact(F.array(*asked))).alias("_r")).select("_r._ref", "_r._id").distinct()
    return not ids.join(known.distinct(), ["_ref", "_id"], "left_anti").limit(1).collect()


def require_valid(name: str, text: DataFrame, others: dict[str, DataFrame] | None = None, most: int = 1000) -> None:
    """Raises if the table has violations, with the number of each rule's and most of them named."""
    if sound(name, text, others):
        return
    bad = violations(name, text, others)
    if found := bad.limit(most).collect():
        counts = {r["rule"]: r["count"] for r in bad.groupBy("rule").count().collect()}
        raise ValidationError(name, [f"{r['key']}: {r['rule']} ({r['value']})" for r in found], counts)

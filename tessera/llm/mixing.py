"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

Slot i of the schedule is the point frac(i * 0.618...) mapped through the sources' cumulative target shares; the slot's rank among
its source's slots names the block it takes. A source's documents stand in a shuffled order (by a hash of id and seed) as one
stream of words that begins anew after its last word (epochs, 3 at most). The source's quota, its target in whole words, is cut into
as many blocks as it has slots, whose sizes differ by a word at most; rank r takes block r. A source too small for a slot gets one after the others.
A document's words taken are those of its blocks that joined a slot, so a source's words are its quota, however many words a slot stands for.

Streams are summed over buckets of the hash first, so no task holds a whole source, and slots are ranked by runs in the same
way. What is driven by sources alone (totals, targets) is a table of a row per source.

Defined results: null text has size 0 and takes nothing; the null source is a source of its own, last in order; a source
without words has target 0; no rows give no rows; repeated rows and ids are rows of their own, ordered by hash, id and size;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import WORD, fresh, stored, table

#: Weights of the sources in order, repeating; a document is taken this many times at most; slots of the schedule; seed.
WEIGHTS, EPOCHS, SLOTS, SEED = (5, 2, 1), 3, 1 << 20, 17
#: Cells of the grid by which points find their source.
CELLS = 4096
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    """Words of the contract in a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size) and more columns of docs."""
    return docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), *more)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, place, weight, target, quota, low, high): a row per source.

    Shares by weight that stop at epochs times the source's size, the excess shared again: in the order of the size that a unit of weight
    can reach, all sources before the first that stays below the common level are full. low and high bound the source's
    part of the unit interval.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    reach = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, after = reach.rowsBetween(Window.unboundedPreceding, -1), reach.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(epochs * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < epochs * F.col("source_size"))
    first = F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(every)
    s = s.withColumn("rank", F.row_number().over(reach)).withColumn("first", first)
    full = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    s = s.withColumn("target", F.when(full, (epochs * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("weight")))
    s = s.withColumn("quota", F.round("target").cast("long"))
    high = F.sum("quota").over(Window.orderBy("place")) / F.sum("quota").over(every)
    s = s.withColumn("high", F.coalesce(high, F.lit(0.0)))
    s = s.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("place")))
    return s.select("source", "source_size", "place", "weight", "target", "quota", "low", "high")


def slot_sources(spark: SparkSession, by_source: DataFrame, slots: int) -> DataFrame:
    """(slot, place): the source whose part of the unit interval holds the slot's point, found by cells of a grid."""
    x = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN))
    x = x.withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = by_source.filter("quota > 0").select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"))
    return x.join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "place")


def schedule(spark: SparkSession, by_source: DataFrame, slots: int) -> DataFrame:
    """(slot, place, rank): rank counts a source's slots from 0, by runs of 4,096 slots and then over the runs."""
    at = slot_sources(spark, by_source, slots).withColumn("run", F.floor(F.col("slot") / 4096))
    runs = at.groupBy("place", "run").count()
    runs = runs.withColumn("before", F.sum("count").over(Window.partitionBy("place").orderBy("run")) - F.col("count"))
    at = at.withColumn("nth", F.row_number().over(Window.partitionBy("run", "place").orderBy("slot")))
    return at.join(runs.drop("count"), ["place", "run"]).select("slot", "place", (F.col("nth") + F.col("before") - 1).cast("long").alias("rank"))


def streams(sizes: DataFrame, by_source: DataFrame, n: int, seed: int, *more: str) -> DataFrame:
    """sizes (and more of its columns) with place, source_size, target, quota, slots, and row (bucket and number in it) and start, its first word in its source's shuffled stream."""
    buckets = max(1, math.isqrt(n))  # as many as rows in one, so neither a bucket nor a source's list of them is long
    d = sizes.withColumn("key", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    b, s = by_source.alias("b"), sums.alias("s")
    sums = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.source", "bucket", "before", "place", "source_size", "target", "quota", "slots")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *more)
    d = d.withColumn("nth", F.row_number().over(inner)).withColumn("start", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d, s = d.alias("d"), sums.alias("s")
    d = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    return d.select("d.doc_id", "d.source", "d.size", "place", "source_size", "target", "quota", "slots", "d.bucket", "nth", (F.col("start") + F.col("before")).alias("start"), *(f"d.{c}" for c in more))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS, seed: int = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and more columns of docs, a row for each of docs."""
    spark = docs.sparkSession
    sizes = stored(sized(docs, *more), "sizes")
    by_source = stored(targets(sizes, weights, epochs), "sources")
    total, n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = max(1, -(-total // slots))
    slotted = stored(schedule(spark, by_source, -(-total // block)).select("place", F.col("rank").alias("block"), F.lit(1).alias("hit")), "slots")
    by_source = by_source.join(slotted.groupBy("place").agg(F.count("*").alias("slots")), "place", "left")
    slotted = slotted.unionByName(by_source.filter("slots IS NULL AND quota > 0").select("place", F.lit(0).cast("long").alias("block"), F.lit(1).alias("hit")))
    d = streams(sizes, by_source.withColumn("slots", F.coalesce("slots", F.lit(1))), n, seed, *more)
    row = ["doc_id", "source", "size", "source_size", "target", *more, "bucket", "nth"]
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    d = d.withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(epochs))))).withColumn("begin", begin)
    d = d.withColumn("end", F.least(F.col("begin") + F.col("size"), "quota"))
    # block b is the words from floor(b * quota / slots) on; words times slots may leave 64 bits
    holds = lambda word: F.expr(f"(cast({word} + 1 as decimal(20, 0)) * cast(slots as decimal(18, 0)) - 1) div cast(quota as decimal(20, 0))")
    edge = lambda at: F.expr(f"(quota div slots) * ({at}) + (quota % slots) * ({at}) div slots")
    d = d.withColumn("block", F.explode_outer(F.when(F.col("begin") < F.col("end"), F.sequence(holds("begin"), holds("(end - 1)")))))
    words = F.least("end", edge("block + 1")) - F.greatest("begin", edge("block"))
    d = d.withColumn("words", words).join(slotted, ["place", "block"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    return d.groupBy(*row).agg(taken.alias("taken")).drop("bucket", "nth")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole copy, and the first words, with the white space before them, of a document that is taken in part.

    All blocks of a quota are taken, so only the document that stands at a quota's end is taken in part, and from its begin on. Rows of equal id, source and
    text are numbered, and so are what the mix takes of them, so none of its words are lost. Null texts and texts without words are taken 0 times; rows with a null id are rows like
    others. Columns and their order stay; n_chars, if there, counts the new text.
    """
    print_, number, taken, words = (fresh(docs.columns, c) for c in ("_print", "_number", "_taken", "_words"))
    key = ["doc_id", "source", print_]
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    nth = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    named = docs.withColumn(print_, F.xxhash64("text"))
    rows = mix(named, more=(print_,), **options).filter("taken > 0").withColumn(number, nth([F.desc("taken")]))
    m, r = named.withColumn(number, nth([F.xxhash64(*plain)])).alias("m"), rows.alias("r")
    same = F.col(f"m.{number}") == F.col(f"r.{number}")
    for c in key:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
    full, rest = F.floor(F.col("r.taken") / F.col("r.size")), F.col("r.taken") % F.col("r.size")
    times = F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    both = m.join(r, same).select("m.*", times.alias(taken)).withColumn(words, F.explode(taken))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col(words).cast("int")), "")
    both = both.withColumn("text", F.when(F.col(words) == 0, F.col("text")).otherwise(head))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)

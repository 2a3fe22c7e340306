"""Exact vector search by pivots: shards around pivot vectors, skipped where the triangle bound says that they hold nothing better.

A few items, far from each other, are pivots (PIVOTS at most, among SPREAD times as many by a hash of their ids); every item belongs to its nearest. A query q and an item v of pivot p with radius r have q.v = q.p + q.(v - p), which is
at most q.p + |q| r. A query first opens the shards of the highest bounds that hold enough items; its top_k-th product there is a threshold, and of the other
shards only those whose bound reaches it are opened. Queries are dealt out by their own nearest pivot, so a block of them opens much the
same shards; items are copied to the blocks that open theirs. Queries and items stay on the executors; the driver sees pivots and a row a pivot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import ranked
from ..storage import stored

#: Pivots at most, items of one, items and queries in a tile at most.
PIVOTS, NEAR, SHARD, BLOCK = 256, 64, 8192, 2048
#: Items a pivot among which the pivots are chosen.
SPREAD = 8
_SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def best(score: np.ndarray, item: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each of asked, by score and then by the smaller item."""
    order = np.lexsort((item, -score, asked))
    score, item, asked = score[order], item[order], asked[order]
    keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
    return score[keep], item[keep], asked[keep]


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has this length and only finite components."""
    return (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _spread(v: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors (fewer, if fewer differ), each the one farthest from those before."""
    chosen, away = [0] if len(v) else [], ((v - v[:1]) ** 2).sum(1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def _bounds(q: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no item of a pivot's can pass, by query and pivot."""
    length = np.sqrt((q * q).sum(1))[:, None]
    return q @ pivots.T + length * radii + _SLACK * (1 + length)


def joined(homes: np.ndarray) -> np.ndarray:
    """The first home of each home's block, by their numbers of queries: neighbours are joined up to BLOCK queries, a larger home stays alone."""
    out, first, held = np.arange(len(homes)), 0, 0
    for home, n in enumerate(homes):
        if held + n > BLOCK:
            first, held = home, 0
        out[home], held = first, held + n
    return out


@dataclass
class PivotIndex:
    """items (item_id, vector, pivot, part), and what the driver holds a pivot: vectors, items, radii, parts."""

    items: DataFrame
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    width: int

    @classmethod
    def build(cls, items: DataFrame, width: int) -> PivotIndex:
        """From (item_id, vector array<double>); vectors of another length and those with null or non-finite components take no part."""
        fits = items.withColumn("vector", F.col("vector").cast("array<double>")).filter(usable(F.col("vector"), width)).select("item_id", "vector")
        n = fits.count()
        wanted = min(PIVOTS, max(1, math.isqrt(n // NEAR))) if n else 0
        some = fits.orderBy(F.xxhash64("item_id"), "item_id").limit(SPREAD * wanted).select("vector").collect() if n else []  # SPREAD * PIVOTS rows
        pivots = _spread(np.array([r[0] for r in some], float).reshape(len(some), width), wanted)
        kind = fits.schema["item_id"].dataType.simpleString()

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (pivots * pivots).sum(1) / 2
            for b in it:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    v = _matrix(part.column("vector"))
                    near = np.argmax(v @ pivots.T - half, axis=1)
                    away = np.sqrt(((v - pivots[near]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("vector"), pa.array(near.astype(np.int32)), pa.array(away)], ["item_id", "vector", "pivot", "away"])

        if not n:
            return cls(fits.withColumns({"pivot": F.lit(0), "part": F.lit(0)}), pivots, *(np.zeros(0),) * 2, np.zeros(0, int), width)
        held = stored(fits.mapInArrow(assign, f"item_id {kind}, vector array<double>, pivot int, away double"), "pivots")
        sizes, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for pivot, size, radius in held.groupBy("pivot").agg(F.count("*"), F.max("away")).collect():  # a row a pivot
            sizes[pivot], radii[pivot] = size, radius
        parts = np.maximum(1, -(-sizes // SHARD))
        dealt = held.withColumn("part", F.pmod(F.xxhash64("item_id"), F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("pivot") + 1)).cast("int"))
        return cls(dealt.drop("away"), pivots, sizes, radii, parts, width)

    def _asks(self, queries: DataFrame, k: int, slack: float, later: bool) -> DataFrame:
        """(query_id, q, home, pivot): the pivots that queries open first, or those that they open later, by their column least (null: all others)."""
        kind, radii, sizes, pivots = queries.schema["query_id"].dataType.simpleString(), self.radii, self.sizes, self.pivots
        half = (pivots * pivots).sum(1) / 2

        def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    q = _matrix(part.column("q"))
                    bound = _bounds(q, pivots, radii)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)  # until k items are held
                    if later:
                        least = part.column("least").to_numpy(zero_copy_only=False)
                        first = ~first & (np.isnan(least)[:, None] | (bound + slack >= least[:, None]))
                    row, pivot = np.nonzero(first & (sizes > 0))
                    home = np.argmax(q @ pivots.T - half, axis=1).astype(np.int32)
                    rows = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("q"), pa.array(home[row]), pa.array(pivot.astype(np.int32))], ["query_id", "q", "home", "pivot"])

        return queries.mapInArrow(ask, f"query_id {kind}, q array<double>, home int, pivot int")

    def _products(self, asks: DataFrame, k: int, digits: int | None) -> DataFrame:
        """(query_id, item_id, score): each tile's k best."""
        kinds = [asks.schema["query_id"].dataType.simpleString(), self.items.schema["item_id"].dataType.simpleString()]

        def tile(queries: pa.Table, items: pa.Table) -> pa.Table:
            names = ["query_id", "item_id", "score"]
            kind = [queries.schema.field("query_id").type if queries.num_columns else None, items.schema.field("item_id").type if items.num_columns else None]
            out = [[], [], []]
            if queries.num_rows and items.num_rows:
                asked, ids, v = _values(queries.column("query_id")), _values(items.column("item_id")), _matrix(items.column("vector"))
                q = _matrix(queries.column("q"))
                for at in range(0, len(asked), 256):
                    score = q[at : at + 256] @ v.T
                    score = np.round(score, digits) if digits else score
                    score[~np.isfinite(score)] = -np.inf
                    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
                    row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                    s, i, a = best(score[row, col], ids[col], row, k)
                    out[0].append(asked[at + a]), out[1].append(i), out[2].append(s)
            if not out[0]:
                return pa.table({n: pa.array([], t) for n, t in zip(names, [kind[0] or pa.int64(), kind[1] or pa.int64(), pa.float64()], strict=True)})
            return pa.table({n: pa.array(np.concatenate(c), t) for n, c, t in zip(names, out, [*kind, pa.float64()], strict=True)})

        cells = asks.select("block", "pivot").distinct()
        parts = F.element_at(F.array(*(F.lit(int(p)) for p in self.parts)), F.col("pivot") + 1)
        left = asks.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("block", "pivot", "part", "query_id", "q")
        right = self.items.join(cells, "pivot").select(F.col("block").alias("block2"), F.col("pivot").alias("pivot2"), F.col("part").alias("part2"), "item_id", "vector")
        return left.groupBy("block", "pivot", "part").cogroup(right.groupBy("block2", "pivot2", "part2")).applyInArrow(tile, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")

    def _blocks(self, asks: DataFrame, homes: np.ndarray) -> DataFrame:
        """asks with block: queries of one home, or of several homes with few queries, so that items are copied by the number of queries and not of homes."""
        at = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("home") + 1)
        return asks.withColumn("block", F.shiftleft(at(joined(homes)).cast("long"), 32) + F.pmod(F.xxhash64("query_id"), at(np.maximum(1, -(-homes // BLOCK)))))

    def rounds(self, queries: DataFrame, top_k: int, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """((query_id, item_id, score) with the top_k of all queries among them, (query_id, pivot) opened) of (query_id, q)."""
        good = stored(queries.withColumn("q", F.col("q").cast("array<double>")).filter(usable(F.col("q"), self.width)).select("query_id", "q"), "queries")
        slack = (0.5 * 10.0**-digits if digits else 0.0) + _SLACK
        first = stored(self._asks(good, top_k, slack, False), "asks")
        homes = np.zeros(len(self.pivots), np.int64)
        for home, n in first.groupBy("home").agg(F.count_distinct("query_id")).collect():  # a row a pivot
            homes[home] = n
        found = stored(self._products(self._blocks(first, homes), top_k, digits), "found")
        least = ranked(found, ["query_id"], [F.desc("score")], top_k).filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
        later = stored(self._asks(good.join(least, "query_id", "left"), top_k, slack, True), "asks")
        more = self._products(self._blocks(later, homes), top_k, digits)
        return found.unionByName(more), first.unionByName(later).select("query_id", "pivot")


def vector_search(queries: DataFrame, items: DataFrame, top_k: int, digits: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): dot products of (query_id, q) with (item_id, vector), best top_k; ties to the smaller id.

    Vectors with null or non-finite components, and those of another length than the queries' longest, take no part; query ids are a key.
    """
    if top_k <= 0:
        raise ValueError("top_k must be above 0")
    width = queries.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    index = PivotIndex.build(items, max(width, 0))
    kinds = [queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    if not len(index.pivots) or width <= 0:
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, item_id {kinds[1]}, score double, rank long")
    return ranked(index.rounds(queries, top_k, digits)[0], ["query_id"], [F.desc("score"), F.asc("item_id")], top_k)

"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merging.

Queries and vectors are packed into blocks; a tile is one block of queries against one shard of vectors, so a
task holds one of each, whatever the table's size. Queries are copied to every shard and vectors to every block of
queries, the least that an exact search of this kind can move. Each tile keeps its k best per query;
lists of FAN shards are merged at a time until one list is left.

Defined results: vectors that are null or empty, or hold null, NaN or infinite components, take no part; vectors meet only
vectors of their own length; rows that share the query's id are the query's own; repeated rows of another id count
each; products beyond 64 bits are held at their ends; ties go to the smaller id; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors in a shard at most, queries in a block, lists merged at a time.
SHARD, BLOCK, FAN = 8192, 2048, 16


def integer_components(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of usable rows; v = floor(scale * x), x as double."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where no sum can leave 2**53, else by Python's integers."""
    top = [max(abs(int(x.max())), abs(int(x.min()))) for x in (q, v)]
    if top[0] * top[1] * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    most = np.iinfo(np.int64).max
    return np.clip(q.astype(object) @ v.T.astype(object), -most, most).astype(np.int64)


def _tile(k: int):
    def best(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):  # a side without rows has no columns
            vectors = vectors.sort_values("id", kind="stable")
            ids, v = vectors["id"].to_numpy(), np.stack(vectors["x"].to_numpy())
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                own, q = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())
                s = _scores(q, v)
                s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
                n = min(k, s.shape[1])
                kth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                row, col = np.nonzero(s >= kth[:, None])  # all ties of the k-th; ids ascend within a row
                order = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                keep = (np.arange(len(row)) - first < n) & (s[row, col] != np.iinfo(np.int64).min)
                out.append(pd.DataFrame({"query_id": own[row[keep]], "vec_id": ids[col[keep]], "score": s[row[keep], col[keep]], "shard": int(key[1])}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score", "shard")})

    return best


def search(queries: DataFrame, vectors: DataFrame, k: int, n_queries: int, n_vectors: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query. Both inputs: (vec_id, v); n_*: row counts, for the grid."""
    blocks, shards = max(1, -(-n_queries // BLOCK)), max(1, -(-n_vectors // min(SHARD, max(512, n_vectors // 24))))
    # the length is part of the grid's key: only equal lengths can be multiplied
    q = queries.dropDuplicates(["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # identical rows are counted first (k copies can't be outdone by more), so that no shard grows with them
    vectors = vectors.groupBy("vec_id", "v").count().select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int"))).alias("copy"))
    v = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["block", "shard", "dim"]
    q = q.withColumn("dim", F.size("v")).select(*keys, "vec_id", "v")
    v = v.select("block", "shard", F.size("v").alias("dim"), F.col("vec_id").alias("id"), F.col("v").alias("x"))  # names of its own: both sides come from one table
    lists = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(_tile(k), "query_id long, vec_id long, score long, shard int")
    order = [F.desc("score"), F.asc("vec_id")]
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).filter(F.col("rank") <= k)
        shards = -(-shards // FAN)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector of embeddings against all others."""
    rows = integer_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    queries = rows.filter(F.col("vec_id") % 50 == 0)
    n = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 50 == 0)).first()
    return search(queries, rows, 5, n[1], n[0])


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

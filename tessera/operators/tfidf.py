"""Sparse TF-IDF features as long tables, and cosine search over them.

Features of words (n-grams of 1 and 2) are many times their text, so they are neither kept nor shuffled: documents are kept as the 64-bit hashes of their words
in order, and features, known by hashes too, are made from these where they are. For document frequencies, documents stand in blocks; the hashes of a block's different
features go to parts by their range, where they are summed up, and the sums alone go back to the blocks, in the features' order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import ranked
from ..functions.text import words_of
from ..storage import stored

#: Bytes of text in a part in which features are counted (about): their counts fit in a task's memory, however large the input.
PART = 4 << 20
#: Words in a block of documents, features (with repeats) in a part of the hashes' range (about).
BLOCK, RANGE = 500_000, 4_000_000
#: Flags that say which features queries may hold.
BITS = 1 << 22


def dealt(docs: DataFrame) -> DataFrame:
    """docs dealt out by item, in parts of about PART bytes of text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return docs.repartition(max(spark.sparkContext.defaultParallelism, -(-size // PART)), "item_id")


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt out if a few large splits hold them all."""
    size, held = docs.select(F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("task")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("task")).first()
    return dealt(docs) if held < min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART)) else docs


def counts(docs: DataFrame, grams: Column) -> DataFrame:
    """(item_id, feature, tf) of an array column of features, and copies, how many items a row stands for, if docs has it.

    Texts are dealt out by item before they are cut, so the features, many times their size, are counted where they are.
    """
    keys = ["item_id", *(c for c in docs.columns if c == "copies")]
    return dealt(docs).select(*keys, F.explode(grams).alias("feature")).groupBy(*keys, "feature").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, n: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(feature, idf): smooth idf of the features in min_df documents at least and a share of max_df at most."""
    n_items = F.sum("copies") if "copies" in tf.columns else F.count("*")
    df = tf.groupBy("feature").agg(n_items.alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return df.select("feature", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(tf: DataFrame, vocabulary_: DataFrame, weight: float = 1.0, sublinear: bool = True) -> DataFrame:
    """(item_id, feature, weight)."""
    value = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    return tf.join(vocabulary_, "feature").select("item_id", "feature", (value * F.col("idf") * weight).alias("weight"))


def normalise(weights: DataFrame) -> DataFrame:
    """Weights with length 1 for each item; items without weight have no rows."""
    length = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weights.join(length.filter("length > 1e-8"), "item_id").select("item_id", "feature", (F.col("weight") / F.col("length")).alias("weight"))


def cosine_search(queries: DataFrame, items: DataFrame, top_k: int, digits: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of normalised (query_id, feature, weight) and (item_id, feature, weight) that share a feature."""
    q = queries.select("query_id", "feature", F.col("weight").alias("qw"))
    score = F.sum(F.col("qw") * F.col("weight"))
    scored = q.join(items, "feature").groupBy("query_id", "item_id").agg((F.round(score, digits) if digits else score).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc("item_id")], top_k)


def word_rows(docs: DataFrame, pattern: str, text: bool = False) -> DataFrame:
    """(item_id, hashes) of (item_id, text), a row an item: its words' 64-bit hashes in order; texts of one item stand apart by a 0. text adds words, with a null there."""
    docs = spread(docs)
    words = docs.select("item_id", words_of(F.col("text"), pattern).alias("words"))
    if not docs.groupBy("item_id").count().filter("count > 1").isEmpty():
        apart = F.flatten(F.collect_list(F.concat("words", F.array(F.lit(None).cast("string")))))
        words = words.groupBy("item_id").agg(apart.alias("words"))
    hashes = F.transform("words", lambda w: F.when(w.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(w)))
    return words.select("item_id", hashes.alias("hashes"), *(["words"] if text else []))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Features:
    """The features of rows of hashes: keys (their hashes, ascending), and of each row's different ones the row, the place in keys, the count, the first word's place, and whether it has two words."""

    def __init__(self, hashes: pa.Array):
        hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
        flat, sizes = hashes.flatten(), pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
        if pa.types.is_dictionary(flat.type):
            flat = flat.dictionary.take(flat.indices)
        h = flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        row, on = np.repeat(np.arange(len(sizes)), sizes), h != 0
        one, two = np.flatnonzero(on), np.flatnonzero(on[:-1] & on[1:] & (row[:-1] == row[1:]))
        at = np.concatenate([one, two])
        fids = np.concatenate([h[one], _mixed(_mixed(h[two] + np.uint64(0x9E3779B97F4A7C15)) ^ h[two + 1])])
        order = np.argsort(fids, kind="stable")  # so rows ascend within a feature
        fids, rows = fids[order], row[at[order]]
        new = np.append(True, fids[1:] != fids[:-1])[: len(fids)]
        start = np.flatnonzero(new | np.append(True, rows[1:] != rows[:-1])[: len(fids)])
        self.keys, self.code = fids[new], (np.cumsum(new) - 1)[start]
        self.row, self.tf, self.at, self.pair = rows[start], np.diff(np.append(start, len(fids))), at[order[start]], order[start] >= len(one)


def features(blocks: DataFrame, kind: str, name: str = "item_id", maybe: Broadcast | None = None) -> DataFrame:
    """(item_id, fid, tf) of in_blocks(), where item_id is of a kind and can be called otherwise; with a bitmap() those alone that it may hold."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _unpacked(it):
            f = _Features(t.column("hashes"))
            wanted = np.ones(len(f.keys), bool) if maybe is None else maybe.value[(f.keys & np.uint64(BITS - 1)).astype(np.int64)]
            on = np.flatnonzero(wanted[f.code])
            yield from pa.Table.from_arrays([t.column("item_id").take(pa.array(f.row[on])), pa.array(f.keys[f.code[on]].view(np.int64)), pa.array(f.tf[on])], [name, "fid", "tf"]).to_batches(1 << 16)

    return blocks.select("packed").mapInArrow(run, f"{name} {kind}, fid long, tf long")


def bitmap(asked: DataFrame) -> Broadcast:
    """BITS flags: whether a feature of asked (fid) ends in such bits. Of fixed size; what it lets pass still meets asked."""
    place = F.col("fid").bitwiseAND(F.lit(BITS - 1)) + 1
    held, rows = np.zeros(BITS // 8, np.uint8), asked.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).toLocalIterator()
    for k, b in rows:
        held[(k - 1) * len(b) : k * len(b)] = np.frombuffer(b, np.uint8)
    return asked.sparkSession.sparkContext.broadcast(np.unpackbits(held, bitorder="little").astype(bool))


def unpacked(blocks: DataFrame, kind: str) -> DataFrame:
    """The rows (item_id, hashes) of in_blocks()."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _unpacked(it):
            hashes = t.column("hashes").combine_chunks()
            flat = hashes.flatten()
            plain = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(hashes).to_numpy())), pa.int32()), flat.dictionary.take(flat.indices))
            yield from pa.Table.from_arrays([t.column("item_id"), plain], ["item_id", "hashes"]).to_batches(1 << 10)

    return blocks.select("packed").mapInArrow(run, f"item_id {kind}, hashes array<long>")


def _runs(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows with about most words together (one row at least)."""
    held, n = [], 0
    for batch in it:
        if not batch.num_rows:
            continue
        size, at = np.cumsum(pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = min(batch.num_rows, int(np.searchsorted(size, before + most - n)) + 1)
            held.append(batch.slice(at, to - at))
            n += int(size[to - 1]) - before
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict]]:
    """Each block's rows and its other columns."""
    for batch in it:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield pa.ipc.open_stream(row.pop("packed")).read_all(), row


def in_blocks(rows: DataFrame) -> DataFrame:
    """(block, n, packed, names): word_rows() in blocks of about BLOCK words, packed, and the block's different words if rows have them. Blocks get new names each time, so they are to be stored."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(it, BLOCK):
            hashes = t.column("hashes").combine_chunks()
            size = pc.list_value_length(hashes).to_numpy(zero_copy_only=False)
            own, first, code = np.unique(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_index=True, return_inverse=True)
            often = np.argsort(-np.bincount(code, minlength=len(own)), kind="stable")  # frequent words have small codes, which compress better
            own, first, code = own[often], first[often], np.argsort(often)[code]
            kind = pa.uint16() if len(own) <= 1 << 16 else pa.int32()
            coded = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.DictionaryArray.from_arrays(pa.array(code.astype(kind.to_pandas_dtype())), pa.array(own)))
            packed, names = _stream(pa.Table.from_arrays([t.column("item_id").combine_chunks(), coded], ["item_id", "hashes"])), None
            if "words" in t.column_names:
                names = _stream(pa.Table.from_arrays([t.column("words").combine_chunks().flatten().take(pa.array(first))], ["word"]))
            yield pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().hex]), "n": pa.array([int(size.sum())], pa.int64()), "packed": pa.array([packed], pa.binary()), "names": pa.array([names], pa.binary())})

    return rows.mapInArrow(run, "block string, n long, packed binary, names binary")


def _planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones and so on: small numbers leave planes of zeros, which the shuffle's compression takes away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def frequencies(blocks: DataFrame) -> DataFrame:
    """(block, part, found, fids, dfs) of in_blocks(): the document frequencies of a block's features in a part of the hashes' range, in their order; the row of block '' has all of the part's, the steps from one hash to the next and their frequencies, as planes."""
    parts = max(1, -(-2 * blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // RANGE))
    edges = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, other in _unpacked(it):
            f = _Features(t.column("hashes"))
            cuts, own = np.searchsorted(f.keys, edges), np.bincount(f.code, minlength=len(f.keys)).astype(np.uint32)
            steps = [_planes(np.diff(x, prepend=np.uint64(0))) for x in np.split(f.keys, cuts)]  # ascending, so their steps are smaller
            yield pa.RecordBatch.from_arrays([pa.array([other["block"]] * parts), pa.array(range(parts), pa.int32()), pa.array(steps, pa.binary()), pa.array([_planes(x) for x in np.split(own, cuts)], pa.binary())], ["block", "part", "fids", "dfs"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        code, keys = pd.factorize(np.concatenate([np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in group["fids"]]).view(np.int64))
        df = np.bincount(code, np.concatenate([_numbers(x, np.uint32) for x in group["dfs"]]), len(keys)).astype(np.int64)  # exact below 2**53
        found = np.split(df[code].astype(np.uint32), np.cumsum([len(x) // 8 for x in group["fids"]])[:-1])
        out = pd.DataFrame({"block": group["block"], "part": group["part"], "found": [_planes(x) for x in found], "fids": None, "dfs": None})
        order = np.argsort(keys.view(np.uint64))
        return pd.concat([out, pd.DataFrame({"block": [""], "part": [int(group["part"].iloc[0])], "found": [None], "fids": [_planes(np.diff(keys[order].view(np.uint64), prepend=np.uint64(0)))], "dfs": [_planes(df[order].astype(np.uint32))]})])

    rows = blocks.select("block", "packed").mapInArrow(split, "block string, part int, fids binary, dfs binary")
    return rows.groupBy("part").applyInPandas(add, "block string, part int, found binary, fids binary, dfs binary")


def idfs(found: DataFrame, n: int) -> DataFrame:
    """(fid, idf) of frequencies() among n items."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for fids, dfs in zip(*(batch.column(c).to_pylist() for c in ("fids", "dfs")), strict=True):
                keys = np.cumsum(_numbers(fids, np.uint64), dtype=np.uint64).view(np.int64)
                yield from pa.Table.from_arrays([pa.array(keys), pa.array(_numbers(dfs, np.uint32).astype(np.int64))], ["fid", "df"]).to_batches(1 << 16)

    each = found.filter("block = ''").select("fids", "dfs").mapInArrow(run, "fid long, df long")
    return each.select("fid", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _weighed(blocks: DataFrame, found: DataFrame, n: int, f: Callable[[pa.Table, dict, _Features, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """f of each block's rows, its other columns, the rows' features and the weights of these."""
    answers = found.filter("block <> ''").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "found"))).alias("answer"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, other in _unpacked(it):
            own, df = _Features(t.column("hashes")), np.concatenate([_numbers(x["found"], np.uint32) for x in other["answer"]])
            idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
            yield from f(t, other, own, (1 + np.log(own.tf)) * idf[own.code]).to_batches(1 << 16)

    return blocks.select("block", "packed", "names").join(answers, "block").drop("block").mapInArrow(run, schema)


def item_lengths(blocks: DataFrame, found: DataFrame, n: int, kind: str) -> DataFrame:
    """(item_id, length) of the weights of the items in blocks, of which there are n; items without weight have no row."""

    def run(t: pa.Table, other: dict, own: _Features, weight: np.ndarray) -> pa.Table:
        length = np.sqrt(np.bincount(own.row, weight * weight, t.num_rows))
        keep = np.flatnonzero(length > 1e-8)
        return pa.Table.from_arrays([t.column("item_id").take(pa.array(keep)), pa.array(length[keep])], ["item_id", "length"])

    return _weighed(blocks, found, n, run, f"item_id {kind}, length double")


def word_weights(docs: DataFrame, pattern: str) -> DataFrame:
    """(item_id, feature, weight) of (item_id, text): n-grams of 1 and 2 words by their text, not normalised."""
    kind, n = docs.schema["item_id"].dataType.simpleString(), docs.count()
    blocks = stored(in_blocks(word_rows(docs, pattern, text=True)), "blocks")

    def run(t: pa.Table, other: dict, own: _Features, weight: np.ndarray) -> pa.Table:
        names, none = pa.ipc.open_stream(other["names"]).read_all().column("word").combine_chunks().cast(pa.large_string()), pa.scalar("", pa.large_string())
        words = names.take(pc.list_flatten(t.column("hashes")).combine_chunks().indices)
        after = words.take(pa.array(np.where(own.pair, own.at + 1, own.at)))
        second = pc.if_else(pa.array(own.pair), pc.binary_join_element_wise(none, after, pa.scalar(" ", pa.large_string())), none)
        feature = pc.binary_join_element_wise(words.take(pa.array(own.at)), second, none)
        return pa.Table.from_arrays([t.column("item_id").take(pa.array(own.row)), feature.cast(pa.string()), pa.array(weight)], ["item_id", "feature", "weight"])

    return _weighed(blocks, stored(frequencies(blocks), "frequencies"), n, run, f"item_id {kind}, feature string, weight double")


@dataclass
class TfidfIndex:
    """blocks of documents whose item_id is of a kind, vocabulary (fid, idf), lengths (item_id, length) of word TF-IDF, n-grams of 1 and 2 words; features are hashes and made when blocks are read.

    Weights are made when they are met, from the idf that a query's feature brings along, so documents that come or go rewrite no rows.
    """

    blocks: DataFrame
    kind: str
    vocabulary: DataFrame
    lengths: DataFrame
    pattern: str

    @classmethod
    def build(cls, docs: DataFrame, pattern: str) -> TfidfIndex:
        """From (item_id, text)."""
        kind, n = docs.schema["item_id"].dataType.simpleString(), docs.count()
        blocks = stored(in_blocks(word_rows(docs, pattern)), "blocks")
        found = stored(frequencies(blocks), "frequencies")
        return cls(blocks, kind, idfs(found, n), stored(item_lengths(blocks, found, n, kind), "lengths"), pattern)

    def search(self, queries: DataFrame, top_k: int, digits: int | None = None) -> DataFrame:
        """(query_id, item_id, score, rank) of (query_id, query_text) by cosine. Queries meet the features first, items' lengths only what was found."""
        # stored, so that its size is known: a small batch of queries goes to the features, not these to it
        texts = word_rows(queries.select(F.col("query_id").alias("item_id"), F.col("query_text").alias("text")), self.pattern)
        asked = stored(features(in_blocks(texts), queries.schema["query_id"].dataType.simpleString(), "query_id"), "asked")
        q = asked.join(self.vocabulary, "fid").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
        length = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qlength")).filter("qlength > 1e-8")
        q = stored(q.select("query_id", "fid", (F.col("weight") * F.col("idf")).alias("qw")), "asked")
        found = q.join(features(self.blocks, self.kind, maybe=bitmap(q)), "fid").groupBy("query_id", "item_id").agg(F.sum(F.col("qw") * (1 + F.log("tf"))).alias("dot"))
        score = F.col("dot") / (F.col("qlength") * F.col("length"))
        scored = found.join(length, "query_id").join(self.lengths, "item_id").select("query_id", "item_id", (F.round(score, digits) if digits else score).alias("score"))
        return ranked(scored, ["query_id"], [F.desc("score"), F.asc("item_id")], top_k)

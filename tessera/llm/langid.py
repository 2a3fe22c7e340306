"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary classifier over byte n-grams (2 and 3 bytes, hashed) says
how much the text looks like the languages whose bit is 1. Its weight for an n-gram is the log ratio of the n-gram's mean
probability under the languages of either side, from counts over all training rows (summed on the executors; the driver
sees one count a language and bucket, whatever the corpus). Decoding adds, for each codeword, the logistic loss of
the bits' margins, weighted by how well each classifier separates its sides, and takes the least; texts whose two best codewords lie
closer than AMBIGUOUS are flagged.

Defined results: texts that are null or have no letter are 'und' with score 0, not ambiguous; without any labelled
training text all are 'und'; with one language all others are that language with score 1; ties go to the language first in order; more than LANGS values of lang
are an error; rows with a null doc_id are not held out; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from .common import U64, batches_by_bytes, mapped, table, text_buffers

#: Buckets of hashed n-grams (bucket 0 stands for none), smoothing, scale of the margins, least gap of losses, bits a log2 of many languages.
BUCKETS, SMOOTH, SCALE, AMBIGUOUS, RATE = 1 << 15, 0.5, 4.0, 0.05, 10
#: Values of lang at most (a table of BUCKETS counts each, in a task and on the driver); more are an error.
LANGS = 1000
_STEP, _FIX = 1 << 17, 1 << 14
#: A-Z lower-cased; other ASCII than letters counts as a space.
_FOLD = np.array([b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 5 languages; beyond, the best-spread of some seeded dense codes."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 if i == n - 1 or not c >> i & 1 else -1 for c in columns] for i in range(n)], float)
    bits, best = int(RATE * np.ceil(np.log2(n))), (-1, None)
    for seed in range(50):
        code = np.random.default_rng(seed).integers(0, 2, (n, bits)) * 2.0 - 1
        apart = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if apart > best[0] and (np.abs(code.sum(0)) < n).all():
            best = (apart, code)
    return best[1]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids): buckets of the 2- and 3-grams that begin at each byte of a stretch, 0 for those that leave their document."""
    n = len(data)
    for at in range(0, n, _STEP):
        to = min(n, at + _STEP)
        b = np.full(to - at + 2, 32, np.uint32)
        b[: min(n, to + 2) - at] = _FOLD[data[at : min(n, to + 2)]]
        x = b[:-2] | b[1:-1] << np.uint32(8)
        ids = np.empty((2, to - at), np.int32)
        for row, v in ((0, x), (1, x | b[2:] << np.uint32(16) | np.uint32(1 << 24))):
            h = v.astype(U64) * U64(0x9E3779B97F4A7C15)
            ids[row] = (h >> U64(40)).astype(np.int64) % (BUCKETS - 1) + 1
        ends = offsets[1:]
        ends = ends[(ends > at) & (ends <= to + 1)] - at
        for row, back in ((0, (1,)), (1, (1, 2))):
            for k in back:
                cut = ends - k
                ids[row, cut[(cut >= 0) & (cut < to - at)]] = 0
        yield at, ids


def training_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over docs' text and lang, summed in each task first."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches_by_bytes(it, "text"):
            data, offsets = text_buffers(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                mine = np.flatnonzero(langs == lang)
                part = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in mine])
                offs = np.concatenate([[0], np.cumsum(offsets[mine + 1] - offsets[mine])])
                sums = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                if len(total) > LANGS:
                    raise ValueError(f"more than {LANGS} different languages")
                for _, ids in grams(part, offs):
                    sums += np.bincount(ids.ravel(), minlength=BUCKETS)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            at = at[at > 0]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return mapped(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """langs, code (languages x bits), weights (buckets x bits, fixed point) and trust (bits)."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        p = np.array([(counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BUCKETS) for x in self.langs]).reshape(len(self.langs), BUCKETS)
        bits = self.code.shape[1]
        w, self.trust = np.zeros((bits, BUCKETS)), np.zeros(bits)
        for b in range(bits):
            yes, no = p[self.code[:, b] > 0].mean(0), p[self.code[:, b] < 0].mean(0)
            w[b] = np.log(yes) - np.log(no)
            self.trust[b] = ((yes - no) * w[b]).sum()  # the sides' symmetric divergence
        w[:, :1] = 0
        self.weights = np.rint(w * _FIX).astype(np.int32)
        self.trust /= self.trust.sum() or 1

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of a document's n-grams for each bit; 0 for documents without n-grams."""
        docs, bits = len(offsets) - 1, len(self.weights)
        sums, n = np.zeros((docs, bits), np.int64), np.zeros(docs, np.int64)
        for at, ids in grams(data, offsets):
            to = at + ids.shape[1]
            first, last = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, to, "left")) - 1
            which = np.arange(first, last + 1)
            which = which[offsets[which + 1] > np.maximum(offsets[which], at)]
            starts = np.maximum(offsets[which], at) - at
            for row in ids:
                n[which] += np.add.reduceat(row > 0, starts, dtype=np.int64)
                for b in range(bits):
                    sums[which, b] += np.add.reduceat(self.weights[b][row], starts, dtype=np.int64)
        return sums / _FIX / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the codeword with the least weighted loss, its share of exp(-loss), and whether the next is close."""
        loss = (np.logaddexp(0, -SCALE * margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        near = np.exp(-SCALE * (loss - loss.min(1, keepdims=True)))
        score = 1 / near.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(best), bool)
        rows = np.arange(len(best))
        return best, score, loss[rows, order[:, 1]] - loss[rows, best] < AMBIGUOUS


def fit(docs: DataFrame) -> Model:
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in training_counts(docs).toLocalIterator():
        counts.setdefault(lang, np.zeros(BUCKETS))[bucket] = n
        if len(counts) > LANGS:
            raise ValueError(f"more than {LANGS} different languages")
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (its text column and any others) with lang_pred, score and ambiguous, which replace columns of those names."""
    docs = docs.drop("lang_pred", "score", "ambiguous", "_letter")
    kept = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    given = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, not the corpus

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches_by_bytes(it, "text"):
            letter = np.array(batch.column("_letter").to_pylist(), bool) & bool(m.langs)
            if m.langs:
                best, value, close = m.decode(m.margins(*text_buffers(batch.column("text"))))
                names = [m.langs[i] if ok else "und" for i, ok in zip(best, letter, strict=True)]
            else:
                names, value, close = ["und"] * len(letter), np.zeros(len(letter)), letter
            columns = [batch.column(c) for c in batch.schema.names if c != "_letter"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names), pa.array(np.where(letter, value, 0.0)), pa.array(close & letter)], [*(c for c in batch.schema.names if c != "_letter"), "lang_pred", "score", "ambiguous"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    return mapped(kept, score, schema)


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text leaves 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = fit(docs.filter("NOT held_out AND doc_id IS NOT NULL"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")

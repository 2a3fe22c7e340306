"""Phrase collocations: n-grams as rows, counted by language, cut at their weakest place, absorbed by longer ones, ranked.

Texts are lower-cased (A-Z), split at PIECE_END into pieces and those into words; every n-gram of 1 to max_n words within a piece becomes a
row (language, phrase, occurrences), counted within its batch by Arrow, by Spark within its task, and over all tasks after one shuffle. A candidate joins
the counts of its first k words and of the rest for every cut k, is scored in Decimal, goes if a candidate one word longer keeps enough of its occurrences
(one word is enough: what lies between a phrase and a much longer one that holds it occurs at least as often as the longer), and is
ranked within its language, first within parts of the language's phrases and then over the parts' best.

All n-grams of a corpus are many times its size, nearly all of them rare. A phrase occurs at most as often as its words and its pairs of neighbours, so
words are counted first, then the hashes of pairs of frequent words, those of longer n-grams all of whose pairs are frequent, and at last the phrases that came through. What is frequent is
known by bitmaps of a fixed size (BITS), which like the hashes say yes too often and never no too often, so counts are exact at any fill; a full bitmap costs rows alone.

Defined results: a null text is empty and adds nothing; a null language is UND, together with rows that say so; repeated rows count each; scores tie by occurrences and then
by the phrase's bytes; languages without candidates and empty tables give no rows; other columns are ignored. A piece has to fit in a worker; texts are
cut between pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, batches_by_bytes, discard, mapped, mix, stored, table, text_buffers, word_hashes

#: Words of the longest phrase, occurrences of a candidate, rows a language, scale of the score, per cent of occurrences that absorb.
MAX_N, LEAST, TOP, SCALE, SHARE = 4, 30, 2000, 2_000_000, 80
#: Bits of a map of frequent keys (8 MB), parts of a language's phrases in the first ranking, bytes of text handled at once.
BITS, PARTS, STEP = 1 << 26, 64, 1 << 20
UND = "und"
#: Kinds of bytes: of a word, between words, at the end of a piece.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*PIECE_END]] = 2


def _cut(data: np.ndarray, offsets: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first row): the texts, those above step bytes in parts that end with a piece."""
    big = np.flatnonzero(np.diff(offsets) > step)
    at = 0
    for k in [*big.tolist(), len(offsets) - 1]:
        if at < k:
            yield data[offsets[at] : offsets[k]], offsets[at : k + 1] - offsets[at], at
        if k < len(offsets) - 1:
            text = data[offsets[k] : offsets[k + 1]]
            begin = 0
            while begin < len(text):
                end = min(begin + step, len(text))
                while end < len(text):
                    last = np.flatnonzero(_KIND[text[begin:end]] == 2)
                    if len(last):
                        end = begin + int(last[-1]) + 1
                        break
                    end = min(end + step, len(text))
                yield text[begin:end], np.array([0, end - begin]), k
                begin = end
        at = k + 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words, lower-cased, each with a space after it; where each begins in that (and where the last ends); its piece; its text."""
    wide = np.insert(data, offsets[1:], 10)  # texts end pieces too
    kind = _KIND[wide]
    on = kind == 0
    before = np.concatenate([[False], on[:-1]])
    first = np.flatnonzero(on & ~before)
    keep = on | before
    flat = np.where(on, LOWER[wide], np.uint8(32))[keep]
    starts = np.append((np.cumsum(keep) - 1)[first], len(flat))
    return flat, starts, np.cumsum(kind == 2)[first], np.searchsorted(offsets + np.arange(len(offsets)), first, "right") - 1


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _key(hashes: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Keys of 40 bits: what they save in the shuffle is more than the rows cost that come through by equal keys."""
    out = seeds
    for h in hashes:
        out = mix(out * U64(0x9E3779B97F4A7C15) + h)
    return out & U64((1 << 40) - 1)


def _bits(key: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = U64(len(bitmap) * 8 - 1)
    return (key & last).astype(np.int64), ((mix(key) >> U64(9)) & last).astype(np.int64)


def _in(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    a, b = _bits(key, bitmap)
    return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)


def word_keys(words: DataFrame) -> DataFrame:
    """(key): the keys of (lang, phrase) of one word each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs = b.column("lang").dictionary_encode()
            seeds = np.array([_seed(x) for x in langs.dictionary.to_pylist()], U64)[langs.indices.to_numpy()]
            key = _key([word_hashes(*text_buffers(b.column("phrase")), fold=False)[0]], seeds)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return mapped(words.select("lang", "phrase"), run, "key long")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of (key); as large for any number of rows."""
    size = BITS

    def set_(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(size >> 3, np.uint8)
        for b in it:
            for bits in _bits(b.column("key").to_numpy().view(U64), bitmap):
                np.bitwise_or.at(bitmap, bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
        cells = bitmap.view(np.int64)
        at = np.flatnonzero(cells)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], ["cell", "bits"])

    cells = mapped(keys, set_, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out.view(np.uint8)


class _Texts:
    """The words of a batch's texts, with what tells n-grams from each other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, seeds: np.ndarray):
        self.flat, self.starts, piece, text = words_of(data, offsets)
        self.n, self.code = len(piece), codes[text]
        self.seed = seeds[self.code]
        self.with_next = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        return word_hashes(self.flat, np.array([0, len(self.flat)]), fold=False)[0]

    def pair_keys(self, words: np.ndarray) -> np.ndarray:
        """Keys of all pairs of neighbours in one piece whose words are in the map."""
        h = self.hashes()
        known = _in(words, _key([h], self.seed))
        at = np.flatnonzero(self.with_next & known[1:] & known[:-1])
        return _key([h[at], h[at + 1]], self.seed[at])

    def join_pairs(self, pairs: np.ndarray) -> None:
        """From here on only neighbours in the map go together."""
        h, at = self.hashes(), np.flatnonzero(self.with_next)
        self.with_next[at] = _in(pairs, _key([h[at], h[at + 1]], self.seed[at]))

    def whole(self, size: int) -> np.ndarray:
        """Whether an n-gram of a size begins at each word."""
        ok = np.ones(self.n, bool)
        for k in range(size - 1):  # words k and k + 1 after the first go together
            ok[: max(self.n - 1 - k, 0)] &= self.with_next[k:]
            ok[max(self.n - 1 - k, 0) :] = False
        return ok

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the n-grams of a size."""
        h, at = self.hashes(), np.flatnonzero(self.whole(size))
        return at, _key([h[at + k] for k in range(size)], self.seed[at])

    def grams(self, size: int, longer: np.ndarray | None = None) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
        """(codes of languages, phrases with a space after them) of the n-grams of a size; those of three words or more have to be in a map, if one is given."""
        ok = self.whole(size)
        if size > 2 and longer is not None:
            at, key = self.keys(size)
            ok[at] = _in(longer, key)
        buffer, ends = pa.py_buffer(np.ascontiguousarray(self.flat)), self.starts.astype(np.int32)
        phrases, codes = [], []
        for phase in range(min(size, self.n)):  # n-grams that begin at every size-th word lie end to end in the buffer
            edges = np.ascontiguousarray(ends[phase::size])
            m = len(edges) - 1
            if m > 0:
                on = ok[phase::size][:m]
                phrases.append(pa.StringArray.from_buffers(m, pa.py_buffer(edges), buffer).filter(pa.array(on)))
                codes.append(pa.array(self.code[phase::size][:m][on]))
        return pa.chunked_array(codes, pa.int32()), pa.chunked_array(phrases, pa.string())


def _parsed(it: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[pa.Array, _Texts]]:
    """(languages by code, texts) of batches of (lang, text), cut to bounded bytes."""
    for b in batches_by_bytes(it, "text", step):
        langs = b.column("lang").dictionary_encode()
        names, codes = langs.dictionary, langs.indices.to_numpy().astype(np.int32)
        seeds = np.array([_seed(x) for x in names.to_pylist()], U64)
        for data, offsets, first in _cut(*text_buffers(b.column("text")), step):
            yield names, _Texts(data, offsets, codes[first:], seeds)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ngram_counts(docs: DataFrame, sizes: tuple[int, ...], pairs: Broadcast | None = None, longer: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, f): occurrences of the n-grams of these sizes of (lang, text); with the map pairs, of those alone whose neighbours are in it, and with longer of those of three words or more that are in it."""
    step = STEP

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, t in _parsed(it, step):
            if pairs is not None and t.n > 1:
                t.join_pairs(pairs.value)
            for size in sizes:
                if t.n < size:
                    continue
                codes, phrases = t.grams(size, longer.value if longer is not None else None)
                found = pa.table({"lang": codes, "phrase": phrases}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                if found.num_rows:
                    phrase = pc.utf8_slice_codeunits(found.column("phrase"), 0, -1)  # without the last space
                    whole = pa.table({"lang": names.take(found.column("lang").combine_chunks()), "phrase": phrase, "f": found.column("count_all")})
                    yield from whole.to_batches(max_chunksize=1 << 15)

    return mapped(_rows(docs), run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_keys(docs: DataFrame, sizes: tuple[int, ...], least: int, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """(key) of the n-grams of these sizes whose words, or neighbours, are in a map and whose keys occur least times: all frequent ones, and such whose keys are the same."""
    step = STEP

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _parsed(it, step):
            if pairs is not None and t.n > 1:
                t.join_pairs(pairs.value)
            for size in sizes:
                if t.n >= size:
                    key, n = np.unique(t.pair_keys(words.value) if words is not None else t.keys(size)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return mapped(_rows(docs), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of 1 to max_n words that occur least times, (lang, n) of all words). Both are stored."""
    spark = docs.sparkSession
    every = stored(ngram_counts(docs, (1,)), "words")
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    enough = lambda df, words: df.filter(F.col("f") >= least).select("lang", words.cast("int").alias("words"), "phrase", "f")
    parts = [stored(enough(every, F.lit(1)), "frequent")]
    discard(every)
    if max_n >= 2:
        send = lambda keys: spark.sparkContext.broadcast(bitmap_of(keys))
        words = send(word_keys(parts[0]))
        pairs = send(frequent_keys(docs, (2,), least, words))
        longer = send(frequent_keys(docs, tuple(range(3, max_n + 1)), least, None, pairs)) if max_n > 2 else None
        size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
        parts.append(stored(enough(ngram_counts(docs, tuple(range(2, max_n + 1)), pairs, longer), size), "frequent"))
        for b in (words, pairs, longer):
            if b is not None:
                b.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, totals


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, words, phrase, a, score, k, l, r) of the phrases of two words or more: the cut of the lowest score, of equal ones the first."""
    cuts = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = F.expr(f"cast({scale} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", exact)
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.*")


def absorbed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) that stand within a phrase one word longer which has share per cent of their occurrences or more."""
    longer = counts.filter("words > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    enough = F.expr(f"cast(100 as decimal(3, 0)) * cast(most as decimal(20, 0)) >= cast({share} as decimal(3, 0)) * cast(f as decimal(20, 0))")
    return counts.filter("words > 1").join(most, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, scale: int = SCALE, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, k): each language's top phrases of 2 to max_n words of (lang, text)."""
    counts, totals = frequent(docs, max_n, least)
    left = scored(counts, scale).join(absorbed(counts, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    left = left.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents by language."""
    return collocations(table(spark, sf_dir, "documents")).drop("k")


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(x, '[ \t]+'), lambda y: y <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)
), g AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL
), c AS (
  SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE words > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) c
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, i, unnest(range(i + 1, words + 1)) AS j, words FROM (SELECT *, unnest(range(1, words)) AS i FROM c))
  WHERE j - i + 1 < words GROUP BY ALL
)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS BIGINT) AS rank,
       b.phrase, a, l, r, n, score
FROM best b JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE words = 1 GROUP BY lang) USING (lang)
LEFT JOIN parts USING (lang, phrase)
WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000
"""

"""Near duplicates by MinHash with tensored banding, every link confirmed on full shingle sets.

A document's set holds the hashes of its distinct WORDS-word shingles. Two collections of TUPLES short tuples (ROWS minhashes each) are
computed; a table (i, j) is keyed by the pair of tuple i of the first and tuple j of the second collection, so 2 * TUPLES
tuples serve TUPLES**2 tables: a pair of documents meets if any tuple of either collection agrees. At similarity 0.8 that misses 1 pair
in 15 million (1 - 0.8**3 to the 24th power, twice), and fewer above.

Equal sets are folded into one first, so copies cost nothing further. Then links are looked for where components still differ:
the first FIRST**2 tables compare each bucket's members with its head, its smallest id, which joins most families; after that only
tuples shared by several components key the tables, and heads differ from tuple to tuple, so that members of a loose family are held
against several others. Members of buckets that even then span several components besides the head's go through an exact prefix filter
among themselves, so no link in a bucket is lost unless its ends are connected already. Sets are computed again from the text
for documents in such pairs only: a bit map of a fixed size tells which, and an exact join drops the few others. A head's set stands
once before a run of its partners' sets, many runs for a head of many, and streams past them. Components come from label passing
with pointer jumps over the confirmed links, all on the executors.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; shorter texts are one shingle of all their words; null or
wordless texts have an empty set and are linked with nothing; rows with a null doc_id are not linked either (component_id
null, not kept); repeated ids are one document if their texts are equal and share a component in any case where one of them does;
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches_by_bytes, discard, mapped, mix, stored, table, text_buffers, word_hashes

#: Words in a shingle (contract of the query), tuples in a collection, minhashes in a tuple, tuples of either collection that key the first tables.
WORDS, TUPLES, ROWS, FIRST = 4, 24, 3, 6
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: log2 of the bits in the map of wanted documents (2 MB); partners of a head that its set is sent along with once; orders by which heads are chosen; size bands to an octave; parts of a key's rows.
MAP_BITS, RUN, ORDERS, BANDS, SALT = 24, 512, 8, 8, 8
_rng = np.random.default_rng(20240501)
_MULT = _rng.integers(0, 1 << 31, 2 * TUPLES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, 2 * TUPLES * ROWS, dtype=np.uint32)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Each document's distinct shingles, as sorted hashes."""
    h, n, _, _ = word_hashes(data, offsets)
    at = np.concatenate([[0], np.cumsum(n)])
    full = np.zeros(max(len(h) - words + 1, 0), U64)
    for k in range(words if len(full) else 0):
        full += h[k : k + len(full)] * _PLACE[k]
    full = mix(full + U64(words))
    out = []
    for i, m in enumerate(n):
        if m >= words:
            out.append(np.unique(full[at[i] : at[i] + m - words + 1]))
        elif m:
            out.append(mix((h[at[i] : at[i + 1]] * _PLACE[:m]).sum(dtype=U64, keepdims=True) + U64(m)))
        else:
            out.append(np.zeros(0, U64))
    return out


def tuples(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """2 * TUPLES keys for each of the sets that begin at starts in values (none empty)."""
    keys = np.zeros((2 * TUPLES, len(starts)), U64)
    short, h = (values >> U64(32)).astype(np.uint32), np.empty(len(values), np.uint32)
    for k, (m, x) in enumerate(zip(_MULT, _XOR, strict=True)):
        np.bitwise_xor(short, x, out=h)
        np.multiply(h, m, out=h)
        keys[k // ROWS] += mix(np.minimum.reduceat(h, starts).astype(U64)) * _PLACE[k % ROWS]
    return mix(keys + (np.arange(2 * TUPLES, dtype=U64) * _PLACE[ROWS])[:, None]).T


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, keys): size and fingerprint of the set and its tuple keys."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(it, "text", 2 << 20):
            sets = shingle_sets(*text_buffers(batch.column("text")), words)
            n = np.array([len(s) for s in sets], np.int64)
            some, keys = np.flatnonzero(n), [[]] * len(n)
            fp = np.zeros((2, len(n)), U64)
            if len(some):
                values = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                for i, k in zip(some, tuples(values, starts).view(np.int64), strict=True):
                    keys[i] = k
                for row, p in enumerate(_PLACE[-2:]):
                    fp[row, some] = np.add.reduceat(mix(values * p), starts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(f.view(np.int64)) for f in fp), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "keys"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def _fits(a: str, b: str) -> Column:
    """Sizes that allow the least similarity."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def repeated(sets: DataFrame) -> DataFrame:
    """(id, n, place, tuple): the tuples that occur in more than one set; no others can bring a pair together."""
    single = sets.select("id", "n", F.posexplode("keys").alias("place", "tuple"))
    again = single.groupBy("tuple").count().filter("count > 1").select("tuple")
    return single.join(again, "tuple").select("id", "n", "place", "tuple")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """rows (with id) whose key has several components; rows of one key meet it in SALT parts."""
    keys = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    keys = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(keys, [key, "salt"]).drop("salt")


def buckets(tuples: DataFrame, few: bool = False) -> DataFrame:
    """(key, id, n, comp, by): members of table buckets that span several components; by orders the members.

    few: the first FIRST**2 tables only.
    """
    if few:
        tuples = tuples.filter(F.col("place") % TUPLES < FIRST)
    hit = _several(tuples, "tuple").groupBy("id", "n", "comp").agg(F.collect_list(F.struct("place", "tuple")).alias("hit"))  # 2 * TUPLES at most
    hit = hit.withColumn("u", F.filter("hit", lambda x: x["place"] < TUPLES)).withColumn("v", F.filter("hit", lambda x: x["place"] >= TUPLES))
    keyed = hit.select("id", "n", "comp", F.explode("u").alias("u"), "v").select("id", "n", "comp", "u", F.explode("v").alias("v"))
    by = F.col("id") if few else F.xxhash64("id", F.col("u.place") % ORDERS)
    return _several(keyed.select("id", "n", "comp", by.alias("by"), F.xxhash64("u.tuple", "v.tuple").alias("key")), "key").select("key", "id", "n", "comp", "by")


def star(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): each bucket's head, the first in its order, with its members of other components whose sizes allow a link.

    And (id, n, comp): the members of buckets that hold several components besides the head, which this leaves open.
    """
    heads = members.groupBy("key").agg(F.min(F.struct("by", "id", "n", "comp")).alias("head")).select("key", F.col("head.id").alias("a"), F.col("head.n").alias("hn"), F.col("head.comp").alias("hc"))
    others = members.join(heads, "key").filter(F.col("id") != F.col("a"))
    pairs = others.filter((F.col("comp") != F.col("hc")) & _fits("n", "hn")).select("a", F.col("id").alias("b")).distinct()
    return pairs, _several(others, "key").select("id", "n", "comp").distinct()


def mixed_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, n, comp, own, set): the different sets of ids (id, n, comp); an id may have several, told apart by own."""
    sets = wanted_sets(docs, ids.select("id").distinct(), words).withColumn("n", F.size("set").cast("long")).join(ids, ["id", "n"])
    return sets.withColumn("own", F.xxhash64("set")).dropDuplicates(["id", "own"]).select("id", "n", "comp", "own", "set")


def rest(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(a, b): all pairs that can be linked of members (id, n, comp) of different components."""
    return possible(stored(mixed_sets(docs, members.select("id", "n", "comp").distinct(), words), "mixedsets"))


def _band(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * BANDS)


def possible(sets: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components among sets (id, n, comp, own, set) that the exact prefix filter lets through.

    With its shingles in order of their count, rare ones first, a set can reach the least similarity only with sets that share
    one of its first n - ceil(LEAST * n) + 1 shingles; and what is left of the set from a pair's first common shingle on bounds the
    intersection, hence the size of the partner. So rows meet by shingle and by band of size: documents that vary a common text
    hold many rare shingles, the common ones come late, little is left there, and no partner is small enough; such rows send nothing.
    At each shingle the component with most rows is only searched, so a large family and few others meet in as many pairs as the others' rows times
    all, not the family's with itself. It is exact, whatever the size of a bucket.
    """
    shingles = sets.select("id", "n", "comp", "own", F.explode("set").alias("shingle"))
    counted = shingles.join(shingles.groupBy("shingle").count(), "shingle")
    first = F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]) + 1 - F.col("alone")
    some = counted.groupBy("id", "n", "comp", "own").agg(F.count_if(F.col("count") == 1).alias("alone"), F.collect_list(F.when(F.col("count") > 1, F.struct("count", "shingle"))).alias("shared"))
    some = some.filter((first > 0) & (F.size("shared") > 0)).select("id", "n", "comp", "alone", F.posexplode(F.slice(F.array_sort("shared"), F.lit(1), first.cast("int"))).alias("at", "s"))
    left = F.col("n") - F.col("alone") - F.col("at")
    # intersection >= LEAST / (1 + LEAST) * both sizes, so a partner has most shingles at the most
    rows = some.select("id", "n", "comp", F.floor(left * (LEAST[0] + LEAST[1]) / LEAST[0] - F.col("n")).alias("most"), F.col("s.shingle").alias("shingle"))
    rows = rows.filter(F.col("most") >= F.ceil(F.col("n") * LEAST[0] / LEAST[1]))
    rows = stored(rows, "prefixes")
    of = rows.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("large"), F.count("*").alias("comps")).filter("comps > 1").select("shingle", "large")
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # rows of a hot shingle meet it in parts
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(of, ["shingle", "salt"]).drop("salt")
    low, high = F.ceil(F.col("n") * LEAST[0] / LEAST[1]), F.least("most", F.floor(F.col("n") * LEAST[1] / LEAST[0]))
    asking = rows.filter(F.col("comp") != F.col("large")).select("shingle", "id", "n", "comp", "most", F.explode(F.sequence(_band(low), _band(high))).alias("band"))
    asked = rows.select("shingle", _band(F.col("n")).alias("band"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("most").alias("most2"))
    pairs = asking.join(asked, ["shingle", "band"]).filter((F.col("comp") != F.col("comp2")) & _fits("n", "n2") & (F.col("n2") <= F.col("most")) & (F.col("n") <= F.col("most2")))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _bit(x):
    return F.pmod(F.xxhash64(x), F.lit(1 << MAP_BITS))


def wanted_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set): sets of the documents of ids and few others; a document may come more than once."""
    cells = ids.select(_bit("id").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits"))
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.int64)  # its size doesn't depend on the rows
    for cell, bits in cells.toLocalIterator():
        bitmap[cell] = bits
    given = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = given.value
        for batch in it:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            on = (bitmap[bit >> 6] >> (bit & 63) & 1).astype(bool)
            if on.any():
                yield from compute(batch.filter(pa.array(on)))

    def compute(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(iter([batch]), "text", 1 << 20):
            sets = shingle_sets(*text_buffers(part.column("text")), words)
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate([np.zeros(0, U64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL").withColumn("bit", _bit("id"))
    return mapped(rows, pick, "id long, set array<long>")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a list column laid end to end, and their ends with a 0 before."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(U64), offsets - offsets[0]


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows with a b whose set is as similar as LEAST says to that of the row without b before them."""
    head = np.zeros(0, U64)
    for batch in it:
        (values, at), b = _values(batch.column("set")), batch.column("b")
        tops, keep = np.append(np.flatnonzero(np.asarray(b.is_null())), batch.num_rows), np.zeros(batch.num_rows, bool)
        for start, stop in zip(np.append(0, tops[:-1] + 1), tops, strict=True):  # partners of one head
            if start < stop and len(head):
                part = values[at[start] : at[stop]]
                hit = head[np.minimum(np.searchsorted(head, part), len(head) - 1)] == part
                common = np.diff(np.append(0, np.cumsum(hit))[at[start : stop + 1] - at[start]])
                keep[start:stop] = (common > 0) & (LEAST[1] * common >= LEAST[0] * (len(head) + np.diff(at[start : stop + 1]) - common))
            if stop < batch.num_rows:
                head = values[at[stop] : at[stop + 1]].copy()
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in "ab"], ["a", "b"]).filter(pa.array(keep))


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of ids whose sets are as similar as LEAST says; sets (id, own, set), where at hand, hold all of theirs."""
    pairs = stored(pairs, "pairs")
    if sets is None:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        found = stored(wanted_sets(docs, ids, words).join(ids, "id").withColumn("own", F.xxhash64("set")).dropDuplicates(["id", "own"]), "sets")
    else:
        found = sets
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).alias("runs"))
    runs = runs.join(found.select(F.col("id").alias("a"), "own"), "a")
    partners = pairs.join(runs, "a").select("a", "own", F.pmod(F.xxhash64("b"), "runs").alias("run"), "b")
    partners = partners.join(found.select(F.col("id").alias("b"), "set"), "b").select("a", "own", "run", "b", "set")
    heads = found.withColumnRenamed("id", "a").join(runs, ["a", "own"]).select("a", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("b"), "set")
    keys = ["a", "own", "run"]
    both = heads.unionByName(partners).repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first())
    links = stored(mapped(both.select("a", "b", "set"), _linked, "a long, b long").distinct(), "links")
    discard(*([pairs] if sets is not None else [pairs, found]))
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links (a, b); comp is the least id that can be reached."""
    both = stored(links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y"), "edges")
    labels = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("comp").alias("near"))
        new = labels.join(near, labels.id == near.x).select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        new = stored(new.join(jump, "next").select("id", F.least("next", "far").alias("comp"), "old"), "labels")
        discard(labels)
        labels = new.select("id", "comp")
        labels.stored_at = new.stored_at
        if new.filter("comp <> old").isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each of docs."""
    sig = stored(signatures(docs, words), "signatures")
    print_ = ["fp1", "fp2", "n_shingles"]
    some = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = stored(some.groupBy(*print_).agg(F.min("doc_id").alias("id"), F.any_value("keys").alias("keys")), "distinct")
    tuples = stored(repeated(sets.select("id", F.col("n_shingles").alias("n"), "keys")), "tuples")
    first = stored(buckets(tuples.withColumn("comp", F.col("id")), few=True), "buckets")
    links = confirmed(docs, star(first)[0], words)
    labels = components(links)
    of = lambda rows: rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    every = stored(buckets(of(tuples)), "buckets")
    discard(first, tuples)
    links = links.unionByName(confirmed(docs, star(every)[0], words))
    discard(labels)
    labels = components(links)
    open_ = stored(star(of(every.drop("comp")))[1], "open")
    discard(every)
    left = stored(mixed_sets(docs, open_, words), "mixedsets")
    links = links.unionByName(confirmed(docs, possible(left), words, left))
    discard(labels, open_, left)
    labels = components(links)
    of_set = sets.select(*print_, "id").join(labels, "id", "left").select(*print_, F.coalesce("comp", "id").alias("component_id"))
    out = sig.select("doc_id", *print_).join(of_set, print_, "left")
    # texts of one id are one document: their components are the same
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, by the contract's four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))

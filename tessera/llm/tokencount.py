"""Token counts that follow edits: a segment tree of pre-tokens a document, byte-level BPE inside.

Texts are cut into pre-tokens (the tokenizer's pattern, by array operations over the code points), each distinct one is encoded once and its
count remembered (bounded). A document's tree has buckets of pre-tokens as leaves and sums of characters, pre-tokens and tokens
above. An edit finds its leaves by the sums, splits again only the text it touches, with CONTEXT characters
before it, until a boundary falls on an old one, encodes what is new and updates the sums on the way to the root: a pre-token depends
on nothing before its start and on two characters after its end.

Trees are rows of a table (TREE): a batch of edits loads those of the documents it touches, as they are, and writes them a version on
(TreeStore). Counts of all others are read from their roots.

Defined results: null and empty texts have no tokens; edits beyond the text's end are cut to it; special tokens' strings are ordinary
text; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ROW_GROUP, read_text, write_text
from .common import U64, batches_by_bytes, mapped, powers, stored, strong, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf when a tree is built and at most; characters read again before an edit; remembered pre-tokens at most.
BUCKET, FULL, CONTEXT, SLOTS = 32, 128, 4, 500_000
# White space of the pattern, and the pattern itself.
_WHITE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_SPLIT = regex.compile(PATTERN)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def boundaries(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens, and the total length, of texts laid end to end (code points; ends: their ends)."""
    n = len(chars)
    kind = _classes()[chars]
    first = np.zeros(n + 1, bool)
    first[0] = first[ends] = first[n] = True
    cut = first.copy()
    a, b, blank = kind[:-1], kind[1:], chars == 32
    white = kind == _SPACE
    cut[1:n] |= (a != b) & ~(white[:-1] & blank[:-1])  # a blank belongs to what follows
    # the last white space of a run that something follows stands apart
    lone = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    cut[lone] = True
    quote = np.flatnonzero((chars[:-1] == 39) & cut[: n - 1])
    if len(quote):
        room = np.append(ends, n)[np.searchsorted(ends, quote, "right")] - quote
        at = lambda k: np.where(room > k, chars[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long_ = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((short, 2), (long_, 3)):
            q = quote[which]
            cut[q + 1] = False
            cut[q + size] = True
    return np.flatnonzero(cut)


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, path_or_raw: str | bytes):
        raw = path_or_raw if isinstance(path_or_raw, bytes) else open(path_or_raw, "rb").read()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, int] = {}
        self.named: dict[str, int] = {}

    def one(self, token: str) -> int:
        n = self.named.get(token)
        if n is None:
            if len(self.named) > SLOTS:
                self.named.clear()
            n = self.named[token] = len(self.encoding.encode_ordinary(token))
        return n

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and count of every pre-token of texts, and where each text's begin (texts + 1)."""
        whole = "".join(t for t in texts if t)
        ends = np.cumsum([len(t) if t else 0 for t in texts])
        if not whole:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = boundaries(chars, ends)
        starts, lengths = bounds[:-1], np.diff(bounds)
        p, q = powers(len(chars) + 1)
        c = np.zeros(len(chars) + 1, U64)
        np.cumsum((chars + np.uint32(1)).astype(U64) * p[: len(chars)], out=c[1:])
        key = ((c[bounds[1:]] - c[bounds[:-1]]) * q[starts]) ^ (lengths.astype(U64) << U64(1))
        key = strong(key, starts, bounds[1:], chars)
        codes, keys = pd.factorize(key.view(np.int64))
        if len(self.known) > SLOTS:
            self.known.clear()
        counts = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(counts < 0)
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            at, size = starts[first[new]].tolist(), lengths[first[new]].tolist()
            encode = self.encoding.encode_ordinary
            counts[new] = [len(encode(whole[a : a + n])) for a, n in zip(at, size, strict=True)]
            self.known.update(zip(keys[new].tolist(), counts[new].tolist(), strict=True))
        return lengths, counts[codes], np.searchsorted(bounds, np.concatenate([[0], ends]))


class Tree:
    """A document's text and the segment tree over buckets of its pre-tokens. sums[k]: characters, pre-tokens and tokens below node k."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, counter: Counter):
        self.text, self.counter = text, counter
        self._build(lengths, counts)

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        n = -(-len(lengths) // BUCKET)
        self.leaves = 1 << max(0, n - 1).bit_length()
        starts = np.arange(n) * BUCKET
        level = np.zeros((self.leaves, 3), np.int64)
        if n:
            level[:n, 0] = np.add.reduceat(lengths, starts)
            level[:n, 1] = np.diff(np.append(starts, len(lengths)))
            level[:n, 2] = np.add.reduceat(counts, starts)
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros((1, 3), np.int64), *levels[::-1]])
        self._hold(lengths, counts)

    def _hold(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        self._lengths, self._counts, self._changed = lengths, counts, {}
        self._starts = np.concatenate([[0], np.cumsum(self.sums[self.leaves :, 1])])

    @classmethod
    def load(cls, text: str, lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, counter: Counter) -> Tree:
        """A tree as state() gave it; nothing is encoded or summed again."""
        tree = cls.__new__(cls)
        tree.text, tree.counter = text, counter
        tree.sums = np.array(sums, np.int64).reshape(-1, 3)
        tree.leaves = len(tree.sums) // 2
        tree._hold(lengths, counts)
        return tree

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and counts of all pre-tokens, and the sums, whose leaves say how many pre-tokens each has."""
        if self._changed:
            sizes, counts, at = [], [], 0
            for k in sorted(self._changed):
                a, b = self._starts[k : k + 2].tolist()
                sizes += [self._lengths[at:a], np.array(self._changed[k][0], np.int64)]
                counts += [self._counts[at:a], np.array(self._changed[k][1], np.int64)]
                at = b
            self._hold(np.concatenate([*sizes, self._lengths[at:]]), np.concatenate([*counts, self._counts[at:]]))
        return self._lengths, self._counts, self.sums

    def bucket(self, k: int) -> tuple[list[int], list[int]]:
        """Lengths and counts of bucket k's pre-tokens."""
        if k not in self._changed:
            a = slice(*self._starts[k : k + 2].tolist())
            return self._lengths[a].tolist(), self._counts[a].tolist()
        return self._changed[k]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def pretokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The bucket that holds a character, and the character at which it begins."""
        k, before = 1, 0
        while k < self.leaves:
            k *= 2
            if char >= before + (here := int(self.sums[k, 0])) and self.sums[k + 1, 0]:
                before, k = before + here, k + 1
        return k - self.leaves, before

    def edit(self, start: int, end: int, new: str) -> int:
        """text[start:end] becomes new; how many pre-tokens were encoded."""
        n = len(self.text)
        start, end = min(max(start, 0), n), min(max(end, start, 0), n)
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        b, at = self.find(max(0, start - CONTEXT))
        lengths, counts = self.bucket(b)
        # keep the bucket's pre-tokens before the one that holds the context's first character
        tail = list(accumulate(lengths, initial=at))
        keep = max(0, bisect_right(tail, max(0, start - CONTEXT)) - 1)
        keep = min(keep, len(lengths))
        head, begin = (lengths[:keep], counts[:keep]), tail[keep]
        last = b
        made, pos, room = [], begin, 64
        limit = start + len(new)
        while True:
            stop = min(len(self.text), max(pos, limit) + room)
            for m in _SPLIT.finditer(self.text, pos, len(self.text)):
                if m.end() > stop and stop < len(self.text) and m.end() > limit + room:
                    break
                made.append(m[0])
                pos = m.end()
                if pos >= limit and pos < len(self.text):
                    place = pos - shift  # where it would be in the old text
                    while tail[-1] < place:
                        last += 1
                        lengths, counts = self.bucket(last)
                        tail = list(accumulate(lengths, initial=tail[-1]))
                    k = bisect_left(tail, place)
                    if k < len(tail) and tail[k] == place:
                        return self._put(b, last, head, made, (lengths[k:], counts[k:]))
            if pos >= len(self.text):
                return self._put(b, self.leaves - 1, head, made, ([], []))
            room *= 4

    def _put(self, b: int, last: int, head: tuple, made: list[str], tail: tuple) -> int:
        """Buckets b to last become head, made and tail, in bucket b and, if there is a next, the last."""
        sizes, counts = [len(t) for t in made], [self.counter.one(t) for t in made]
        for k in range(b, last + 1):
            if self.sums[self.leaves + k, 1] or k == b:
                new = (head[0] + sizes, head[1] + counts) if k == b else ([], [])
                if k == last:
                    new = (new[0] + tail[0], new[1] + tail[1])
                self._changed[k] = new
                node = self.leaves + k
                path = [node >> up for up in range(node.bit_length())]
                self.sums[path] += np.array([sum(new[0]), len(new[0]), sum(new[1])]) - self.sums[node]
        if any(len(self._changed[k][0]) > FULL for k in (b, last) if k in self._changed):
            self._rebuild()
        return len(made)

    def _rebuild(self) -> None:
        self._build(*self.state()[:2])


_counters: dict[int, Counter] = {}


def counter_of(raw: bytes) -> Counter:
    """The process's counter of a vocabulary; it stays between tasks."""
    if hash(raw) not in _counters:
        _counters.clear()
        _counters[hash(raw)] = Counter(raw)
    return _counters[hash(raw)]


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """Three edits of a text of n characters: an insertion, a deletion and a replacement, at fixed shares of its length."""
    return [(n // 3, n // 3, " edit's"), (n // 2, n // 2 + 8, ""), (3 * n // 4, 3 * n // 4 + 5, "12  ab ")]


#: A kept tree: the document's version and counts, its text, and what Tree.state gives.
TREE = "doc_id long, version long, n_tokens long, n_pretokens long, text string, lengths array<int>, counts array<int>, sums array<int>"
_KEPT = ("lengths", "counts", "sums")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int32()))


def _columns(trees: list[Tree]) -> list[pa.Array]:
    """n_tokens, n_pretokens, text, lengths, counts and sums of trees."""
    states = [t.state() for t in trees]
    numbers = [pa.array([getattr(t, k) for t in trees], pa.int64()) for k in ("tokens", "pretokens")]
    return [*numbers, pa.array([t.text for t in trees], pa.string()), *(_lists([s[k].ravel() for s in states]) for k in range(3))]


def _vocabulary(df: DataFrame, ranks: str):
    return df.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())  # the vocabulary file, a fixed size


def trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """TREE rows of documents, version 0: a table to be kept, which edited() takes up."""
    raw = _vocabulary(docs, ranks)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(raw.value)
        for batch in batches_by_bytes(it, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            lengths, counts, offsets = counter.count(texts)
            made = [Tree(t or "", lengths[a:b], counts[a:b], counter) for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.zeros(len(made), np.int64)), *_columns(made)], names)

    names = [x.split()[0] for x in TREE.split(", ")]
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, TREE)


def edited(kept: DataFrame, edits: DataFrame | None = None, ranks: str = RANKS) -> DataFrame:
    """TREE rows of the touched documents alone, a version on, with before_tokens, before_pretokens and n_encoded.

    kept: TREE rows. edits: (doc_id, edits array<struct<start,end,text>>), characters of the text as the edits before left it, one row a
    document (more are an error; of repeated documents each is edited); without, standard_edits of every document.
    """
    raw, own = _vocabulary(kept, ranks), edits is not None
    if own:
        once = F.when(F.count("*") == 1, F.first("edits")).otherwise(F.raise_error(F.lit("a document has several rows of edits")))
        kept = kept.join(edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(once.alias("edits")), "doc_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(raw.value)
        for batch in batches_by_bytes(it, "text", 1 << 20):
            given = batch.column("edits").to_pylist() if own else None
            states = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in map(batch.column, _KEPT)]
            made, before, done = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tree = Tree.load(text, *(v[o[i] : o[i + 1]] for v, o in states), counter)
                before.append((tree.tokens, tree.pretokens))
                todo = standard_edits(len(text)) if given is None else [(e["start"], e["end"], e["text"]) for e in given[i] or []]
                done.append(sum(tree.edit(*e) for e in todo))
                made.append(tree)
            version = pa.array(batch.column("version").to_numpy() + 1)
            was = [pa.array(c, pa.int64()) for c in zip(*before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), version, *_columns(made), *was, pa.array(done, pa.int64())], names)

    schema = f"{TREE}, before_tokens long, before_pretokens long, n_encoded long"
    names = [x.split()[0] for x in schema.split(", ")]
    needed = ["doc_id", "version", "text", *_KEPT] + ["edits"] * own
    return mapped(kept.select(*needed), run, schema)


class TreeStore:
    """Trees of documents in a folder: a table of all, and for each batch of edits a table of the documents that it touched.

    A manifest names the tables in use and their batches; it is replaced in one step, so a batch that is replayed or fails adds nothing.
    Batches come one after another, from one writer.
    """

    def __init__(self, spark: SparkSession, root: str, ranks: str = RANKS):
        self.spark, self.root, self.ranks = spark, root.rstrip("/"), ranks

    def _manifest(self) -> list[list[str]]:
        return json.loads(read_text(self.spark, f"{self.root}/MANIFEST") or "[]")

    def _add(self, before: list[list[str]], batch: str, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{name}", compression="zstd")
        write_text(self.spark, f"{self.root}/MANIFEST", json.dumps([*before, [batch, name]]))

    def build(self, docs: DataFrame) -> None:
        """Trees of docs, instead of what there was."""
        self._add([], "", trees(docs, self.ranks))

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """TREE rows of the latest versions, of ids (doc_id) alone if given: only these are looked up in the tables."""
        names = [name for _, name in self._manifest()]
        if not names:
            raise LookupError("no trees are kept")
        every = self.spark.read.schema(TREE).parquet(*(f"{self.root}/{n}" for n in names))
        if ids is not None:
            every = every.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if len(names) == 1:
            return every
        last = every.groupBy(F.col("doc_id").alias("_id")).agg(F.max("version").alias("_last"))
        return every.join(last, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_last")), "left_semi")

    def apply(self, batch: str, edits: DataFrame) -> bool:
        """Edits (as edited takes them) of a batch; False, and nothing done, if it was applied before. Ids without a tree are left out."""
        before = self._manifest()
        if batch in [b for b, _ in before]:
            return False
        rows = edited(self.current(edits), edits, self.ranks)
        self._add(before, batch, rows.select(*(x.split()[0] for x in TREE.split(", "))))
        return True

    def counts(self) -> DataFrame:
        """(doc_id, version, n_tokens, n_pretokens): read from the trees' roots, no text is opened."""
        return self.current().select("doc_id", "version", "n_tokens", "n_pretokens")


def count_with_edits(docs: DataFrame, edits: DataFrame | None = None, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, edited_tokens, edited_pretokens, n_encoded) of all documents, before and after the edits, in order.

    The trees are kept as a table first; edits are those of edited(), and documents without any stay as they are.
    """
    kept = stored(trees(docs, ranks), "trees", "zstd")
    new = edited(kept, edits, ranks)
    renamed = {"before_tokens": "n_tokens", "before_pretokens": "n_pretokens", "n_tokens": "edited_tokens", "n_pretokens": "edited_pretokens"}
    out = new.select("doc_id", *(F.col(a).alias(b) for a, b in renamed.items()), "n_encoded")
    if edits is None:
        return out
    rest = kept.join(edits.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
    same = rest.select("doc_id", "n_tokens", "n_pretokens", F.col("n_tokens").alias("edited_tokens"), F.col("n_pretokens").alias("edited_pretokens"), F.lit(0).cast("long").alias("n_encoded"))
    return out.unionByName(same)


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after three edits of each, from kept trees."""
    return count_with_edits(table(spark, sf_dir, "documents"))

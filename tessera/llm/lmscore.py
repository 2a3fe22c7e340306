"""Scores of whole texts under a unigram of words (the base) and a causal self-attention model of subwords.

Words are those of the contract, A-Z lower-cased. Subwords are byte-level BPE ids by the first MERGES ranks of a public
vocabulary; a word is encoded with a space before it and ends at most every 64 characters. The model (attention.py) begins in numpy on the
driver with START windows at most, from anywhere in about SAMPLE training documents. Then it follows all windows (one in EVERY, which is 1) of all
training documents, each once: in each of ROUNDS, parts of the windows go on from the same weights, and the mean of the parts' weights by their
windows is where the next round begins. Windows overlap by half and more, so what is kept and shuffled are runs of them, as the ids alone. Parts are
made by the runs' hashes, so scores don't depend on how the input is split; a task sends one set of weights for all parts that it followed.

A text is a row of words and one end. Under the attention model, given that a word or the end is to begin, a word has the probability of its subwords and of a
next begin after them, so the words and the end are disjoint and sum to 1; their shares of all training tokens sum to 1 too, and
a word's probability is a mixture (MIX) of both. Subwords that begin a word are those with the space, and have classes of their own in the model,
so the probability of a begin costs a sum over classes.

Word counts cover all training documents. A block of documents is written as one row with its texts and its distinct words (64-bit
hashes, sorted). The distinct words go to parts of the hash, where totals are made and sent back to the blocks, which are scored
then; so what moves grows with the texts and the blocks' vocabularies, and no task holds the corpus's.

Defined results: null and empty texts are the end token alone; a null doc_id is neither held out nor learnt from; without
training documents N and V are 0 and the base is 0 a token; repeated rows are learnt and scored each; other columns are ignored.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import STRIDE, WIDTH, Attention
from .common import LOWER, SEP, U64, batches_by_bytes, discard, mapped, mix, stored, table, text_buffers, word_hashes
from .langid import held_out

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Ranks used, remembered words at most, bytes of text in a block, words in a part.
MERGES, SLOTS, BLOCK, PART = 8099, 400_000, 2 << 20, 400_000
#: Training documents and windows at most that training begins with; of the windows of all training documents, one in EVERY is followed.
SAMPLE, START, EVERY = 1500, 150_000, 1
#: Rounds of following, windows of a part in a round at most (about); windows of a run at most.
ROUNDS, SHARE, RUN = 3, 5000, 32
#: Groups of parts whose weights go through the shuffle in a round, unless a group had more parts than MOST.
GROUPS, MOST = 16, 64
#: Weight of the words' shares.
MIX = 0.3
#: Bytes of a stretch that training draws, and of the text before it that fills its first windows; id of the end.
STRETCH, BEFORE = 148, 176
END = 0


class Subwords:
    """Words to ids, remembered. Ids: the end, the subwords that begin with a space, up to a whole class, and then the others."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        ranks = {k: v for k, v in ranks.items() if v < MERGES}
        # a word comes with its space; the pattern cuts it every 64 characters
        self.coding = tiktoken.Encoding("own", pat_str=r" [^ ]{0,63}|[^ ]{1,64}", mergeable_ranks=ranks, special_tokens={})
        begins = np.zeros(MERGES, bool)
        self.n_bytes, self.ids = np.zeros(MERGES, np.int64), np.zeros(MERGES, np.int16)
        for k, v in ranks.items():
            begins[v], self.n_bytes[v] = k[:1] == b" ", len(k)
        self.first = -(-(1 + int(begins.sum())) // WIDTH)
        self.ids[begins] = 1 + np.arange(begins.sum())
        self.ids[~begins] = self.first * WIDTH + np.arange((~begins).sum())
        self.n = self.first * WIDTH + int((~begins).sum())
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.start, self.size, self.pool, self.held = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int16), 0

    def of(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Slots of distinct words, given by hash and place in data."""
        if len(self.slots) + len(keys) > SLOTS:
            self._clear()
        slots = np.array([self.slots.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            ids, sizes = self._encode(starts[new], ends[new], data)
            slot = len(self.slots) + np.arange(len(new))
            self.slots.update(zip(keys[new].tolist(), slot.tolist(), strict=True))
            slots[new] = slot
            for name, need in (("start", slot[-1] + 1), ("size", slot[-1] + 1), ("pool", self.held + len(ids))):
                held = getattr(self, name)
                if need > len(held):
                    setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
            self.start[slot], self.size[slot] = self.held + np.cumsum(sizes) - sizes, sizes
            self.pool[self.held : self.held + len(ids)] = ids
            self.held += len(ids)
        return slots

    def _encode(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at data[starts:ends], each after a space, and how many each has."""
        size = ends - starts + 1
        to = np.cumsum(size)
        spot = np.arange(to[-1]) - np.repeat(to - size - starts + 1, size)
        joined = LOWER[data.take(spot, mode="clip")]
        joined[to - size] = 32
        got = self.coding.encode_to_numpy(joined.tobytes().decode(), disallowed_special=()).astype(np.int64)
        return self.ids[got], np.diff(np.searchsorted(np.cumsum(self.n_bytes[got]), to, "right"), prepend=0)

    def texts(self, column: pa.Array, closed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(ids, ends, distinct words, which of them stands where, words of each text, subwords of each word); every text, or those that are closed, ends with END."""
        data, offsets = text_buffers(column)
        h, n, s, e = word_hashes(data, offsets)
        codes, keys = pd.factorize(h.view(np.int64))
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        slots = self.of(keys, s[first], e[first], data)
        mine = slots[codes]
        size = self.size[mine]
        to = np.cumsum(size)
        at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - size - self.start[mine], size)
        ends = np.concatenate([[0], to])[np.cumsum(n)]
        closed = np.ones(len(n), bool) if closed is None else closed
        return np.insert(self.pool[at], ends[closed], END).astype(np.int64), ends + np.cumsum(closed), keys, codes, n, size


_known: dict[int, Subwords] = {}


def subwords_of(raw: bytes) -> Subwords:
    """The process's encoder of a vocabulary; it stays between tasks."""
    if hash(raw) not in _known:
        _known.clear()
        _known[hash(raw)] = Subwords(raw)
    return _known[hash(raw)]


def untrained(ranks: str) -> Attention:
    words = subwords_of(open(ranks, "rb").read())
    return Attention(words.n, words.first)


class Model:
    """The attention model, begun with windows (inputs, valid, target) in the order of keys; the weight of word shares; windows followed since."""

    def __init__(self, windows: Sequence[np.ndarray], keys: Sequence[int], ranks: str = RANKS):
        self.attention, self.mix, self.followed = untrained(ranks), MIX, 0
        if len(keys):
            order = np.argsort(keys, kind="stable")
            self.attention.train_windows(*(z[order] for z in windows))

    def scores(self, ids: np.ndarray, ends: np.ndarray, shares: np.ndarray, end: float, codes: np.ndarray, n: np.ndarray, size: np.ndarray, tables: dict) -> np.ndarray:
        """log10 probability of each text, by its words and end; shares (of the distinct words) and end are log10 shares, -inf if never learnt."""
        full = np.insert(size, np.cumsum(n), 1)  # subwords of each word and end
        start = np.cumsum(full) - full
        token, begin = self.attention.score_and_begin(ids, ends, tables)
        after = np.append(begin[start[1:]], 0.0)
        after[np.cumsum(n + 1) - 1] = 0.0  # nothing is to begin after the end
        word = np.add.reduceat(token, start) - begin[start] + after
        share = np.insert(shares[codes], np.cumsum(n), end)
        if end > -np.inf:
            with np.errstate(divide="ignore"):
                word = np.logaddexp(share * np.log(10) + np.log(self.mix), word * np.log(10) + np.log(1 - self.mix)) / np.log(10)
        return np.add.reduceat(word, np.cumsum(n + 1) - n - 1)


def stretches(column: pa.Array, docs: np.ndarray, share: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A share of all stretches of STRETCH bytes of the texts, with some text before them, at word boundaries: texts, whether a text begins and ends there, and keys.

    Whether a stretch is one depends on its document's id and its place alone. Its windows score about as many bytes as it has.
    """
    data, offsets = text_buffers(column)
    count = np.maximum(-(-np.diff(offsets) // STRETCH), 1)
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    key = mix(mix(docs.view(U64)[text] + U64(9)) + nth.astype(U64))
    phase = (mix(docs.view(U64) + U64(5)) >> U64(11)) / 2.0**53
    chosen = (phase[text] + nth * share) % 1.0 < share  # evenly over a text, from a place of its own
    text, nth, key = text[chosen], nth[chosen], key[chosen]
    out, first, last = [], np.zeros(len(text), bool), np.zeros(len(text), bool)
    for i, (k, at) in enumerate(zip(text.tolist(), (nth * STRETCH).tolist(), strict=True)):
        raw = data[offsets[k] : offsets[k + 1]]
        a, z = max(0, at - BEFORE), min(len(raw), at + STRETCH)
        while z < len(raw) and not SEP[raw[z]]:
            step = np.flatnonzero(SEP[raw[z : z + STRETCH]])
            z = z + int(step[0]) if len(step) else min(len(raw), z + STRETCH)
        if a:
            gap = np.flatnonzero(SEP[raw[a:z]])
            a = a + int(gap[0]) if len(gap) else z
        first[i], last[i] = a == 0, z == len(raw)
        out.append(raw[a:z].tobytes())
    return pa.array(out, pa.binary()), first, last, key


def drawn(attention: Attention, words: Subwords, batch: pa.RecordBatch, share: float) -> tuple[np.ndarray, ...]:
    """(inputs, valid, target, key) of the windows of a share of the stretches of (doc_id, text), wherever they stand in a text."""
    part, first, last, key = stretches(batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), share)
    ids, ends, *_ = words.texts(part, last)
    at, text = attention.starts(ends)
    spot = at - np.concatenate([[0], ends[:-1]])[text] if len(ends) else at
    # a window is taken if all that it sees and scores is there, but for where the text itself begins or ends
    good = (first[text] | (spot >= 2 * STRIDE)) & (last[text] | (ends[text] - at >= STRIDE)) if len(ends) else np.zeros(0, bool)
    at, text, spot = at[good], text[good], spot[good]
    return *attention.windows(ids, ends, at, text), attention.targets(ids, at), mix(key[text] + spot.astype(U64))


def begin(training: DataFrame, ranks: str = RANKS) -> Model:
    """A model of START windows at most of about SAMPLE training documents, chosen by hashes."""
    n, place = training.select("doc_id").count(), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40))
    near = stored(training.filter(place < int((1 << 40) * min(1.0, SAMPLE / max(n, 1)))).select("doc_id", "text"), "sample")
    size = near.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    share = min(1.0, START * STRIDE / max(size, 1))  # a subword has a byte at least
    given = training.sparkSession.sparkContext.broadcast((untrained(ranks), open(ranks, "rb").read()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(it, "text"):
            x, valid, target, key = drawn(given.value[0], subwords_of(given.value[1]), batch, share)
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (x.astype(np.int16), valid, target.astype(np.int16), key)], ["x", "valid", "target", "key"])

    rows = list(mapped(near.select("doc_id", "text"), run, "x binary, valid binary, target binary, key binary").toLocalIterator())
    x, valid, target, key = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in enumerate((np.int16, bool, np.int16, U64)))
    shaped = [x.reshape(len(key), -1).astype(np.int64), valid.reshape(len(key), -1), target.reshape(len(key), -1).astype(np.int64)] if len(key) else []
    return Model(shaped, key, ranks)


def runs(attention: Attention, training: DataFrame, ranks: str, every: int) -> DataFrame:
    """(key, head, n, ids): n consecutive windows (RUN at most) of a text as one row, one run in every of all training documents. Stored.

    The ids are those that the windows see and score, each once, compressed; head of them stand before the first scored one: all, or as many as a window sees. The key is made of the document's id, the place and the ids.
    """
    given = training.sparkSession.sparkContext.broadcast((attention, open(ranks, "rb").read()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, words, size = zstandard.ZstdCompressor(3), subwords_of(given.value[1]), RUN * STRIDE
        for batch in batches_by_bytes(it, "text", BLOCK):
            ids, ends, *_ = words.texts(batch.column("text"))
            begin, docs = np.concatenate([[0], ends[:-1]]).astype(np.int64), batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            count = -(-(ends - begin) // size)
            text = np.repeat(np.arange(len(ends)), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            phase = (mix(docs + U64(5)) >> U64(11)) / 2.0**53
            chosen = (phase[text] + nth / every) % 1.0 < 1 / every  # evenly over a text, from a place of its own
            text, nth = text[chosen], nth[chosen]
            at = begin[text] + nth * size
            to, head = np.minimum(at + size, ends[text]), np.minimum(at - begin[text], STRIDE + 1)
            raw = [ids[x:y].astype(np.int16).tobytes() for x, y in zip((at - head).tolist(), to.tolist(), strict=True)]
            marks = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest()) for x in raw], U64)
            key = mix(mix(mix(docs[text] + U64(9)) + nth.astype(U64)) ^ marks)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(head, pa.int32()), pa.array(-(-(to - at) // STRIDE), pa.int32()), pa.array([pack.compress(x) for x in raw], pa.binary())], ["key", "head", "n", "ids"])

    return stored(mapped(training.select("doc_id", "text"), run, "key long, head int, n int, ids binary"), "runs")


def in_windows(attention: Attention, key: np.ndarray, head: np.ndarray, n: np.ndarray, packed: Sequence[bytes]) -> tuple[np.ndarray, ...]:
    """(inputs, valid, target, key) of the windows of runs, in the order of their keys."""
    unpack = zstandard.ZstdDecompressor()
    raw = [unpack.decompress(x) for x in packed]
    ids, ends = np.frombuffer(b"".join(raw), np.int16).astype(np.int64), np.cumsum([len(x) // 2 for x in raw])
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at, own = (np.concatenate([[0], ends[:-1]]) + head)[run] + STRIDE * nth, mix(key.view(U64)[run] + nth.astype(U64))
    order = np.argsort(own, kind="stable")
    at, run = at[order], run[order]
    return *attention.windows(ids, ends, at, run), attention.targets(ids, at), own[order]


def followed_windows(attention: Attention, training: DataFrame, ranks: str, every: int) -> DataFrame:
    """(key, x, valid, target): the windows of runs(), a row each."""
    given = training.sparkSession.sparkContext.broadcast(attention)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x, valid, target, key = in_windows(given.value, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "head", "n", "ids")))
                rows = ([z.tobytes() for z in many] for many in (x.astype(np.int16), valid, target.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(z, pa.binary()) for z in rows)], ["key", "x", "valid", "target"])

    return mapped(runs(attention, training, ranks, every), run, "key long, x binary, valid binary, target binary")


def follow(model: Model, training: DataFrame, ranks: str = RANKS) -> None:
    """Rounds over one run of windows in EVERY of all training documents: each part of a round goes on from the same weights, and their mean by windows is where the next round begins.

    Parts are made by the runs' hashes and as many as the windows fill, and a part takes its windows in the hashes' order, so the weights don't depend on how the input is split.
    A task follows the parts of a group one after the other and sends their mean alone.
    """
    held = runs(model.attention, training, ranks, EVERY)
    parts = max(1, -(-(held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // (ROUNDS * SHARE)))
    groups = max(min(parts, GROUPS), -(-parts // MOST))
    spot = F.pmod(F.xxhash64("key"), F.lit(ROUNDS * parts))
    windows = held.withColumns({"round": (spot % ROUNDS).cast("int"), "part": F.floor(spot / ROUNDS).cast("int")}).withColumn("group", F.col("part") % groups)
    names = sorted(model.attention.w)
    schema, pack = "part int, n long, w binary", lambda w: np.concatenate([w[k].ravel() for k in names]).astype(np.float32)

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * n for n, w in zip(group["n"], group["w"], strict=True))
        n = int(group["n"].sum())
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "n": [n], "w": [(total / n).astype(np.float32).tobytes()]})

    def taught(given: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            total, n = 0.0, 0
            for _, part in group.groupby("part"):  # ascending
                m = copy.deepcopy(given.value)
                x, valid, target, _ = in_windows(m, *(part[c].to_numpy() for c in ("key", "head", "n", "ids")))
                k = m.follow(iter([(x, valid, target)]))
                total, n = total + pack(m.w).astype(np.float64) * k, n + k
            return pd.DataFrame({"part": [int(group["group"].iloc[0])], "n": [n], "w": [(total / n).astype(np.float32).tobytes()]})

        return run

    for number in range(ROUNDS):
        given = training.sparkSession.sparkContext.broadcast(model.attention)
        rows = windows.filter(F.col("round") == number).drop("round").groupBy("group").applyInPandas(taught(given), schema)
        for few in (64, 4) if groups > 64 else (4,):  # however many groups there are, the driver gets four rows
            rows = rows.groupBy(F.pmod("part", F.lit(few)).alias("few")).applyInPandas(mean, schema)
        means = pd.DataFrame(list(map(tuple, rows.toLocalIterator())), columns=["part", "n", "w"])
        given.unpersist()
        if len(means):
            flat, at = np.frombuffer(mean(means)["w"].iloc[0], np.float32), 0
            for k in names:
                old = model.attention.w[k]
                model.attention.w[k], at = flat[at : at + old.size].reshape(old.shape).copy(), at + old.size
            model.followed += int(means["n"].sum())
    discard(held)


def fit(training: DataFrame, ranks: str = RANKS) -> Model:
    """A model of training documents (doc_id, text)."""
    model = begin(training, ranks)
    follow(model, training, ranks)
    return model


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents: ids, texts (compressed) and their bytes by document; words (hashes) and their training counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches_by_bytes(it, "text", BLOCK):
            data, offsets = text_buffers(batch.column("text"))
            h, n, _, _ = word_hashes(data, offsets)
            codes, keys = pd.factorize(h.view(np.int64))
            held = np.array(batch.column("held_out").to_pylist(), bool)
            learnt = ~held & ~np.asarray(batch.column("doc_id").is_null())
            counts = np.bincount(codes[np.repeat(learnt, n)], minlength=len(keys))
            one = lambda x, kind: pa.array([x], kind)
            # words stand by the part of the hash they go to: parts are ranges of the hash
            order = np.argsort(keys.view(U64))
            yield pa.RecordBatch.from_arrays(
                [one(uuid.uuid4().hex, pa.string()), one(batch.column("doc_id").to_pylist(), pa.list_(pa.int64())), one(held, pa.list_(pa.bool_())), one(np.diff(offsets), pa.list_(pa.int64())), one(int(learnt.sum()), pa.int64()), one(len(keys), pa.int64()), one(keys[order].tobytes(), pa.binary()), one(counts[order].astype(np.int64).tobytes(), pa.binary()), one(pack.compress(data.tobytes()), pa.binary())],
                ["block", "doc_ids", "held", "sizes", "learnt", "n_words", "words", "counts", "texts"],
            )

    return mapped(docs, run, "block string, doc_ids array<long>, held array<boolean>, sizes array<long>, learnt long, n_words long, words binary, counts binary, texts binary")


def totals(read: DataFrame, parts: int) -> DataFrame:
    """(block, part, total binary, v, n): training counts of a block's words in a part, in their order; block '' has the part's V and N."""

    edges = np.array([k * 2**64 // parts for k in range(1, parts)], U64)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                w, c = np.frombuffer(words, U64), np.frombuffer(counts, np.int64)
                cuts = np.searchsorted(w, edges)
                w, c = np.split(w, cuts), np.split(c, cuts)
                yield pa.RecordBatch.from_pydict({"block": [block] * parts, "part": pa.array(range(parts), pa.int32()), "words": pa.array([x.tobytes() for x in w], pa.binary()), "counts": pa.array([x.tobytes() for x in c], pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in group["words"]]
        w = np.frombuffer(b"".join(group["words"]), np.int64)
        c = np.frombuffer(b"".join(group["counts"]), np.int64)
        codes, keys = pd.factorize(w)
        total = np.bincount(codes, c, len(keys)).astype(np.int64)  # exact below 2**53
        parts_ = np.split(total[codes], np.cumsum(sizes)[:-1])
        out = pd.DataFrame({"block": group["block"], "part": group["part"], "total": [x.tobytes() for x in parts_], "v": 0, "n": 0})
        sums = pd.DataFrame({"block": [""], "part": [int(group["part"].iloc[0])], "total": [b""], "v": [int((total > 0).sum())], "n": [int(total.sum())]})
        return pd.concat([out, sums])

    rows = mapped(read.select("block", "words", "counts"), split, "block string, part int, words binary, counts binary")
    return rows.groupBy("part").applyInPandas(add, "block string, part int, total binary, v long, n long")


def score(docs: DataFrame, model: Model, ranks: str = RANKS) -> DataFrame:
    """The contract's columns for (doc_id, text, held_out)."""
    read = stored(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")), "blocks")
    entries, learnt = read.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0))).first()
    parts = max(8, -(-entries // PART))
    back = stored(totals(read, parts), "totals")
    v, n = back.filter("block = ''").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, n = v + (learnt > 0), n + learnt  # the end token
    answers = back.filter("block <> ''").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "total"))).alias("answer"))  # parts rows a block

    given, raw = docs.sparkSession.sparkContext.broadcast(model), docs.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def base(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, unpack, floor = given.value, subwords_of(raw.value), zstandard.ZstdDecompressor(), np.log10(n + v + 1)
        tables = m.attention.prepared()
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in it for i in range(batch.num_rows)):
            offsets, data = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64), unpack.decompress(row["texts"])
            ids, ends, keys, codes, size, subwords = words.texts(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]))
            c = np.empty(len(keys), np.int64)
            c[np.argsort(keys.view(U64))] = np.frombuffer(b"".join(a["total"] for a in row["answer"]), np.int64)  # parts are ranges, so in the words' order
            with np.errstate(divide="ignore"):
                shares, end = np.log10(c / max(n, 1)), np.log10(learnt / max(n, 1))
            scores, stop = m.scores(ids, ends, shares, end, codes, size, subwords, tables), np.cumsum(size)
            at = lambda x: np.concatenate([[0], np.cumsum(x[codes])])  # noqa: B023, E731
            logs, known = at(np.log10(c + 1.0)), at((c > 0).astype(np.int64))
            sums = logs[stop] - logs[stop - size] + np.log10(learnt + 1.0) - (size + 1) * floor
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": size + 1, "n_known": known[stop] - known[stop - size] + int(learnt > 0), "train_tokens": np.full(len(size), n, np.int64), "base_score": sums, "score": pa.array(scores, pa.float64())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return mapped(read.select("block", "doc_ids", "held", "sizes", "texts").join(answers, "block"), base, schema)


def op8_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7))
    model = fit(docs.filter("NOT held_out AND doc_id IS NOT NULL").select("doc_id", "text"))
    return score(docs, model)

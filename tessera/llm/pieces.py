"""SentencePiece encoding and decoding by a streaming Viterbi over piece boundaries.

For every boundary the best piece that ends there is kept, over a window of the longest piece. In a unigram model best means the
highest sum of scores. In a BPE model a path survives if each two neighbouring pieces are what merging leaves of their joined text,
which holds for one path to each boundary: the merge result. Ids are committed whenever all paths that survive
in the window go through one boundary. Boundaries that no piece of the vocabulary spans (before a word's space, mostly) are such
points for certain, so texts are cut there, each distinct stretch is solved once, many side by side in numpy, and remembered
(bounded); stretches beyond LONG characters go through the plain stream.

The model's normaliser must be the identity (others are refused); a space is written before the text where the model says
so. Characters without a piece become their UTF-8 bytes' pieces, or the unknown id where the model has none.

Defined results: null and empty texts have no ids and decode to empty; texts decode to themselves but for U+2581, which decodes to a
space, and unknown ids of models without byte pieces; equal scores go to the longer last piece; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, batches_by_bytes, powers, strong, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a stretch is streamed; remembered stretches and ids at most.
LONG, SLOTS, POOL = 96, 400_000, 3_000_000
SPACE = "▁"


class Lookup:
    """An open-addressing hash map from uint64 (not 0) to int32 (-1: absent), read by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        for k, v, at in zip(keys.tolist(), values.tolist(), self._home(keys).tolist(), strict=True):
            while self.keys[at] and self.keys[at] != k:
                at = at + 1 & self.mask
            self.keys[at], self.values[at] = k, v

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """Vocabulary of a .model file and the tables of the lattice."""

    def __init__(self, raw: bytes):
        pieces, self.bpe, prefix, extra, name = [], False, True, True, "identity"
        for number, value in fields(raw):
            if number == 1:
                x = dict(fields(value))
                pieces.append((x[1].decode(), float(np.frombuffer(x.get(2, b"\0\0\0\0"), np.float32)[0]), x.get(3, 1)))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are read")
                self.bpe = kind == 2
            elif number == 3:
                x = dict(fields(value))
                prefix, extra, name = x.get(3, 1), x.get(4, 1), x.get(1, b"identity").decode()
        if name != "identity" or extra:
            raise ValueError("the model's normaliser changes texts")
        self.prefix = bool(prefix)
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == 6}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.score = np.array([p[1] for p in pieces])
        self.longest = max(map(len, self.ids))
        self.out = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        chars = sorted({c for p in self.ids for c in p})
        self.cls = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.spans = np.zeros((len(chars) + 1,) * 2, bool)
        for p in self.ids:
            k = self.cls[[ord(c) for c in p]]
            self.spans[k[:-1], k[1:]] = True
        self._hashes()
        if self.bpe:
            self._merges()

    def _hashes(self) -> None:
        self.base = [1]
        for _ in range(self.longest):
            self.base.append(self.base[-1] * 0x9E3779B97F4A7C15 % 2**64)
        keys = []
        for p in self.ids:
            h = 0
            for c in p:
                h = (h * self.base[1] + (int(self.cls[ord(c)]) + 1) * 0xBF58476D1CE4E5B9) % 2**64
            keys.append(h)
        self.table = Lookup(np.array(keys, U64), np.array(list(self.ids.values()), np.int32))

    def _merges(self) -> None:
        """Ranks of pieces, of pairs by what they join to, and the two parts that each piece is last merged from."""
        n = len(self.score)
        order = sorted(self.ids.values(), key=lambda i: -self.score[i])
        self.rank = np.full(n, -1, np.int32)
        rank, last = -1, None
        for i in order:
            rank += self.score[i] != last
            last = self.score[i]
            self.rank[i] = rank
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pairs = {k: int(self.rank[i]) for k, i in pairs.items()}
        self.pair_table = Lookup(np.array([(a + 1 << 24) + b for a, b in pairs], U64), np.array([self.rank[i] for i in pairs.values()], np.int32))
        self.whole = np.zeros(n, bool)  # merging its text leaves the piece itself
        for p, i in self.ids.items():
            parts = [self.ids.get(c, -1) for c in p]
            while len(parts) > 1:
                at = min((r, k) for k in range(len(parts) - 1) if (r := self.pairs.get((parts[k], parts[k + 1]), 1 << 30)) is not None)
                if at[0] == 1 << 30:
                    break
                k = at[1]
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[k : k + 2] = [pairs[parts[k], parts[k + 1]]]
            self.whole[i] = parts == [i]
        made = np.where(self.left >= 0, self.rank, -1)  # single characters are there from the start
        self.made = made.astype(np.int32)

    def follow(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when their joined text is merged.

        Goes back through the states in which parts of a and b touch, the later merge undone first: a merge across the boundary must
        not come before the merge that took the part away (of equal ranks, the left one comes first).
        """
        before = 1 << 30
        while True:
            if self.pairs.get((a, b), 1 << 30) < before:
                return False
            if self.made[a] < 0 and self.made[b] < 0:
                return True
            if self.made[a] > self.made[b]:
                before, a = int(self.made[a]), int(self.right[a])
            else:
                before, b = int(self.made[b]) + 1, int(self.left[b])

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follow, by arrays."""
        ok = np.ones(len(a), bool)
        at, before = np.arange(len(a)), np.full(len(a), 1 << 30)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            rank = self.pair_table.get(((a + 1 << 24) + b).astype(U64))
            bad = (rank >= 0) & (rank < before)
            ok[at[bad]] = False
            ma, mb = self.made[a], self.made[b]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            at, a, b, ma, mb = at[go], a[go], b[go], ma[go], mb[go]
            undo = ma > mb
            before = np.where(undo, ma, mb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def stream(self, text: Iterator[str]) -> Iterator[int]:
        """Ids of a text given in characters, in bounded memory."""
        tail, done = "", 0  # tail: text from the committed boundary on
        best: list[tuple[float, int, int] | None] = [(0.0, 0, -1)]  # of each boundary of tail: score, its piece's length, its piece
        for c in text:
            tail += c
            p, found = len(tail), None
            for n in range(min(self.longest, p), 0, -1):
                i, at = self.ids.get(tail[p - n :], -1), best[p - n]
                if at is None or (i < 0 and n > 1):
                    continue
                if self.bpe:
                    # after a committed boundary the last piece is still known
                    if i < 0 or at[2] < 0 or (self.whole[i] and self.follow(at[2], i)):
                        if i < 0 or self.whole[i]:
                            found = (0.0, n, i)
                            break
                else:
                    s = at[0] + (self.score[i] if i >= 0 else self.floor)
                    if found is None or s > found[0]:
                        found = (s, n, i)
            best.append(found)
            if p >= 4 * self.longest:
                done, ids = self._commit(tail, best)
                yield from ids
                tail, best = tail[done:], best[done:]
        yield from self._back(tail, best, len(tail))

    @property
    def floor(self) -> float:
        """Score of an unknown character in a unigram model: 10 below the least."""
        return float(self.score[list(self.ids.values())].min()) - 10

    def _commit(self, tail: str, best: list) -> tuple[int, list[int]]:
        """The last boundary that the paths from all boundaries of the window share, and the ids up to it."""
        alive = {p for p in range(len(best) - self.longest, len(best)) if best[p] is not None}
        while len(alive) > 1:
            p = max(alive)
            alive.remove(p)
            alive.add(p - best[p][1])
        at = alive.pop()
        return at, self._back(tail, best, at)

    def _back(self, tail: str, best: list, at: int) -> list[int]:
        out: list[int] = []
        while at > 0:
            _, n, i = best[at]
            out.extend([i] if i >= 0 else self.fallback(tail[at - n : at])[::-1])
            at -= n
        return out[::-1]

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def solve(self, cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Ids of many short stretches of known characters, side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            to = min(len(order), at + max(256, (1 << 19) // int(lengths[order[min(at + 4096, len(order) - 1)]] + 1)))
            lanes = order[at:to]
            self._lanes(cls, starts[lanes], lengths[lanes], lanes, out)
            at = to
        return out

    def _lanes(self, cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: np.ndarray, out: list) -> None:
        n, width = len(starts), int(lengths[-1])
        h = np.zeros((width + 1, n), U64)
        last, back = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int16)
        score = np.zeros((width + 1, n)) if not self.bpe else None
        step, first = U64(self.base[1]), 0
        for p in range(1, width + 1):
            first = int(np.searchsorted(lengths, p))  # lanes are sorted by length
            c = cls[starts[first:] + (p - 1)].astype(U64) + U64(1)
            h[p, first:] = h[p - 1, first:] * step + c * U64(0xBF58476D1CE4E5B9)
            todo = np.arange(first, n)
            best = np.full(n - first, -np.inf)
            for k in range(min(p, self.longest), 0, -1):
                if not len(todo):
                    break
                ids = self.table.get(h[p, todo] - h[p - k, todo] * U64(self.base[k]))
                has = ids >= 0
                if self.bpe:
                    has[has] = self.whole[ids[has]]
                    lane, i = todo[has], ids[has]
                    if p > k and len(lane):
                        fit = self.follows(last[p - k, lane], i)
                        lane, i = lane[fit], i[fit]
                    last[p, lane], back[p, lane] = i, k
                    if len(lane):
                        todo = todo[last[p, todo] < 0]
                else:
                    lane, i = todo[has], ids[has]
                    s = score[p - k, lane] + self.score[i]
                    fit = s > best[lane - first]
                    lane, i, s = lane[fit], i[fit], s[fit]
                    best[lane - first], last[p, lane], back[p, lane], score[p, lane] = s, i, k, s
        self._read(last, back, lengths, lanes, out)

    def _read(self, last: np.ndarray, back: np.ndarray, lengths: np.ndarray, lanes: np.ndarray, out: list) -> None:
        at, col, rows = lengths.astype(np.int64), np.arange(len(lengths)), []
        where = []
        while len(col):
            rows.append(last[at, col])
            where.append(col)
            at = at - back[at, col]
            col, at = col[at > 0], at[at > 0]
        ids, col = np.concatenate(rows), np.concatenate(where)
        step = np.concatenate([np.full(len(w), k) for k, w in enumerate(where)])
        order = np.lexsort((-step, col))
        ids, col = ids[order], col[order]
        for lane, part in zip(lanes, np.split(ids, np.searchsorted(col, np.arange(1, len(lengths)))), strict=True):
            out[lane] = part


class Coder:
    """A model with the stretches it has solved."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.start, self.size, self.pool, self.held = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int32), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and offsets (texts + 1)."""
        m = self.model
        lead = SPACE if m.prefix else ""
        whole = "".join(lead + t if t else "" for t in texts)
        sizes = np.array([len(t) + len(lead) if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.where(chars == 32, np.uint32(0x2581), chars)
        cls = m.cls[chars]
        cut = np.empty(len(cls) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = ~m.spans[cls[:-1], cls[1:]]
        cut[ends] = True
        bounds = np.flatnonzero(cut)
        starts, lengths = bounds[:-1], np.diff(bounds)
        p, q = powers(len(cls) + 1)
        c = np.zeros(len(cls) + 1, U64)
        np.cumsum((chars + np.uint32(1)).astype(U64) * p[: len(cls)], out=c[1:])
        key = ((c[bounds[1:]] - c[bounds[:-1]]) * q[starts]) ^ (lengths.astype(U64) << U64(1))
        key = strong(key, starts, bounds[1:], chars)
        codes, keys = pd.factorize(key.view(np.int64))
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slots) + len(keys) > SLOTS or self.held > POOL:
            self._clear()
        slots = np.array([self.slots.get(k, -1) for k in keys.tolist()], np.int64)
        self._learn(np.flatnonzero(slots < 0), slots, keys, first, chars, cls, starts, lengths)
        mine = slots[codes]
        begin, n = self.start, self.size[mine]
        to = np.cumsum(n)
        at = np.arange(to[-1]) - np.repeat(to - n - begin[mine], n)
        offsets = np.concatenate([[0], to])[np.searchsorted(bounds, np.concatenate([[0], ends]))]
        return self.pool[at], offsets

    def _learn(self, new: np.ndarray, slots: np.ndarray, keys: np.ndarray, first: np.ndarray, chars: np.ndarray, cls: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        m = self.model
        s, n = starts[first[new]], lengths[first[new]]
        plain = (n <= LONG) & (cls[s] > 0)  # unknown characters stand alone
        solved = m.solve(cls, s[plain], n[plain])
        rest = [np.array(list(m.stream(iter(chars[a : a + k].tobytes().decode("utf-32-le", "surrogatepass")))), np.int32) for a, k in zip(s[~plain], n[~plain], strict=True)]
        found = [*solved, *rest]
        if not found:
            return
        sizes = np.array([len(x) for x in found], np.int64)
        which, slot = np.concatenate([new[plain], new[~plain]]), len(self.slots) + np.arange(len(found))
        self.slots.update(zip(keys[which].tolist(), slot.tolist(), strict=True))
        slots[which] = slot
        for name, need in (("start", slot[-1] + 1), ("size", slot[-1] + 1), ("pool", self.held + sizes.sum())):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))
        self.start[slot], self.size[slot] = self.held + np.cumsum(sizes) - sizes, sizes
        self.pool[self.held : self.held + sizes.sum()] = np.concatenate(found)
        self.held += int(sizes.sum())

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of ids; a leading space that encoding put there goes."""
        out = b"".join(map(self.model.out.__getitem__, ids.tolist()))
        return out[1:] if self.model.prefix and out[:1] == b" " else out


def _rows(docs: DataFrame, model: str, make, schema: str, names: list[str]) -> DataFrame:
    raw = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())  # the vocabulary file, a fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(raw.value)
        for batch in batches_by_bytes(it, "text", 1 << 20):
            ids, offsets = coder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), *make(coder, ids, offsets)], names)

    return docs.mapInArrow(run, schema)


_coders: dict[bytes, Coder] = {}


def coder_of(raw: bytes) -> Coder:
    """The process's coder of a model file; it stays between tasks."""
    key = hashlib.sha256(raw).digest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(Model(raw))
    return _coders[key]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) of docs' texts."""

    def make(coder: Coder, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

    return _rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, make, "doc_id long, ids array<int>", ["doc_id", "ids"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are an empty text."""
    raw = encoded.sparkSession.sparkContext.broadcast(open(model, "rb").read())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(raw.value)
        for batch in it:
            texts = [coder.decode(np.array(ids or [], np.int32)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of ids, of them byte pieces, hashes of the ids and of the decoded text."""

    def make(coder: Coder, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        byte = np.zeros(len(coder.model.score), bool)
        byte[list(coder.model.bytes.values())] = True
        total = np.concatenate([[0], np.cumsum(byte[ids])])
        parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text = [hashlib.sha256(coder.decode(p)).hexdigest() for p in parts]
        return [pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()), pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]), pa.array(text)]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rows(docs, MODEL, make, "doc_id long, n_ids long, n_byte_ids long, ids_sha256 string, decoded_sha256 string", ["doc_id", "n_ids", "n_byte_ids", "ids_sha256", "decoded_sha256"])

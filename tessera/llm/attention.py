"""A causal self-attention language model over subword ids, in numpy: training by Adam and scoring of windows.

A position attends to itself and the positions before it in its window; windows of 2 * STRIDE positions overlap by half, and each
scores its second half, so every token is scored once with STRIDE to 2 * STRIDE - 1 tokens before it. The next id is predicted in two
steps, its class of WIDTH ids and then the id in the class. Ids that begin a word may stand in classes of their own, the first ones; then the
probability that a word begins is that of these classes.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np

#: Positions a window scores (and sees before), dimensions, hidden units after attention, ids in a class; steps, windows a step, rate and seed of training; rate over windows as they come.
STRIDE, DIM, HIDDEN, WIDTH = 32, 32, 48, 90
STEPS, WINDOWS, RATE, SEED, FOLLOW = 1800, 48, 8e-3, 5, 3e-4

#: Windows whose attention is computed at once (what they need stays in the processor's cache), states whose predictions are, rows of these.
STEP, PART, ROWS = 128, 1 << 16, 2048


@contextmanager
def one_thread() -> Iterator[None]:
    """numpy's matrix products on one thread, where its library can be told so: small ones are slower on several."""
    with suppress(OSError, AttributeError):
        path = next(iter(set(re.findall(r"/\S*openblas\S*\.so\S*", open("/proc/self/maps").read()))), "")
        lib = ctypes.CDLL(path)
        tail = "64_" if hasattr(lib, "scipy_openblas_set_num_threads64_") else ""
        head = "scipy_openblas" if tail else "openblas"
        get, put = getattr(lib, f"{head}_get_num_threads{tail}"), getattr(lib, f"{head}_set_num_threads{tail}")
        before = get()
        put(1)
        try:
            yield
        finally:
            put(before)
        return
    yield


class Attention:
    """ids 0 to n - 1 are predicted; id n stands before a text. In the first classes, so many, stand the ids that begin a word."""

    def __init__(self, n: int, first: int = 0, seed: int = SEED):
        self.n, self.first, self.classes = n, first, -(-n // WIDTH)
        r = np.random.default_rng(seed)
        init = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        d, far = DIM, 2 * STRIDE
        self.w = {
            "e": init(n + 1, d, s=0.3), "q": init(d, d, s=0.3), "k": init(d, d, s=0.3), "v": init(d, d, s=0.3), "o": init(d, d, s=0.3),
            "near": np.zeros(far, np.float32), "a": init(d, HIDDEN, s=0.2), "ab": np.zeros(HIDDEN, np.float32), "b": init(HIDDEN, d, s=0.05),
            "c": init(self.classes, d), "cb": np.zeros(self.classes, np.float32), "t": init(self.classes, WIDTH, d), "tb": np.zeros((self.classes, WIDTH), np.float32),
        }
        self.w["tb"].reshape(-1)[n:] = -30  # ids that don't exist

    @staticmethod
    def _bias(near: np.ndarray) -> np.ndarray:
        """Bias of (scored position, window position) by distance; the future is masked."""
        far = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]
        return np.where(far >= 0, near[np.maximum(far, 0)], np.float32(-1e9)).astype(np.float32)

    def starts(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first scored position, text) of all windows of texts that end at ends."""
        begin = np.concatenate([[0], ends[:-1]])
        per = -(-(ends - begin) // STRIDE)
        text = np.repeat(np.arange(len(ends)), per)
        return begin[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)), text

    def windows(self, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, valid) of windows; the input at a position is the token before it."""
        begin, end = np.concatenate([[0], ends[:-1]])[text][:, None], ends[text][:, None]
        spot = at[:, None] + np.arange(-STRIDE, STRIDE)
        valid = (spot >= begin) & (spot < end)
        before = ids.take(spot - 1, mode="clip")
        before[(spot == begin) | ~valid] = self.n
        return before, valid

    def prepared(self) -> dict[str, np.ndarray]:
        """Tables for scoring. As the layer's inputs are embeddings alone, its queries, keys and values are tables by id; the last row, for no position at all, weighs nothing."""
        w, none, one = self.w, np.zeros((1, DIM), np.float32), np.ones((self.n + 1, 1), np.float32)
        e = np.concatenate([w["e"], none])
        vo = np.concatenate([np.hstack([w["e"] @ w["v"] @ w["o"], one]), np.zeros((1, DIM + 1), np.float32)])
        return {
            "e": e, "eq": (e @ w["q"] / np.sqrt(DIM)).astype(np.float32), "ek": e @ w["k"], "near": self._bias(w["near"]), "vo": vo,
            "ct": np.vstack([w["c"].T, w["cb"]]), "tt": np.concatenate([w["t"].transpose(0, 2, 1), w["tb"][:, None]], 1),
        }

    def score(self, ids: np.ndarray, ends: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of every token of texts laid end to end (ends: their ends, no text empty)."""
        return self.score_and_begin(ids, ends, table)[0]

    def score_and_begin(self, ids: np.ndarray, ends: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
        """Two rows: log10 probability of every token, and that a word begins in its place."""
        out, (at, text) = np.zeros((2, len(ids))), self.starts(ends)
        h, place, have = np.ones((PART, DIM + 1), np.float32), np.empty(PART, np.int64), 0
        with one_thread():
            for a in range(0, len(at), STEP):
                spots, hidden = self._hidden(ids, ends, at[a : a + STEP], text[a : a + STEP], table)
                h[have : have + len(spots), :DIM], place[have : have + len(spots)] = hidden, spots
                have += len(spots)
                if have + STEP * STRIDE > PART or a + STEP >= len(at):
                    out[:, place[:have]] = self._predict(h[:have], ids[place[:have]], table)
                    have = 0
        return out

    def _hidden(self, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, text: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions that windows score and the states there."""
        x, valid = self.windows(ids, ends, at, text)
        x[~valid] = self.n + 1
        own, real = x[:, STRIDE:], np.flatnonzero(valid[:, STRIDE:])
        s = table["eq"].take(own, axis=0) @ table["ek"].take(x, axis=0).transpose(0, 2, 1)
        s += table["near"]
        vo = table["vo"].take(x, axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            mixed = (np.exp(s) @ vo).reshape(-1, DIM + 1).take(real, axis=0)
        total = mixed[:, DIM:]
        if not 1e-30 < total.min() <= total.max() < 1e30:  # rare: weights that need their greatest taken off first
            s -= np.float32(1e9) * (x == self.n + 1)[:, None, :]
            mixed = (np.exp(s - s.max(2, keepdims=True)) @ vo).reshape(-1, DIM + 1).take(real, axis=0)
            total = mixed[:, DIM:]
        h = mixed[:, :DIM] / total
        h += table["e"].take(own.reshape(-1).take(real), axis=0)
        unit = h @ self.w["a"]
        unit += self.w["ab"]
        np.maximum(unit, 0, out=unit)
        h += unit @ self.w["b"]
        return at[real // STRIDE] + real % STRIDE, h

    @staticmethod
    def _softmax(h: np.ndarray, table: np.ndarray, pick: np.ndarray, first: int, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of the picked columns of h @ table, and of the first columns together (0 if there are none); out holds the products."""
        logit = np.matmul(h, table, out=out[: len(h)])
        chosen = logit[np.arange(len(h)), pick]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            total = np.exp(logit, out=logit).sum(1) if len(h) < 16 else np.exp(logit, out=logit) @ np.ones(logit.shape[1], np.float32)
            if not 1e-30 < total.min() <= total.max() < 1e30:  # rare: products that need their greatest taken off first
                logit = h @ table
                most = logit.max(1, keepdims=True)
                logit, chosen = np.exp(logit - most), chosen - most[:, 0]
                total = logit.sum(1)
            near = np.log(logit[:, :first].sum(1) if len(h) < 16 else logit[:, :first] @ np.ones(first, np.float32)) if first else total
            total = np.log(total)
        return chosen - total, near - total if first else np.zeros(len(h))

    def _predict(self, h: np.ndarray, target: np.ndarray, table: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of target ids at states (a 1 after each), and that a word begins."""
        group = (target // WIDTH).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        h, group, inner = h.take(order, axis=0), group[order], target[order] % WIDTH
        out, one, two = np.zeros((2, len(h))), np.empty((ROWS, self.classes), np.float32), np.empty((ROWS, WIDTH), np.float32)
        for a in range(0, len(h), ROWS):
            rows = slice(a, a + ROWS)
            out[:, rows] = self._softmax(h[rows], table["ct"], group[rows], self.first, one)
        edges = np.searchsorted(group, np.arange(self.classes + 1))
        for c in range(self.classes):
            for a in range(edges[c], edges[c + 1], ROWS):
                rows = slice(a, min(a + ROWS, edges[c + 1]))
                out[0, rows] += self._softmax(h[rows], table["tt"][c], inner[rows], 0, two)[0]
        back = np.empty_like(out)
        back[:, order] = out
        return back / np.log(10)

    def loss(self, x: np.ndarray, valid: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (nats) of windows' scored tokens and its gradients."""
        steps = Steps(self.w)
        return steps.gradients(x, valid, target), steps.plain(steps.g)

    def targets(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids that windows score."""
        return ids[np.minimum(at[:, None] + np.arange(STRIDE), len(ids) - 1)]

    def train(self, ids: np.ndarray, ends: np.ndarray, steps: int | None = None, seed: int = SEED) -> list[float]:
        """Adam over random windows of the texts; the losses."""
        at, text = self.starts(ends)
        return self.train_windows(*self.windows(ids, ends, at, text), self.targets(ids, at), steps, seed)

    def train_windows(self, x: np.ndarray, valid: np.ndarray, target: np.ndarray, steps: int | None = None, seed: int = SEED) -> list[float]:
        """Adam over random windows; the losses."""
        r, losses, adam, steps = np.random.default_rng(seed), [], Steps(self.w), STEPS if steps is None else steps
        with one_thread():
            for step in range(1, steps + 1):
                pick = r.integers(0, len(x), WINDOWS)
                losses.append(adam.gradients(x[pick], valid[pick], target[pick]))
                adam.step(RATE * min(1, step / 50) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-5)
        self.w = adam.plain(adam.w)
        return losses

    def follow(self, batches: Iterator[tuple[np.ndarray, ...]]) -> int:
        """Adam at a low rate over (inputs, valid, target) of windows as they come, each once; how many they were."""
        adam, n = Steps(self.w), 0
        for many in batches:
            n += len(many[0])
            with one_thread():
                for a in range(0, len(many[0]), WINDOWS):
                    adam.gradients(*(z[a : a + WINDOWS] for z in many))
                    adam.step(FOLLOW)
        self.w = adam.plain(adam.w)
        return n


class Steps:
    """Gradients over windows and steps of Adam, in memory that is made once: fresh pages for every product cost as much as the products.

    All weights stand in one array, and likewise their gradients; keys stand beside values and biases beside the weights they are added to.
    """

    def __init__(self, w: dict[str, np.ndarray]):
        d, self.kind, self.classes, self.n = DIM, w["e"].dtype, len(w["c"]), 0
        shapes = {"e": w["e"].shape, "q": (d, d), "kv": (d, 2 * d), "o": (d, d), "near": (2 * STRIDE,), "a": (d + 1, HIDDEN), "b": (HIDDEN, d), "c": (self.classes, d + 1), "t": (self.classes, WIDTH, d + 1)}
        at = np.cumsum([0, *(int(np.prod(x)) for x in shapes.values())])
        self.flat, self.grad, self.a, self.b = (np.zeros(at[-1], self.kind) for _ in range(4))
        self.w, self.g = ({k: z[i:j].reshape(x) for (k, x), i, j in zip(shapes.items(), at, at[1:], strict=False)} for z in (self.flat, self.grad))
        for k in ("e", "q", "o", "near", "b"):
            self.w[k][:] = w[k]
        self.w["kv"][:, :d], self.w["kv"][:, d:] = w["k"], w["v"]
        self.w["a"][:d], self.w["a"][d] = w["a"], w["ab"]
        for k in ("c", "t"):
            self.w[k][..., :d], self.w[k][..., d] = w[k], w[k + "b"]
        far = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]
        self.far, self.past = np.where(far >= 0, far, 2 * STRIDE), far >= 0
        self.held: dict[str, np.ndarray] = {}
        self.touched = np.zeros(0, np.int64)
        self.off = np.empty(1 << 16, self.kind)

    @staticmethod
    def plain(z: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The weights or gradients by the model's names, copied."""
        d = DIM
        parts = {k: z[k] for k in ("e", "q", "o", "near", "b")} | {"k": z["kv"][:, :d], "v": z["kv"][:, d:], "a": z["a"][:d], "ab": z["a"][d]}
        return {k: x.copy() for k, x in (parts | {k: z[k][..., :d] for k in ("c", "t")} | {k + "b": z[k][..., d] for k in ("c", "t")}).items()}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory for a product of at most as many rows as before; it begins as ones."""
        held = self.held.get(name)
        if held is None or len(held) < shape[0]:
            held = self.held[name] = np.ones(shape, self.kind)
        return held[: shape[0]]

    @staticmethod
    def _exp(z: np.ndarray, again: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Sums by row of exp(z), made in place, and what was taken off before; again makes z anew."""
        ones = np.ones(z.shape[-1], z.dtype)
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.exp(z, out=z) @ ones
        if 1e-30 < total.min() <= total.max() < 1e30:
            return total, np.zeros((), z.dtype)
        most = again().max(1)  # rare: products that need their greatest taken off first
        z -= most[:, None]
        return np.exp(z, out=z) @ ones, most

    def gradients(self, x: np.ndarray, valid: np.ndarray, target: np.ndarray) -> float:
        """Mean loss (nats) of windows' scored tokens; g holds its gradients then."""
        w, g, room, d, many = self.w, self.g, self._room, DIM, len(x)
        rows, all_, root = many * STRIDE, 2 * many * STRIDE, self.kind.type(1 / np.sqrt(DIM))
        real, y = valid[:, STRIDE:].reshape(-1), target.reshape(-1)
        share = real.astype(self.kind) / self.kind.type(real.sum())  # of the loss, by row
        # attention
        e, own = room("e", all_, d), room("own", rows, d)
        w["e"].take(x.reshape(-1), axis=0, out=e, mode="clip")
        w["e"].take(x[:, STRIDE:].reshape(-1), axis=0, out=own, mode="clip")
        q, kv = np.matmul(own, w["q"], out=room("q", rows, d)), np.matmul(e, w["kv"], out=room("kv", all_, 2 * d)).reshape(many, -1, 2 * d)
        q *= root
        q, k, v = q.reshape(many, -1, d), kv[..., :d], kv[..., d:]
        bias, holes = np.append(w["near"], self.kind.type(-1e9))[self.far], np.flatnonzero(~valid.all(1))
        p = room("p", rows, 2 * STRIDE).reshape(many, STRIDE, -1)

        def seen() -> np.ndarray:
            np.matmul(q, k.transpose(0, 2, 1), out=p)
            np.add(p, bias, out=p)
            if len(holes):
                p[holes] -= self.kind.type(1e9) * ~valid[holes][:, None, :]
            return p.reshape(rows, -1)

        once = 1 / self._exp(seen(), seen)[0][:, None]
        m = np.matmul(p, v, out=room("m", rows, d).reshape(many, -1, d)).reshape(rows, d)
        m *= once
        base, h = room("base", rows, d + 1), room("h", rows, d + 1)  # a 1 after each
        np.matmul(m, w["o"], out=base[:, :d])
        base[:, :d] += own
        unit = np.matmul(base, w["a"], out=room("unit", rows, HIDDEN))
        np.maximum(unit, 0, out=unit)
        np.matmul(unit, w["b"], out=h[:, :d])
        h[:, :d] += base[:, :d]

        def softmax(z: np.ndarray, again: Callable[[], np.ndarray], pick: np.ndarray, share: np.ndarray) -> float:
            spot = np.arange(len(z)) * z.shape[1] + pick
            chosen = z.reshape(-1)[spot]
            total, most = self._exp(z, again)
            z *= (share / total)[:, None]
            z.reshape(-1)[spot] -= share
            return float(share @ (np.log(total) + most - chosen))

        # classes, then ids in them: rows stand by class there, so a class takes products alone and the softmax is one for all
        group = (y // WIDTH).astype(np.uint16)
        z = room("z", rows, self.classes)
        value = softmax(np.matmul(h, w["c"].T, out=z), lambda: np.matmul(h, w["c"].T, out=z), group, share)
        dh = np.matmul(z, w["c"], out=room("dh", rows, d + 1))
        np.matmul(z.T, h, out=g["c"])
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(self.classes + 1)).tolist()
        by, u, back = h.take(order, axis=0, out=room("by", rows, d + 1), mode="clip"), room("u", rows, WIDTH), room("back", rows, d + 1)
        spans = [(w["t"][c], g["t"][c], by[a:z], u[a:z], back[a:z]) for c, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if a < z]

        def inner() -> np.ndarray:
            for t, _, mine, out, _ in spans:
                np.dot(mine, t.T, out=out)
            return u

        value += softmax(inner(), inner, (y % WIDTH)[order], share[order])
        g["t"][np.diff(edges) == 0] = 0
        for t, dt, mine, out, to in spans:
            np.dot(out.T, mine, out=dt)
            np.dot(out, t, out=to)
        dh[order] += back
        dh = dh[:, :d]
        # back through the hidden units and the attention
        dunit = np.matmul(dh, w["b"].T, out=room("dunit", rows, HIDDEN))
        dunit *= np.sign(unit)
        np.matmul(unit.T, dh, out=g["b"])
        np.matmul(base.T, dunit, out=g["a"])
        full = np.matmul(dunit, w["a"][:d].T, out=room("full", rows, d))
        full += dh
        np.matmul(m.T, full, out=g["o"])
        dm = np.matmul(full, w["o"].T, out=room("dm", rows, d))
        dm *= once
        dp, dkv = room("dp", rows, 2 * STRIDE).reshape(many, STRIDE, -1), room("dkv", all_, 2 * d).reshape(many, -1, 2 * d)
        dp_mean = np.einsum("ij,ij->i", dm, m).reshape(many, STRIDE, 1)  # of a row's dp by its weights
        dm = dm.reshape(many, STRIDE, d)
        np.matmul(p.transpose(0, 2, 1), dm, out=dkv[..., d:])
        np.matmul(dm, v.transpose(0, 2, 1), out=dp)
        dp -= dp_mean
        dp *= p
        g["near"][:] = np.bincount(self.far.reshape(-1), dp.reshape(many, -1).sum(0), 2 * STRIDE + 1)[: 2 * STRIDE]
        dq = np.matmul(dp, k, out=room("dq", rows, d).reshape(many, -1, d)).reshape(rows, d)
        dq *= root
        np.matmul(dp.transpose(0, 2, 1), q, out=dkv[..., :d])
        dkv = dkv.reshape(all_, -1)
        np.matmul(own.T, dq, out=g["q"])
        np.matmul(e.T, dkv, out=g["kv"])
        de = np.matmul(dkv, w["kv"].T, out=room("de", all_, d))
        full += np.matmul(dq, w["q"].T, out=room("from_q", rows, d))
        de.reshape(many, -1, d)[:, STRIDE:] += full.reshape(many, -1, d)
        flat = x.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        g["e"][self.touched] = 0
        self.touched = flat[heads]
        g["e"][self.touched] = np.add.reduceat(de.take(order, axis=0, out=room("sorted", all_, d), mode="clip"), heads)
        return value

    def step(self, rate: float) -> None:
        """A step of Adam, a stretch of the weights at a time, which the processor's cache holds. a and b are 10 and 100 times the moments."""
        self.n += 1
        late = np.sqrt(1 - 0.99**self.n)
        rate, least = self.kind.type(rate * late / (1 - 0.9**self.n)), self.kind.type(1e-7 * late)
        for at in range(0, len(self.flat), len(self.off)):
            w, g, a, b = (z[at : at + len(self.off)] for z in (self.flat, self.grad, self.a, self.b))
            off = self.off[: len(w)]
            a *= self.kind.type(0.9)
            a += g
            b *= self.kind.type(0.99)
            np.multiply(g, g, out=off)
            b += off
            np.sqrt(b, out=off)
            off += least
            np.divide(a, off, out=off)
            off *= rate
            w -= off

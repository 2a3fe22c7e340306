"""Progressive JPEG (SOF2): many files coded and decoded side by side in numpy.

Decoding keeps a lane for every restart interval of every scan. Scans that don't build on one another (other components or
bands) run together; each step reads one Huffman symbol, or in a refinement the bits up to one, in all lanes. First and refining
scans accumulate into one array of coefficients; then come a fixed-point inverse transform of all blocks, chroma upsampling by
repetition and integer colour conversion, so equal files give equal tensors whatever they are decoded with.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: zigzag order of the coefficients (as row-major places), and the usual DC code.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, i // 8 if s % 2 else -(i // 8))))
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))


class Broken(ValueError):
    """A file that isn't a progressive JPEG as read here, or is cut or damaged."""


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, whole MCUs
    cols: int = 0
    used: tuple[int, int] = (0, 0)  # rows and columns of blocks that scans of the component alone hold
    first: int = 0  # its first block in the coefficient array


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comments: list[bytes] = field(default_factory=list)
    coefficients: np.ndarray | None = None  # (blocks, 64) in zigzag order, quantised, component after component

    def layout(self, first: int = 0) -> int:
        """Sets the components' blocks from first on; the block after the last."""
        hs, vs = max(c.h for c in self.components), max(c.v for c in self.components)
        wide, high = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        for c in self.components:
            c.rows, c.cols, c.first = high * c.v, wide * c.h, first
            c.used = (-(-(-(-self.height * c.v // vs)) // 8), -(-(-(-self.width * c.h // hs)) // 8))
            first += c.rows * c.cols
        return first

    def order(self, which: list[int]) -> np.ndarray:
        """Block numbers of a scan of these components, in order: (MCUs, blocks in one)."""
        first = self.components[0].first
        return first + _order(tuple((c.h, c.v, c.rows, c.cols, c.used, c.first - first) for c in self.components), tuple(which))


@lru_cache(2048)
def _order(components: tuple, which: tuple[int, ...]) -> np.ndarray:
    if len(which) == 1:
        _, _, _, wide, (rows, cols), first = components[which[0]]
        return (first + np.arange(rows)[:, None] * wide + np.arange(cols)).reshape(-1, 1)
    h, v, rows, cols, _, _ = components[0]
    y, x = np.arange(rows // v)[:, None], np.arange(cols // h)
    parts = []
    for k in which:
        h, v, _, cols, _, first = components[k]
        parts += [(first + (y * v + j) * cols + x * h + i).reshape(-1) for j in range(v) for i in range(h)]
    return np.stack(parts, 1)


@lru_cache(256)
def codes(counts: tuple[int, ...], symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman table: code and length by symbol, and length * 256 + symbol by the next 16 bits."""
    code, size, look = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    value = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            s = symbols[k]
            code[s], size[s] = value, n
            look[value << (16 - n) : (value + 1) << (16 - n)] = n << 8 | s
            value, k = value + 1, k + 1
        value <<= 1
    return code, size, look


def table(first: bytes, second: bytes, others: bytes = b"") -> tuple[tuple[int, ...], bytes]:
    """A table with codes of 1 bit, 2 bits and 10 bits."""
    counts = [0] * 16
    counts[0], counts[1], counts[9] = len(first), len(second), len(others)
    return tuple(counts), first + second + others


# ---- decoding


def _marker_walk(buf: bytes, at: int, end: int, marks: np.ndarray) -> tuple[Image, list[dict]]:
    """The frame and scans of the file in buf[at:end]; marks: places of FF bytes that no 00 follows."""
    image, scans, tables, interval, quant, comments = None, [], {}, 0, {}, []
    if buf[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    at += 2
    while True:
        if at + 2 > end or buf[at] != 0xFF:
            raise Broken("the file is cut")
        kind = buf[at + 1]
        if kind == 0xD9:
            break
        n = int.from_bytes(buf[at + 2 : at + 4], "big")
        body, nxt = buf[at + 4 : at + 2 + n], at + 2 + n
        if nxt > end or n < 2:
            raise Broken("the file is cut")
        if kind == 0xC2:
            if body[0] not in (8, 12):
                raise Broken("a precision other than 8 or 12 bits")
            image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])], quant, comments)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise Broken("not a progressive Huffman-coded frame")
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (tuple(body[1:17]), body[17 : 17 + total])
                body = body[17 + total :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xFE:
            comments.append(body)
        elif kind == 0xDA:
            if image is None:
                raise Broken("a scan before the frame")
            ids = {c.id: k for k, c in enumerate(image.components)}
            count = body[0]
            which = [ids[body[1 + 2 * k]] for k in range(count)]
            ss, se, ahl = body[1 + 2 * count : 4 + 2 * count]
            key = body[2] >> 4 if ss == 0 else 0x10 | body[2] & 15
            k = int(np.searchsorted(marks, nxt))
            parts = [nxt]
            while k < len(marks) and marks[k] < end and (m := buf[marks[k] + 1]) != 0xFF and 0xD0 <= m <= 0xD7:
                parts.append(int(marks[k]) + 2)
                k += 1
            if k >= len(marks) or marks[k] >= end:
                raise Broken("the file is cut")
            # components may name tables of their own in an interleaved scan
            own = [tables.get(body[2 + 2 * j] >> 4) if ss == 0 else tables.get(key) for j in range(count)]
            scans.append({"which": which, "ss": ss, "se": se, "ah": ahl >> 4, "al": ahl & 15, "tables": tuple(own), "interval": interval, "parts": parts, "end": int(marks[k])})
            nxt = int(marks[k])
        at = nxt
    if image is None:
        raise Broken("no frame")
    return image, scans


class Lanes:
    """Restart intervals of scans of one kind: where their bits and their blocks begin."""

    def __init__(self, jobs: list[tuple[Image, dict]], place: np.ndarray):
        starts, ends, orders, counts = [], [], [], []
        for image, s in jobs:
            order = image.order(s["which"])
            step = s["interval"] or len(order)
            begin = np.arange(0, len(order), step)
            if len(begin) != len(s["parts"]):
                raise Broken("a wrong number of restart intervals")
            parts = np.array(s["parts"])
            starts.append(parts)
            ends.append(np.append(parts[1:] - 2, s["end"]))
            counts.append((np.minimum(begin + step, len(order)) - begin) * order.shape[1])
            orders.append(order.ravel())
        self.blocks = np.concatenate(orders)
        self.n = np.concatenate(counts)
        self.first = np.cumsum(self.n) - self.n
        self.pos = place[np.concatenate(starts)] * 8
        self.end = place[np.concatenate(ends)] * 8

    def check(self, pos: np.ndarray) -> None:
        if (pos > self.end).any():
            raise Broken("a scan ends early")


def _peek(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The 25 bits from pos on at least, at the top of 32."""
    return words[pos >> 3] << (pos & 7).astype(np.uint32)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of size additional bits."""
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _dc(lanes: Lanes, scan: dict, jobs: list, words: np.ndarray, coef: np.ndarray) -> None:
    image = jobs[0][0]
    parts = [j for j, k in enumerate(scan["which"]) for _ in range(image.components[k].h * image.components[k].v if len(scan["which"]) > 1 else 1)]
    looks = [codes(*scan["tables"][j])[2] for j in range(len(scan["which"]))]
    pos, last = lanes.pos.copy(), np.zeros((len(scan["which"]), len(lanes.n)), np.int64)
    order = np.argsort(-lanes.n, kind="stable")
    alive = len(order)
    for step in range(int(lanes.n.max(initial=0))):
        while alive and lanes.n[order[alive - 1]] <= step:
            alive -= 1
        lane, part = order[:alive], parts[step % len(parts)]
        bits = _peek(words, pos[lane])
        hit = looks[part][bits >> np.uint32(16)].astype(np.int64)
        if not hit.all():
            raise Broken("no such code")
        size, n = hit & 255, hit >> 8
        bits = _peek(words, pos[lane] + n)
        value = _extend((bits.astype(np.int64) >> (32 - size)), size)
        pos[lane] += n + size
        last[part, lane] += value
        coef[lanes.blocks[lanes.first[lane] + step], 0] = last[part, lane] << scan["al"]
    lanes.check(pos)


def _dc_refine(lanes: Lanes, scan: dict, bits: np.ndarray, coef: np.ndarray) -> None:
    lane = np.repeat(np.arange(len(lanes.n)), lanes.n)
    step = np.arange(len(lane)) - lanes.first[lane]
    lanes.check(lanes.pos + lanes.n)
    coef[lanes.blocks, 0] |= (bits[lanes.pos[lane] + step].astype(coef.dtype)) << scan["al"]


def _ac(lanes: Lanes, scan: dict, words: np.ndarray, coef: np.ndarray) -> None:
    look, ss, se, al = codes(*scan["tables"][0])[2], scan["ss"], scan["se"], scan["al"]
    flat = coef.reshape(-1)
    value_of = np.array([[_v - (1 << s) + 1 if s and _v < 1 << (s - 1) else _v for _v in range(1 << s)] + [0] * ((1 << 8) - (1 << s)) for s in range(9)]).ravel()
    pos, at, stop = lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.n
    k, lane = np.full(len(at), ss), np.arange(len(at))
    ends = pos.copy()
    blocks = np.append(lanes.blocks, 0)
    base = blocks[at] * 64
    while len(lane):
        bits = _peek(words, pos)
        hit = look[bits >> np.uint32(16)].astype(np.int64)
        size, n = hit & 15, hit >> 8
        bits = (bits << n.astype(np.uint32)).astype(np.int64)
        if (n + size > 25).any():
            again = n + size > 25
            bits[again] = _peek(words, pos[again] + n[again])
        run = hit >> 4 & 15
        extra = (bits & 0xFFFFFFFF) >> (32 - size)
        pos += n + size
        k += run
        value = value_of[(size << 8) + extra] if size.max(initial=0) <= 8 else _extend(extra, size)
        plain = size > 0
        if plain.all():
            flat[base + np.minimum(k, 63)] = value << al
            k += 1
            over = k > se
            if over.any():
                if (k > se + 1).any():
                    raise Broken("a run beyond the band")
                at[over] += 1
                base[over] = blocks[at[over]] * 64
                k[over] = ss
        else:
            if not n.all():
                raise Broken("no such code")
            w = np.flatnonzero(plain)
            if (k[w] > se).any():
                raise Broken("a run beyond the band")
            flat[base[w] + k[w]] = value[w] << al
            k[w] += 1
            z = np.flatnonzero(~plain & (run < 15))
            more = _peek(words, pos[z]).astype(np.int64) >> (32 - run[z])
            pos[z] += run[z]
            k[z] = ss
            at[z] += (1 << run[z]) + more
            z = np.flatnonzero(~plain & (run == 15))
            k[z] += 1
            over = np.flatnonzero(k > se)
            at[over] += 1
            k[over] = ss
            base = blocks[np.minimum(at, len(blocks) - 1)] * 64
        if (done := at >= stop).any():
            ends[lane[done]] = pos[done]
            if (at[done] > stop[done]).any():
                raise Broken("a run beyond the interval")
            go = ~done
            lane, pos, at, stop, k, base = lane[go], pos[go], at[go], stop[go], k[go], base[go]
    lanes.check(ends)


def _ac_refine(lanes: Lanes, scan: dict, words: np.ndarray, bits: np.ndarray, coef: np.ndarray) -> None:
    look, ss, se, one = codes(*scan["tables"][0])[2], scan["ss"], scan["se"], 1 << scan["al"]
    pos, at, stop, lane = lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.n, np.arange(len(lanes.n))
    k, run, ends = np.full(len(at), ss), np.zeros(len(at), np.int64), pos.copy()
    places = np.arange(ss, se + 1)
    while len(lane):
        sign = np.zeros(len(lane), np.int64)
        zeros = np.full(len(lane), 99)  # zeros to pass; 99: to the band's end
        new = np.flatnonzero(run == 0)
        if len(new):
            hit = look[_peek(words, pos[new]) >> np.uint32(16)].astype(np.int64)
            if not hit.all():
                raise Broken("no such code")
            n, r, s = hit >> 8, hit >> 4 & 15, hit & 15
            pos[new] += n
            eob = (s == 0) & (r < 15)
            e = new[eob]
            run[e] = (1 << r[eob]) + (_peek(words, pos[e]).astype(np.int64) >> (32 - r[eob]))
            pos[e] += r[eob]
            one_ = s > 0
            sign[new[one_]] = np.where(bits[pos[new[one_]]] > 0, 1, -1)
            pos[new[one_]] += 1
            zeros[new[~eob]] = r[~eob]
        now = coef[lanes.blocks[at], ss : se + 1].astype(np.int64)
        inside = places >= k[:, None]
        nonzero = (now != 0) & inside
        # the place where the run of zeros ends
        nth = np.cumsum(~nonzero & inside, 1)
        reach = inside & (nth <= zeros[:, None])  # before the zero that ends the run
        reach |= inside & nonzero & (nth <= zeros[:, None])
        touched = nonzero & reach
        count = touched.cumsum(1)
        take = bits[pos[:, None] + np.maximum(count - 1, 0)]
        now += np.where(touched & (take > 0), np.where(now > 0, one, -one), 0)
        pos += count[:, -1]
        to_end = zeros == 99
        stop_at = np.where(to_end, se + 1, ss + reach.shape[1] - (inside & ~reach).sum(1))
        mark = np.flatnonzero(~to_end & (sign != 0))
        if (stop_at[~to_end] > se).any() and len(mark) and (stop_at[mark] > se).any():
            raise Broken("a run beyond the band")
        now[mark, stop_at[mark] - ss] = sign[mark] * one
        coef[lanes.blocks[at], ss : se + 1] = now
        k = stop_at + 1
        run -= to_end
        over = to_end | (k > se)
        at[over] += 1
        k[over] = ss
        if (done := at >= stop).any():
            if run[done].any():
                raise Broken("a run beyond the interval")
            ends[lane[done]] = pos[done]
            go = ~done
            lane, pos, at, stop, k, run = lane[go], pos[go], at[go], stop[go], k[go], run[go]
    lanes.check(ends)


def decode_many(files: list[bytes]) -> list[Image]:
    """The images with the coefficients that all their scans give."""
    whole = b"".join(files)
    buf = np.frombuffer(whole, np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    marks = ff[buf[ff + 1] != 0]
    keep = np.ones(len(buf) + 1, bool)
    keep[ff[buf[ff + 1] == 0] + 1] = False
    place = np.cumsum(keep) - keep  # of each byte once stuffed zeros are gone
    data = np.concatenate([buf[keep[:-1]], np.full(8, 255, np.uint8)])
    words = data[:-3].astype(np.uint32) << np.uint32(24)
    for k, shift in ((1, 16), (2, 8), (3, 0)):
        words |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(shift)
    bits = np.unpackbits(data)
    images, blocks, at = [], 0, 0
    groups: dict[tuple, list] = defaultdict(list)
    for f in files:
        image, scans = _marker_walk(whole, at, at + len(f), marks)
        at += len(f)
        blocks = image.layout(blocks)
        images.append(image)
        done: list[tuple[dict, int]] = []
        for s in scans:
            level = max((r + 1 for t, r in done if set(t["which"]) & set(s["which"]) and t["ss"] <= s["se"] and s["ss"] <= t["se"]), default=0)
            done.append((s, level))
            shape = tuple(sorted((k, image.components[k].h * image.components[k].v) for k in s["which"])) if len(s["which"]) > 1 else ()
            groups[level, s["ss"] == 0, s["ss"], s["se"], s["ah"] > 0, s["al"], s["tables"], shape].append((image, s))
    coef = np.zeros((blocks, 64), np.int16)
    for key in sorted(groups, key=lambda g: g[0]):
        jobs = groups[key]
        scan, lanes = jobs[0][1], Lanes(jobs, place)
        if None in scan["tables"] and not (scan["ss"] == 0 and scan["ah"]):
            raise Broken("a scan without its code table")
        if scan["ss"] == 0:
            if scan["se"]:
                raise Broken("a progressive DC scan with AC coefficients")
            _dc_refine(lanes, scan, bits, coef) if scan["ah"] else _dc(lanes, scan, jobs, words, coef)
        elif scan["ah"]:
            _ac_refine(lanes, scan, words, bits, coef)
        else:
            _ac(lanes, scan, words, coef)
    for image in images:
        first = image.components[0].first
        last = image.components[-1]
        image.coefficients = coef[first : last.first + last.rows * last.cols]
    return images


@lru_cache(1)
def _inverse() -> np.ndarray:
    """(64 zigzag coefficients, 64 pixels) of the inverse transform, in units of 2**-13."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    both = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)  # rows u, columns v
    return np.rint(both[ZIGZAG] * 8192)


def to_rgb(images: list[Image]) -> list[np.ndarray]:
    """Full-resolution (height, width, 3) uint8 tensors; one component gives grey."""
    out = []
    sizes = [len(i.coefficients) for i in images]
    pool = np.concatenate([i.coefficients for i in images]) if images else np.zeros((0, 64), np.int16)
    same = all(set(q) and all((t == 1).all() for t in q.values()) for q in (i.quant for i in images))
    pixels = np.empty((len(pool), 64), np.uint8)
    scale = None if same else np.concatenate([np.repeat(i.quant[c.table][None], c.rows * c.cols, 0) for i in images for c in i.components])
    for a in range(0, len(pool), 2048):
        part = pool[a : a + 2048].astype(np.float64)
        if scale is not None:
            part *= scale[a : a + 2048]
        part = part @ _inverse()  # whole numbers below 2**53: exact
        part += 4096 + (128 << 13)
        part *= 1 / 8192
        np.floor(part, out=part)
        np.clip(part, 0, 255, out=part)
        pixels[a : a + 2048] = part
    at = 0
    for image, n in zip(images, sizes, strict=True):
        own, planes, first = pixels[at : at + n], [], image.components[0].first
        at += n
        hs, vs = max(c.h for c in image.components), max(c.v for c in image.components)
        for c in image.components:
            b = own[c.first - first : c.first - first + c.rows * c.cols]
            p = b.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
            p = p if c.v == vs else p.repeat(vs // c.v, 0)
            p = p if c.h == hs else p.repeat(hs // c.h, 1)
            planes.append(p[: image.height, : image.width])
        if len(planes) == 1:
            out.append(np.repeat(planes[0][:, :, None], 3, 2))
            continue
        y, cb, cr = planes[0].astype(np.int32), planes[1], planes[2]
        red, blue, g1, g2 = _chroma()
        rgb = np.empty((*y.shape, 3), np.uint8)
        rgb[..., 0] = np.clip(y + red[cr], 0, 255)
        rgb[..., 1] = np.clip(y + ((g1[cb] + g2[cr]) >> 16), 0, 255)
        rgb[..., 2] = np.clip(y + blue[cb], 0, 255)
        out.append(rgb)
    return out


@lru_cache(1)
def _chroma() -> tuple[np.ndarray, ...]:
    c = np.arange(256) - 128
    fixed = lambda f: np.rint(f * 65536 * c).astype(np.int32)
    return (fixed(1.402) + 32768) >> 16, (fixed(1.772) + 32768) >> 16, fixed(-0.344136), fixed(-0.714136) + 32768


# ---- encoding


def _pack(value: np.ndarray, size: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens (values of size <= 32 bits) that stand in order of their part, each part filled up with ones; bytes of each part."""
    total = np.bincount(part, size, parts).astype(np.int64)
    fill = -total % 8
    n_bytes = (total + fill) // 8
    begin = (np.cumsum(n_bytes) - n_bytes) * 8
    ends = np.cumsum(size)
    start = ends - size - (np.cumsum(total) - total)[part] + begin[part]
    out = np.zeros(int(n_bytes.sum()) + 5, np.float64)
    shifted = value.astype(np.uint64) << (40 - size - (start & 7)).astype(np.uint64)
    top = int((size + (start & 7)).max(initial=0) + 7) // 8
    for k in range(top):
        out += np.bincount((start >> 3) + k, ((shifted >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64), len(out))
    out = out[: int(n_bytes.sum())].astype(np.uint8)
    last = np.cumsum(n_bytes)[n_bytes > 0] - 1
    out[last] |= ((1 << fill[n_bytes > 0]) - 1).astype(np.uint8)
    return out, n_bytes


_SIZE = np.array([x.bit_length() for x in range(4096)])


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Additional bits and their number."""
    size = _SIZE[np.abs(v)] if np.abs(v).max(initial=0) < len(_SIZE) else np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)
    return np.where(v < 0, v + (1 << size) - 1, v), size


def _dc_tokens(values: np.ndarray, part: np.ndarray, member: np.ndarray, spec: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of DC values in scan order; differences start anew in each part and run within each component."""
    code, length, _ = codes(*spec)
    order = np.lexsort((np.arange(len(values)), member, part))
    v = values[order]
    diff = np.diff(v, prepend=0)
    new = np.concatenate([[True], (part[order][1:] != part[order][:-1]) | (member[order][1:] != member[order][:-1])])
    diff[new] = v[new]
    out = np.empty_like(diff)
    out[order] = diff
    extra, size = _bits_of(out)
    return code[size] << size | extra, length[size] + size


def _ac_tokens(band: np.ndarray, spec: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, size, block) tokens of the first scan of a band (blocks, coefficients after the point transform)."""
    code, length, _ = codes(*spec)
    n, width = band.shape
    block, col = np.nonzero(band)
    v = band[block, col].astype(np.int64)
    before = np.where(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)], -1, np.concatenate([[-1], col[:-1]])[: len(block)])
    run = col - before - 1
    extra, size = _bits_of(v)
    symbol = (run & 15) << 4 | size
    value, bits, place = code[symbol] << size | extra, length[symbol] + size, block * 256 + col + 1
    if (length[symbol] == 0).any():
        raise Broken("a symbol that the table lacks")
    last = np.full(n, -1)
    last[block] = col
    short = np.flatnonzero(last < width - 1)
    zrl = run >> 4
    if len(short) or zrl.any():
        if (len(short) and not length[0]) or (zrl.any() and not length[0xF0]):
            raise Broken("a symbol that the table lacks")
        far = np.repeat(block * 256 + col, zrl)
        value = np.concatenate([np.full(len(far), code[0xF0]), value, np.full(len(short), code[0])])
        bits = np.concatenate([np.full(len(far), length[0xF0]), bits, np.full(len(short), length[0])])
        place = np.concatenate([far, place, short * 256 + 255])
        # runs of 16 zeros stand before their coefficient
        order = np.argsort(place, kind="stable")
        value, bits, place = value[order], bits[order], place[order]
    return value, bits, place >> 8


def _refine_tokens(band: np.ndarray, al: int, spec: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, size, block) tokens of a refining scan of a band (blocks, quantised coefficients)."""
    code, length, _ = codes(*spec)
    size = np.abs(band.astype(np.int64)) >> al
    old, new = size > 1, size == 1
    fresh = new.any(1)
    # without new coefficients: the end of the block, then a bit for each old one
    block, col = np.nonzero(old & ~fresh[:, None])
    plain = np.flatnonzero(~fresh)
    value = [np.full(len(plain), code[0]), size[block, col] & 1]
    bits = [np.full(len(plain), length[0]), np.ones(len(block), np.int64)]
    place = [plain * 512, block * 512 + col + 1]
    for b in np.flatnonzero(fresh).tolist():
        run, held, done = 0, [], []
        for j in range(band.shape[1]):
            if old[b, j]:
                held.append(int(size[b, j] & 1))
                continue
            if new[b, j]:
                done += [(int(code[run << 4 | 1]), int(length[run << 4 | 1])), (int(band[b, j] > 0), 1), *((x, 1) for x in held)]
                run, held = 0, []
                continue
            run += 1
            if run == 16 and new[b, j + 1 :].any():
                done += [(int(code[0xF0]), int(length[0xF0])), *((x, 1) for x in held)]
                run, held = 0, []
        if run or held:
            done += [(int(code[0]), int(length[0])), *((x, 1) for x in held)]
        value.append(np.array([d[0] for d in done]))
        bits.append(np.array([d[1] for d in done]))
        place.append(b * 512 + np.arange(len(done)))
    value, bits, place = map(np.concatenate, (value, bits, place))
    order = np.argsort(place, kind="stable")
    return value[order], bits[order], place[order] >> 9


FULL = table(b"\x07", b"\x00", bytes(s for s in range(256) if s not in (0, 7)))
#: Scans of the usual kind for three components: (components, first, last, before, after the point transform).
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))


def encode_many(images: list[Image], script: tuple = SCRIPT, spec: tuple = FULL, restart: int = 2) -> list[bytes]:
    """Files of images that share their sampling, of which coefficients are set; restart: MCUs in an interval of any scan."""
    bodies: list[list[bytes]] = [[] for _ in images]
    base = 0
    for image in images:
        base = image.layout(base)
    coef = np.concatenate([i.coefficients for i in images])
    dc, tables = (DC_COUNTS, DC_SYMBOLS), b""
    for kind, (counts, symbols) in ((0x00, dc), (0x10, spec)):
        tables += bytes([kind, *counts]) + symbols
    head_tables = b"\xff\xc4" + (len(tables) + 2).to_bytes(2, "big") + tables + b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    for which, ss, se, ah, al in script:
        orders = [i.order(list(which)) for i in images]
        mcus = np.array([len(o) for o in orders])
        per = -(-mcus // restart)
        blocks = np.concatenate([o.ravel() for o in orders])
        wide = orders[0].shape[1]
        image_of = np.repeat(np.arange(len(images)), mcus * wide)
        nth = np.arange(len(blocks)) - np.repeat(np.cumsum(mcus * wide) - mcus * wide, mcus * wide)
        part = (np.cumsum(per) - per)[image_of] + nth // (wide * restart)
        if ss == 0 and ah == 0:
            comps = images[0].components
            member = np.tile([j for j, k in enumerate(which) for _ in range(comps[k].h * comps[k].v if len(which) > 1 else 1)], len(blocks) // wide)
            value, size = _dc_tokens(coef[blocks, 0].astype(np.int64) >> al, part, member, dc)
            token_part = part
        elif ss == 0:
            value, size, token_part = coef[blocks, 0].astype(np.int64) >> al & 1, np.ones(len(blocks), np.int64), part
        else:
            band = coef[blocks, ss : se + 1]
            if ah == 0:
                band = np.sign(band) * (np.abs(band) >> al)
                value, size, block = _ac_tokens(band, spec)
            else:
                value, size, block = _refine_tokens(band, al, spec)
            token_part = part[block]
        out, n_bytes = _pack(value, size, token_part, int(per.sum()))
        ends = np.cumsum(n_bytes)
        # zeros after FF, and restart markers after all parts but an image's last
        ff = np.flatnonzero(out == 255) + 1
        inner = np.ones(len(ends), bool)
        inner[np.cumsum(per) - 1] = False
        number = (np.arange(len(ends)) - np.repeat(np.cumsum(per) - per, per)) % 8
        cut = np.repeat(ends[inner], 2)
        marker = np.stack([np.full(inner.sum(), 255), 0xD0 + number[inner]], 1).ravel()
        where = np.concatenate([ff, cut])
        order = np.argsort(where, kind="stable")
        stuffed = np.insert(out, where[order], np.concatenate([np.zeros(len(ff)), marker])[order].astype(np.uint8))
        last = ends[np.cumsum(per) - 1]
        cuts = last + np.searchsorted(where[order], last, "right") if len(where) else last
        # a zero after an image's last FF belongs to it; its markers don't reach there
        head = b"\xff\xda" + (6 + 2 * len(which)).to_bytes(2, "big") + bytes([len(which), *(x for k in which for x in (k + 1, 0)), ss, se, ah << 4 | al])
        raw, a = stuffed.tobytes(), 0
        for body, z in zip(bodies, cuts.tolist(), strict=True):
            body += [head, raw[a:z]]
            a = z
    files = []
    for image, body in zip(images, bodies, strict=True):
        parts = [b"\xff\xd8", *(b"\xff\xfe" + (len(c) + 2).to_bytes(2, "big") + c for c in image.comments)]
        for k, q in image.quant.items():
            parts.append(b"\xff\xdb\x00\x43" + bytes([k]) + q.astype(np.uint8).tobytes())
        frame = bytes([8]) + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + bytes([len(image.components)]) + b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in image.components)
        parts.append(b"\xff\xc2" + (len(frame) + 2).to_bytes(2, "big") + frame)
        files.append(b"".join([*parts, head_tables, *body, b"\xff\xd9"]))
    return files

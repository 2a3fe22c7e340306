"""Secret scans: candidates by rules, false positives removed by a random forest.

Words that could take part in a secret (an assignment, a long word, the begin of a key block) are found by array operations over
the bytes, every word that a rule could match among them; the rules' expressions run over these words and their neighbours only. Each candidate becomes a row of numbers: length,
shares and changes of character classes, likelihood of its letter pairs in words, coverage by a dictionary, what its path
and its neighbouring words say. A forest of trees, grown in numpy from labelled findings, gives the probability that it is a secret.

Labelled findings are rows (value, key, before, after, path, secret); labelled_findings() makes a set of them by rule, for use
where no reviewed ones are at hand (MOST rows are used at most).

Defined results: null and empty texts have no findings; a null path or id says nothing and stays null; overlapping candidates
are one finding, the first rule's; repeated rows are scanned each; other columns are ignored by scan and kept by redact.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, mapped, pieces, spans, table, text_buffers

#: Trees, their depth, rows in a leaf at least, probability from which a finding is a secret, labelled rows used at most.
TREES, DEPTH, LEAF, THRESHOLD, MOST, SEED = 40, 9, 3, 0.5, 4000, 11
MASK = "[SECRET]"
# Words that stand near secrets, near placeholders and near hashes; dictionary; paths that hold examples.
KEYS = "password passwd pwd passphrase secret token apikey api_key access_key auth_token credential private_key".split()
PLACEHOLDERS = "example sample dummy test placeholder changeme your redacted xxxx fake demo todo none null undefined insert".split()
HASHES = "sha sha1 sha256 md5 commit checksum digest hash etag uuid guid revision integrity fingerprint crc".split()
WORDS = "the and for that with this from have not you are was but all can had her one our out day get has him his how man new now old see two way who boy did its let put say she too use key value name user admin test data file path host port server client config default example sample your token secret password access public private string number index table column count total page image video style class function return import module package version build release debug error warning info message request response header content type length status code time date year month local global static final main base core util helper model view controller service manager handler factory builder provider context session cache store state action event update insert delete select create remove change enter here replace placeholder dummy".split()
PATHS = "test tests example examples sample fixture docs doc demo mock".split()
#: Rules in order: name and expression; the value is group 'v', the key, where there is one, group 'k'.
RULES = (
    ("private_key", rb"(?P<v>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----.*?-----END [A-Z ]{0,20}PRIVATE KEY-----)"),
    ("aws_id", rb"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("prefixed", rb"(?<![A-Za-z0-9])(?P<v>(?:gh[pousr]|github_pat|glpat|sk|rk|xox[abprs])[-_][A-Za-z0-9_-]{16,})"),
    ("jwt", rb"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("assigned", rb"(?i)(?P<k>[a-z0-9_-]{0,30}(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credential|auth)[a-z0-9_-]{0,30})[\"']?\s{0,3}(?:=|:)>?\s{0,3}[\"']?(?P<v>[^\s\"',;<>]{6,})"),
    ("random", rb"(?<![A-Za-z0-9+/_-])(?P<v>(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2})"),
)
_RULES = [(n, re.compile(p, re.S)) for n, p in RULES]
#: Bytes of the shortest value of the rules 'prefixed', 'aws_id', 'jwt' and 'random'.
LONG = 19
_BEGIN = re.compile(rb"-----BEGIN")
_BLOCK_BEGIN, _BLOCK_END = re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), re.compile(rb"-----END [A-Z ]{0,20}PRIVATE KEY-----")
_DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK[[58, 61]] = True


def blocks(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the key blocks in a text, what the rule 'private_key' finds; unclosed begins cost nothing further."""
    ends, out, at = [m.end() for m in _BLOCK_END.finditer(raw)], [], 0
    for m in _BLOCK_BEGIN.finditer(raw):
        k = bisect_right(ends, m.end())
        while k < len(ends) and raw.rfind(b"-----END", m.end(), ends[k]) < 0:  # the begin's dashes are not the end's
            k += 1
        if k == len(ends):
            break
        if m.start() >= at:
            at = ends[k]
            out.append((m.start(), at))
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str, bytes]]:
    """(document, start, end, rule, key) of all candidates, byte positions in data, in order and without overlaps."""
    ss, es, on, marked = [], [], [], set()
    for at, to in pieces(data, offsets):
        s, e = spans(data, offsets, at, to)
        part = data[at:to]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[part], dtype=np.int32)])
        marks = np.concatenate([[0], np.cumsum(_MARK[part], dtype=np.int32)])
        # no rule without ':' or '=' matches fewer than LONG bytes, but for blocks
        hot = ((e - s >= 12) & (digits[e] > digits[s])) | (e - s >= LONG) | (marks[e] > marks[s])
        marked.update((np.searchsorted(offsets, [at + m.start() for m in _BEGIN.finditer(part.tobytes())], "right") - 1).tolist())
        ss.append(s + at)
        es.append(e + at)
        on.append(hot)
    if not ss:
        return []
    s, e, on = map(np.concatenate, (ss, es, on))
    held = {d: [(a + int(offsets[d]), z + int(offsets[d])) for a, z in blocks(data[offsets[d] : offsets[d + 1]].tobytes())] for d in marked}
    out = [(d, a, z, "private_key", b"") for d, found in held.items() for a, z in found]
    hot = np.flatnonzero(on)
    if len(hot):
        doc = np.searchsorted(offsets, s[hot], "right") - 1
        begin = np.maximum(s[np.maximum(hot - 3, 0)], offsets[doc])
        end = np.minimum(e[np.minimum(hot + 3, len(s) - 1)], offsets[doc + 1])
        new = np.flatnonzero(np.concatenate([[True], (begin[1:] > np.maximum.accumulate(end)[:-1]) | (doc[1:] != doc[:-1])]))
        for d, a, z in zip(doc[new].tolist(), begin[new].tolist(), np.maximum.reduceat(end, new).tolist(), strict=True):
            window, own = data[a:z].tobytes(), held.get(d, [])
            taken = bytearray(z - a)  # a candidate of an earlier rule is not one of a later rule
            for x, y in own[bisect_right(own, a, key=lambda b: b[1]) :]:
                if x >= z:
                    break
                taken[max(x, a) - a : min(y, z) - a] = b"\1" * (min(y, z) - max(x, a))
            for name, rule in _RULES[1:]:
                for m in rule.finditer(window):
                    x, y = m.span("v")
                    if taken.find(1, x, y) < 0:
                        taken[x:y] = b"\1" * (y - x)
                        out.append((d, x + a, y + a, name, m["k"] if "k" in rule.groupindex else b""))
    return sorted(out)


@lru_cache(1)
def _letter_pairs() -> np.ndarray:
    """Log likelihood of letter pairs in WORDS, against all pairs alike."""
    n = np.full((26, 26), 0.2)
    for w in WORDS:
        k = [ord(c) - 97 for c in w if c.isalpha()]
        for a, b in zip(k[:-1], k[1:], strict=True):
            n[a, b] += 1
    return np.log(n / n.sum() * 676)


def numbers(value: str, key: str, before: str, after: str, path: str | None, rule: str) -> list[float]:
    """A candidate's row for the forest."""
    n = max(len(value), 1)
    kind = "".join("d" if c.isdigit() else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "s" for c in value)
    low = value.lower()
    counts = np.unique(list(value) or [" "], return_counts=True)[1] / n
    pairs, letters = _letter_pairs(), [(ord(a) - 97, ord(b) - 97) for a, b in zip(low[:-1], low[1:], strict=True) if "a" <= a <= "z" and "a" <= b <= "z"]
    covered = np.zeros(n, bool)
    for w in {*WORDS, *PLACEHOLDERS, *KEYS}:
        if len(w) >= 3:
            for m in re.finditer(re.escape(w), low):
                covered[m.start() : m.end()] = True
    run = max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0)
    steps = [ord(b) - ord(a) for a, b in zip(low[:-1], low[1:], strict=True)]
    near = set(re.findall(r"[a-z0-9_]+", f"{before} {after}".lower()))
    keyed = f"{key} {before}".lower()
    parts = set(re.findall(r"[a-z]+", (path or "").lower()))
    names = [x[0] for x in RULES]
    return [
        n, np.log(n), *(kind.count(k) / n for k in "duls"), sum(a != b for a, b in zip(kind[:-1], kind[1:], strict=True)) / n,
        -(counts * np.log2(counts)).sum(), len(counts) / n, np.mean([pairs[p] for p in letters]) if letters else 0.0, covered.sum() / n, run / n,
        steps.count(1) / n, float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(n in (32, 40, 64)), float(any(k in keyed for k in KEYS)), float(any(k in low for k in PLACEHOLDERS)), float(bool(near & {*PLACEHOLDERS})),
        float(bool(near & {*HASHES})), float(bool(parts & {*PATHS})), float("$" in value or "{" in value or "(" in value), float(names.index(rule)),
    ]


def rule_of(value: str, key: str) -> str:
    """The rule that would find a labelled value."""
    text = f'{key} = "{value}"' if key else f" {value} "
    return next((n for n, r in _RULES if r.search(text.encode())), "random")


def labelled_findings(n: int = 3000, seed: int = 0) -> list[dict]:
    """n findings made by rule, half of them secrets."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for i in range(n):
        prose = lambda: " ".join("".join(pick(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "ea", "ti", "en", "es", "or"]) for _ in range(int(r.integers(1, 5)))) for _ in range(3))
        key, value, before, after, path = "", "", prose(), prose(), f"src{r.integers(40)}"
        if i % 2:
            kind = int(r.integers(6))
            if kind == 0:
                value = pick(["AKIA", "ASIA"]) + draw(upper, 16)
            elif kind == 1:
                key, value = pick(KEYS), draw(hexa, pick([16, 18, 20, 24, 32, 40, 40, 48, 64]))
            elif kind == 2:
                key, value = pick(KEYS), draw(mixed + pick(["", "+/", "_-", "!@#%^&*"]), int(r.integers(10, 48)))
            elif kind == 3:
                value = pick(["ghp_", "sk_", "glpat-", "xoxb-"]) + draw(mixed, int(r.integers(24, 40)))
            elif kind == 4:
                value = draw(mixed + "+/", int(r.integers(32, 64)))
            else:
                value = "eyJ" + ".".join(draw(mixed, int(r.integers(16, 60))) for _ in range(3))
            if key:
                before = f"{before} {key}"
        else:
            kind = int(r.integers(8))
            if kind == 0:
                key, value = pick(KEYS), pick(["your_{}_here", "example_{}", "changeme", "dummy-{}-value", "placeholder123", "test_{}", "insert-{}-here1", "xxxxxxxxxxxx", "************", "<{}>", "12345678", "abcdefgh1234", "password123"]).format(pick(KEYS))
            elif kind == 1:
                value, before = draw(hexa, pick([32, 40, 64])), f"{before} {pick(HASHES)}"
            elif kind == 2:
                value = "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))
            elif kind == 3:
                value = pick(["AKIA", "ASIA"]) + pick(["IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE12", "XXXXXXXXXXXXXXXX", "0000000000000000"])
            elif kind == 4:
                value = "_".join(pick(WORDS) for _ in range(int(r.integers(4, 7)))) + str(r.integers(100))
            elif kind == 5:
                key, value = pick(KEYS), pick(["${{{}}}", "os.environ['{}']", "config.get({})", "getenv({})", "self.{}_value", "get_{}()"]).format(pick(KEYS).upper())
            elif kind == 6:
                value, path = draw(mixed, int(r.integers(20, 40))), f"repo/{pick(PATHS)}/file"
            else:
                value = "/".join(pick(WORDS) for _ in range(int(r.integers(5, 9)))) + str(r.integers(10))
        out.append({"value": value, "key": key, "before": before, "after": after, "path": path, "secret": i % 2})
    return out


class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, and the share of secrets in a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, r.integers(0, len(y), len(y)), r) for _ in range(trees)]

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []
        todo = [(rows, 0, None)]
        while todo:
            rows, depth, parent = todo.pop()
            if parent is not None:
                nodes[parent[0]][parent[1]] = len(nodes)
            node, best = [-1, 0.0, 0, 0, float(y[rows].mean())], None
            if depth < DEPTH and len(rows) >= 2 * LEAF and 0 < node[4] < 1:
                for f in r.permutation(x.shape[1])[: int(np.sqrt(x.shape[1])) + 1]:
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, ones = x[order, f], np.cumsum(y[order])
                    k = np.arange(1, len(v))
                    ok = (v[1:] > v[:-1]) & (k >= LEAF) & (len(v) - k >= LEAF)
                    if ok.any():
                        a, b = ones[:-1], ones[-1] - ones[:-1]
                        impure = np.where(ok, a * (k - a) / k + b * (len(v) - k - b) / (len(v) - k), np.inf)
                        j = int(impure.argmin())
                        if best is None or impure[j] < best[0]:
                            best = (impure[j], f, (v[j] + v[j + 1]) / 2)
            if best:
                node[:2] = best[1:]
                left = x[rows, best[1]] <= best[2]
                todo += [(rows[~left], depth + 1, (len(nodes), 3)), (rows[left], depth + 1, (len(nodes), 2))]
            nodes.append(node)
        a = np.array(nodes, float)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (go := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(go, np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def train(findings: list[dict]) -> Forest:
    """A forest from labelled findings, a seeded sample of MOST of them if there are more."""
    if len(findings) > MOST:
        findings = [findings[i] for i in np.sort(np.random.default_rng(SEED).permutation(len(findings))[:MOST])]
    x = np.array([numbers(f["value"], f["key"], f["before"], f["after"], f["path"], rule_of(f["value"], f["key"])) for f in findings])
    return Forest(x, np.array([f["secret"] for f in findings], float))


def judged(forest: Forest, batch: pa.RecordBatch) -> list[tuple[int, int, int, str, float]]:
    """(document, start, end, rule, probability) of a batch's candidates; byte positions in the document."""
    data, offsets = text_buffers(batch.column("text"))
    found = candidates(data, offsets)
    if not found:
        return []
    paths, x = batch.column("source"), []
    for d, a, z, rule, key in found:
        words = lambda p, q, d=d: data[max(p, offsets[d]) : min(q, offsets[d + 1])].tobytes().decode("utf-8", "replace")
        before, after = words(a - 80, a).split()[-3:], words(z, z + 60).split()[:3]
        x.append(numbers(data[a:z].tobytes().decode("utf-8", "replace"), key.decode("utf-8", "replace"), " ".join(before), " ".join(after), paths[d].as_py(), rule))
    return [(d, a - int(offsets[d]), z - int(offsets[d]), rule, float(p)) for (d, a, z, rule, _), p in zip(found, forest.probability(np.array(x)), strict=True)]


def _with_path(docs: DataFrame, path: str) -> DataFrame:
    return docs if path in docs.columns else docs.withColumn(path, F.lit(None).cast("string"))


def scan(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """(doc_id, start, length, rule, value_sha256, score, is_secret): all candidates, in characters of the text."""
    given = docs.sparkSession.sparkContext.broadcast(forest)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(it, "text"):
            rows = []
            for d, a, z, rule, p in judged(given.value, batch):
                raw = batch.column("text")[d].as_buffer().to_pybytes()
                rows.append((batch.column("doc_id")[d].as_py(), len(raw[:a].decode("utf-8", "replace")), len(raw[a:z].decode("utf-8", "replace")), rule, hashlib.sha256(raw[a:z]).hexdigest(), p, p >= THRESHOLD))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "rule", "value_sha256", "score", "is_secret"])

    rows = _with_path(docs, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(path).alias("source"))
    return mapped(rows, run, "doc_id long, start long, length long, rule string, value_sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest, path: str = "source") -> DataFrame:
    """docs with MASK in place of each secret; n_chars, if there, counts the new text. All rows and columns stay."""
    given, schema = docs.sparkSession.sparkContext.broadcast(forest), docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(it, "text"):
            kept = batch.select([f.name for f in schema.fields])
            spots: dict[int, list[tuple[int, int]]] = {}
            for d, a, z, _, p in judged(given.value, batch):
                if p >= THRESHOLD:
                    spots.setdefault(d, []).append((a, z))
            if spots:
                columns = {c: kept.column(c) for c in kept.schema.names}
                texts = columns["text"].to_pylist()
                for d, cuts in spots.items():
                    raw = texts[d].encode()
                    for a, z in reversed(cuts):
                        raw = raw[:a] + MASK.encode() + raw[z:]
                    texts[d] = raw.decode()
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    n = columns["n_chars"].to_pylist()
                    for d in spots:
                        n[d] = len(texts[d])
                    columns["n_chars"] = pa.array(n, columns["n_chars"].type)
                kept = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield kept

    rows = _with_path(docs, path)
    return mapped(rows if path == "source" else rows.withColumn("source", F.col(path)), run, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's judgement."""
    return scan(table(spark, sf_dir, "documents"), train(labelled_findings()))

"""Fingerprints of files as hash trees over ranges of bytes, read by executors from any of Hadoop's file systems.

Lines are read in splits. A line's place in its file is what the splits before it hold (a row a split) and what its own split holds before it; the lines that begin in one range of
RANGE bytes are a leaf, whose digest covers them in order. Leaves are hashed where their lines are read; of a leaf that two splits share, each sends its bytes. FAN digests at a time are hashed
together, level by level, until a file has one, and the data set's fingerprint covers the files' names, sizes and roots. How Spark splits the files plays no part. A changed byte changes its leaf and
the root; leaves name the ranges that changed. SHA-256 of a whole file knows no parts: a file is one task's, which holds a batch of lines at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, hadoop, stored

#: Bytes of a leaf (and the rest of its last line), digests that are hashed together.
RANGE, FAN = 1 << 20, 1024
BOM = b"\xef\xbb\xbf"


def listed(spark: SparkSession, folder: str, names: list[str]) -> list[tuple[str, str, int]]:
    """(name, path, bytes) of files, or of the files in folders, of these names; FileNotFoundError if one is missing."""
    found, missing = [], []
    for name in sorted(names):
        fs, path = hadoop(spark, f"{folder.rstrip('/')}/{name}")
        if not fs.exists(path):
            missing.append(name)
            continue
        parts = [s for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        found += [(name if len(parts) == 1 and parts[0].getPath().getName() == name else f"{name}/{s.getPath().getName()}", s.getPath().toString(), s.getLen()) for s in parts]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return found


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, and _metadata): the files' lines, each with its end, byte for byte but for a mark of byte order; a last line without an end gets one."""
    return spark.read.option("lineSep", "\n").text(paths).withColumn("line", F.concat(F.col("value").cast("binary"), F.lit(b"\n")))


def _bytes(lines: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All lines' bytes, one after the other, and where each begins and the last ends."""
    lines = lines.cast(pa.large_binary())
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    return memoryview(lines.buffers()[2])[at[0] : at[-1]], at - at[0]


def whole(spark: SparkSession, files: list[tuple[str, str, int]]) -> dict[str, str]:
    """SHA-256 of each listed file. A file is read by one task from its begin to its end; a line must fit in a worker."""
    session = spark.newSession()  # settings of its own: no file is split, batches are bounded
    for key, value in (("files.maxPartitionBytes", 1 << 62), ("files.minPartitionNum", 1), ("execution.arrow.maxRecordsPerBatch", 10_000), ("execution.arrow.maxBytesPerBatch", 4 << 20)):
        session.conf.set(f"spark.sql.{key}", str(value))

    def head(path: str) -> bytes:
        fs, p = hadoop(spark, path)
        stream = fs.open(p)
        try:
            return bytes(x & 255 for x in (stream.read() for _ in BOM) if x >= 0)
        finally:
            stream.close()

    def hashed(name: str, path: str, size: int) -> DataFrame:
        mark = BOM if head(path) == BOM else b""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, held, end = hashlib.sha256(mark), len(mark), b""
            for batch in it:
                if batch.num_rows:
                    data, _ = _bytes(batch.column(0))
                    state.update(end)
                    state.update(data[:-1])
                    held, end = held + len(data), b"\n"
            if held == size:
                state.update(end)
            elif held != size + 1:  # the last line has no end
                raise OSError(f"{path} changed as it was read: {size} bytes listed, {held} read")
            yield pa.RecordBatch.from_pydict({"file": [name], "digest": [state.hexdigest()]})

        return _read(session, [path]).select("line").mapInArrow(run, "file string, digest string")

    found = {n: hashlib.sha256(head(p)).hexdigest() for n, p, size in files if size <= len(BOM)}
    frames = [hashed(*f) for f in files if f[0] not in found]
    for at in range(0, len(frames), 100):
        some = frames[at]
        for other in frames[at + 1 : at + 100]:
            some = some.unionByName(other)
        found |= {r["file"]: r["digest"] for r in some.collect()}
    return found


_PARTS = "block long, range long, offset long, lines long, bytes long, digest string, raw binary"


def _hashed(size: int, blocks: list[tuple[int, bool]]):
    """Leaves of lines (block, line) in order; blocks: bytes of their file before them, and whether they are its last. A leaf that may go on in another split comes as its bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, last, leaf = None, 0, False, None
        out: list[tuple] = []

        def close(complete: bool) -> None:
            nonlocal leaf
            if leaf is not None:
                where, offset, lines, parts, begun = leaf
                data = b"".join(parts)
                done = begun and complete
                out.append((block, where, offset, lines, len(data), hashlib.sha256(data).hexdigest() if done else None, None if done else data))
            leaf = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            names = ("block", "range", "offset", "lines", "bytes", "digest", "raw")
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.binary())
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
            out.clear()
            return found

        for batch in it:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy(zero_copy_only=False)
            data, place = _bytes(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if number[a] != block:
                    close(last)
                    block = int(number[a])
                    at, last = blocks[block]
                    begun = at == 0  # the first line of a later split may stand in a leaf that the split before began
                ranges = (place[a:b] - place[a] + at) // size
                runs = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), b - a]
                for c, e in zip(runs, runs[1:]):
                    if leaf is None or leaf[0] != ranges[c]:
                        if leaf is not None:
                            close(True)
                            begun = True
                        leaf = [int(ranges[c]), int(place[a + c] - place[a]) + at, 0, [], begun]
                    leaf[2] += e - c
                    leaf[3].append(bytes(data[place[a + c] : place[a + e]]))
                at += int(place[b] - place[a])
            if out:
                yield rows()
        close(last)
        if out:
            yield rows()

    return run


def leaves(spark: SparkSession, files: list[tuple[str, str, int]], size: int = RANGE) -> DataFrame:
    """(file, range, lines, bytes, digest): the leaves of the listed files; empty files have none."""
    schema = "file string, range long, lines long, bytes long, digest string"
    if not files:
        return spark.createDataFrame([], schema)
    plain = lambda path: "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path
    names = {plain(p): n for n, p, _ in files}
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    text = _read(spark, [p for _, p, _ in files])
    held = text.groupBy(*place).agg(F.sum(F.octet_length("line")).alias("held")).collect()  # a row a split
    held.sort(key=lambda r: (r["path"], r["start"]))
    blocks, before = [], 0
    for k, r in enumerate(held):
        before = before if k and held[k - 1]["path"] == r["path"] else 0
        blocks.append((k, r["path"], r["start"], before, k + 1 == len(held) or held[k + 1]["path"] != r["path"], names[plain(r["path"])]))
        before += r["held"]
    known = spark.createDataFrame([(k, path, start, file) for k, path, start, _, _, file in blocks], "block long, path string, start long, file string")
    lines = text.select(*place, "line").join(F.broadcast(known.drop("file")), ["path", "start"]).select("block", "line")  # lines of a split stand together, in order
    parts = lines.mapInArrow(_hashed(size, [(b[3], b[4]) for b in blocks]), _PARTS).join(F.broadcast(known.select("block", "file")), "block")
    found = parts.groupBy("file", "range").agg(F.array_sort(F.collect_list(F.struct("offset", "raw", "digest"))).alias("l"), F.sum("lines").cast("long").alias("lines"), F.sum("bytes").cast("long").alias("bytes"))
    joined = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["raw"]))
    return found.select("file", "range", "lines", "bytes", F.when(F.col("l")[0]["digest"].isNull(), F.sha2(joined, 256)).otherwise(F.col("l")[0]["digest"]).alias("digest"))


def roots(tree: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, leaves, digest) of leaves: each file's root."""
    level = tree.select("file", F.col("range").alias("at"), "digest")
    counts = tree.groupBy("file").agg(F.count("*").alias("leaves"), F.max("range").alias("last"))
    most = counts.agg(F.max("last")).first()[0]
    while most is not None and most > 0:
        level = level.groupBy("file", F.expr(f"at div {fan}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("d")).select("file", "at", F.sha2(F.array_join("d.digest", ""), 256).alias("digest"))
        most //= fan
    return level.select("file", "digest").join(counts.select("file", "leaves"), "file").select("file", "leaves", "digest")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, range, change): leaves that were added, removed or changed."""
    a, b = before.select("file", "range", F.col("digest").alias("old")), after.select("file", "range", F.col("digest").alias("new"))
    both = a.join(b, ["file", "range"], "full_outer").filter("NOT (old <=> new)")
    return both.select("file", "range", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def marks(spark: SparkSession, folder: str, names: list[str]) -> list[tuple[str, int, str]]:
    """(file, size, root) of the files of these names, in order; the driver reads a row a file."""
    files = listed(spark, folder, names)
    tree = stored(leaves(spark, files), "leaves")  # each level would read the files again
    found = {r["file"]: r["digest"] for r in roots(tree).collect()}
    discard(tree)
    return [(n, size, found.get(n, "")) for n, _, size in sorted(files)]


def digest(held: list[tuple[str, int, str]]) -> str:
    """SHA-256 over names, sizes and roots."""
    return hashlib.sha256("".join(f"{n}\0{size}\0{root}\n" for n, size, root in held).encode()).hexdigest()


def fingerprint(spark: SparkSession, folder: str, names: list[str]) -> str:
    """SHA-256 over names, sizes and roots of the files of these names."""
    return digest(marks(spark, folder, names))

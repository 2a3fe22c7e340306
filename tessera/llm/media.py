"""Media columns: bytes kept losslessly as coefficients of progressive JPEGs, and pixels read from them.

The format's own unit is the quantised coefficient, which its scans carry exactly (pixels aren't: the transform rounds). A byte b is
the coefficient b, or b - 255 below 128: of eight bits' size either way, in a 4:2:0 image of three components whose blocks the
payload fills one after another. A comment holds the payload's length. Reading goes through all scans of the file, spectral
selection and successive approximation, into coefficients, and from these to the payload and to the full-resolution RGB tensor.

Defined results: null and empty texts are 576 bytes of 255; repeated rows are stored each, alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_bytes, table, text_buffers
from .jpeg import Broken, Component, Image, decode_many, encode_many, to_rgb
from .jpeg import table as code_table

#: Payloads are padded to a multiple of this; MCUs in a row of the image at most (65,535 pixels are 4,095).
UNIT, ROW = 576, 64
_TABLE = code_table(b"\x07", b"\x00")


def image_of(payload: bytes) -> Image:
    """The image whose coefficients are a payload of a multiple of 64 bytes."""
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    rows = -(-mcus // ROW)
    if rows > 4095:  # very long: as near to a square as it gets
        rows = int(np.ceil(np.sqrt(mcus)))
    cols = -(-mcus // rows)
    if rows > 4095 or cols > 4095:
        raise ValueError("the payload is beyond the format's largest image")
    image = Image(16 * cols, 16 * rows, [Component(1, 2, 2, 0), Component(2, 1, 1, 0), Component(3, 1, 1, 0)], {0: np.ones(64, np.int64)}, [b"payload %d" % len(payload)])
    b = np.frombuffer(payload, np.uint8).astype(np.int16)
    image.coefficients = np.zeros((6 * rows * cols, 64), np.int16)
    image.coefficients.reshape(-1)[: len(b)] = np.where(b < 128, b - 255, b)
    return image


def payload_of(image: Image) -> bytes:
    """The payload that an image's coefficients hold."""
    n = next((int(c[8:]) for c in image.comments if c.startswith(b"payload ")), None)
    if n is None or n > image.coefficients.size:
        raise Broken("no payload")
    v = image.coefficients.reshape(-1)[:n]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def store(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload."""
    return encode_many([image_of(p) for p in payloads], spec=_TABLE) if payloads else []


def feature(rgb: np.ndarray) -> str:
    """Size and mean colour of a tensor, and an average hash of 4 x 4 cells of its green channel."""
    h, w, _ = rgb.shape
    n = h * w
    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    green = rgb[:, :, 1]
    cells = np.add.reduceat(np.add.reduceat(green, np.arange(4) * h // 4, 0, dtype=np.int64), np.arange(4) * w // 4, 1)
    bits = (cells * 16 > cells.sum()).ravel()
    return f"{w}x{h}:{':'.join(f'{x / n:.3f}' for x in mean)}:{int(''.join('01'[int(b)] for b in bits), 2):04x}"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def media(docs: DataFrame, with_media: bool = False, with_rgb: bool = False) -> DataFrame:
    """Of (doc_id, text): the contract's columns, and the file and the tensor (rgb binary, height, width) if wanted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(it, "text", 1 << 20):
            data, offsets = text_buffers(batch.column("text"))
            raw = data.tobytes()
            files = store([padded(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            images = decode_many(files)
            read = [payload_of(i) for i in images]
            tensors = to_rgb(images)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array(np.diff(offsets)),
                "payload_bytes": pa.array([len(p) for p in read], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in read]),
                "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in read], pa.int64()),
                "media_bytes": pa.array([len(f) for f in files], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                "feature": pa.array([feature(t) for t in tensors]),
            }
            if with_media:
                columns["media"] = pa.array(files, pa.binary())
            if with_rgb:
                columns |= {"rgb": pa.array([t.tobytes() for t in tensors], pa.binary()), "height": pa.array([t.shape[0] for t in tensors], pa.int32()), "width": pa.array([t.shape[1] for t in tensors], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * with_media + ", rgb binary, height int, width int" * with_rgb
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a progressive JPEG and read back."""
    return media(table(spark, sf_dir, "documents"))

"""Media columns of progressive JPEG: RGB tensors of images, and payloads kept losslessly in images.

`decode_images` turns a column of files into tensors (height, width, RGB bytes). A null file gives
a null tensor; a damaged file, or one of another kind, gives a null tensor and its error.

`store_payloads` keeps a text's bytes, padded with spaces to a positive multiple of 192, as the
quantised coefficients of an image: 3 components of 64 coefficients a block, each a byte less 128.
Scans are coded without loss, so the bytes come back exactly. It reads every file back through the
decoder and describes the decoded RGB tensor. A null text is stored as an empty one. Rows are
independent and equal texts give equal files; empty tables need no rule. Only id and text (or file)
are read, whatever further columns are named.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm import progressive_jpeg as jpeg
from vespera.llm.common import blocks, map_arrow, strings

UNIT = 192


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_files(payloads: list[bytes]) -> list[bytes]:
    """One image for each payload; its comment holds the payload's size."""
    images = []
    for p in payloads:
        n = len(p) // UNIT
        wide, high = jpeg.shape_of(n)
        grid = np.zeros((wide * high, 3, 64), np.int16)
        grid[:n] = np.frombuffer(p, np.uint8).reshape(n, 3, 64).astype(np.int16) - 128
        images.append(grid.reshape(high, wide, 3, 64))
    return jpeg.encode(images, [b"%d" % len(p) for p in payloads])


def from_images(images: list[jpeg.Image]) -> list[bytes]:
    out = []
    for im in images:
        full = np.stack([c.reshape(-1, 64) for c in im.coefficients], axis=1)
        out.append((full.reshape(-1)[: int(im.note)] + 128).astype(np.uint8).tobytes())
    return out


def tensor_sums(images: list[jpeg.Image], most_blocks: int = 8192) -> list[str]:
    """Size of each image's RGB tensor and the sum of each channel, of images without subsampling."""
    counts = np.array([im.coefficients[0].shape[0] * im.coefficients[0].shape[1] for im in images])
    planes = [np.concatenate([im.coefficients[c].reshape(-1, 64) for im in images]) for c in range(3)]
    total = np.zeros((int(counts.sum()), 3), np.int64)
    for a in range(0, len(total), most_blocks):
        y, cb, cr = (jpeg.samples(p[a : a + most_blocks], np.ones(64, np.float32)) for p in planes)
        total[a : a + most_blocks] = jpeg.to_rgb(y, cb, cr).sum(axis=1, dtype=np.int64)
    sums = np.add.reduceat(total, np.cumsum(counts) - counts)
    return [f"{im.width}x{im.height} rgb {r} {g} {b}" for im, (r, g, b) in zip(images, sums.tolist(), strict=True)]


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def describe(texts: list[str]) -> list[tuple]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    files = to_files([padded(r) for r in raw])
    images = jpeg.decode(files)
    found = from_images(images)
    return [
        (len(r), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), s)
        for r, p, f, s in zip(raw, found, files, tensor_sums(images), strict=True)
    ]


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: bool = False) -> DataFrame:
    """id, sizes and digests of payload and file, feature; with `files` the file itself as `media`. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 2 << 20):
            texts = strings(part.column("text"))
            rows = describe(texts)
            arrays = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
            media = [pa.array(to_files([padded(t.encode("utf-8", "surrogatepass")) for t in texts]), pa.binary())] if files else []
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays, *media], ["id", *NAMES, *["media"] * files])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(rows, run, schema + (", media binary" if files else "")).withColumnRenamed("id", id_col)


def read_payloads(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, payload of stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "media", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(from_images(jpeg.decode(part.column("media").to_pylist())), pa.binary())], ["id", "payload"])

    rows = stored.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, payload binary").withColumnRenamed("id", id_col)


def decode_images(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, height, width, rgb (height x width x 3 bytes), error."""

    def tensor(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None
        try:
            im = jpeg.decode([data])[0]
            return im.height, im.width, jpeg.rgb(im).tobytes(), None
        except (ValueError, KeyError, IndexError, TypeError, jpeg.struct.error) as e:
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "media", 1 << 20):
            found = zip(*map(tensor, part.column("media").to_pylist()), strict=True)
            arrays = [pa.array(x, k) for x, k in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", "height", "width", "rgb", "error"])

    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, height int, width int, rgb binary, error string").withColumnRenamed("id", id_col)

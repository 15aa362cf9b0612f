"""Media columns: texts kept as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from . import webp

#: Payloads are filled up to a multiple of this, which is also an image's width.
UNIT = 64
#: Samples of an image; longer payloads become several files one after the other.
IMAGE = UNIT << 14


def payload(text: str | bytes | None) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of ``UNIT``."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def store(data: bytes) -> bytes:
    """``data`` (a positive multiple of ``UNIT`` bytes) as lossless WebP files one after the other."""
    samples = np.frombuffer(data, np.uint8)
    return b"".join(webp.encode_gray(samples[i : i + IMAGE].reshape(-1, UNIT)) for i in range(0, len(samples), IMAGE))


def load(stored: bytes) -> list[np.ndarray]:
    """Pixel arrays (height x width x 4) of the files of ``stored``."""
    out, at = [], 0
    while at < len(stored):
        size = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(webp.decode(stored[at : at + size]))
        at += size
    return out


def samples_of(images: list[np.ndarray]) -> bytes:
    """The samples of gray images."""
    return b"".join(np.ascontiguousarray(i[:, :, 1]).tobytes() for i in images)


def features(images: list[np.ndarray]) -> str:
    """Width, height, mean sample and number of values of the images together."""
    counts = sum(np.bincount(i[:, :, 1].ravel(), minlength=256) for i in images)
    n = int(counts.sum())
    mean = int((counts * np.arange(256)).sum()) * 1000 // n
    return f"{images[0].shape[1]}x{sum(i.shape[0] for i in images)}:{mean // 1000}.{mean % 1000:03d}:{int((counts > 0).sum())}"


def to_media(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, the stored form, and what reading it back gives.

    payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload bytes), media_bytes, media_sha256, feature; with
    ``with_media`` also media (the WebP files). A null text is as an empty one: 64 zero bytes. Equal texts give equal values;
    rows that repeat get a row each; null ids stay; other columns aren't looked at. An image has at most 2**20 samples,
    longer texts become several, so memory follows the longest text.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if with_media else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def one(text: bytes | None) -> tuple:
        stored = store(payload(text))
        images = load(stored)
        back = samples_of(images)
        return (len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(images)) + ((stored,) if with_media else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = [one(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=False)]], names)

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def from_media(rows: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, width, height and pixels (bytes, red green blue alpha) of lossless WebP columns; nulls where a value is null or no such image."""

    def one(data: bytes | None) -> tuple:
        try:
            image = webp.decode(data or b"")
        except webp.WebPError:
            return None, None, None
        return image.shape[1], image.shape[0], image.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                got = list(zip(*[one(t) for t in part.column(1).to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got[0], pa.int32()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.binary())], ["doc_id", "width", "height", "pixels"])

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), run, "doc_id long, width int, height int, pixels binary")


def query(spark, sf_dir: str) -> DataFrame:
    return to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)

"""Media columns: lossless WebP stored in and read from binary columns.

``store_texts`` puts the UTF-8 bytes of each text, padded with zeros to a positive
multiple of 64, into lossless WebP: a byte is a grey pixel, 64 pixels a row, TILE_ROWS
rows a file; longer payloads are several files one after the other (a RIFF file states
its length). ``load_payloads`` decodes such columns again and ``read_pixels`` writes the
pixel arrays of any lossless WebP column, extended files included.

A tile is stored with the subtract-green transform under prefix codes of its own counts,
with back-references where that is smaller, or with a palette where it has few values and
that is smaller. None of the other features ever makes text smaller; so that what is
stored keeps exercising all that the reader promises, one tile in PROBES each (by a hash
of its bytes) takes the predictor, cross-colour in place of subtract-green, the colour
cache, or a palette whatever its values, at the cost of a few bytes.

Every row is worked on by itself: no shuffle, memory bounded by an Arrow batch and, in
it, by groups of about CHUNK_BYTES.

Edge cases: a null or empty text is one row of zeros (64 bytes); equal texts have equal
files; repeated rows are stored each; a very long text is many tiles; bytes that are
no lossless WebP give null (read_pixels) or raise BadImage (load_payloads); input
columns named like the new ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import webp
from riskloom.llm.common import table, tune
from riskloom.llm.textops import chunks

WIDTH = ROW_BYTES = 64
TILE_ROWS = 128
#: Of so many tiles one takes each of the features that text never needs.
PROBES = 512
#: Most values of a tile that is tried with a palette.
FEW = 16


def payloads(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padded bytes, offsets) of each text's payload."""
    size = np.diff(offs)
    padded = np.maximum(1, -(-size // ROW_BYTES)) * ROW_BYTES
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offs[:-1], size)] = data
    return out, at


def _pixels(tile: np.ndarray) -> np.ndarray:
    out = np.repeat(tile, 4).reshape(-1, WIDTH, 4)
    out[..., 3] = 255
    return out


def _other_form(tile: np.ndarray, usual: bytes) -> bytes:
    """The file of a tile that doesn't stay in its usual form."""
    draw = zlib.crc32(tile.tobytes()) % PROBES
    if draw == 0:
        rows = -(-len(tile) // WIDTH // 8)
        modes = np.repeat(1 + np.arange(rows)[:, None] % 2, WIDTH // 8, axis=1)  # left and top in turn
        return webp.encode_image(_pixels(tile), ("predictor", "green"), references=True, block_bits=3, modes=modes)
    if draw == 1:
        rows = -(-len(tile) // WIDTH // 8)
        return webp.encode_image(_pixels(tile), ("cross",), block_bits=3, multipliers=np.full((rows, WIDTH // 8), 0xFF002020))
    if draw == 2:
        return webp.encode_image(_pixels(tile), ("green",), cache_bits=6)
    if draw == 3:
        return webp.encode_image(_pixels(tile), ("palette",), references=True)
    if np.count_nonzero(np.bincount(tile)) <= FEW:
        short = webp.encode_image(_pixels(tile), ("palette",), references=True)
        return short if len(short) < len(usual) else usual
    return usual


def store(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """The stored form of each text of a group."""
    padded, at = payloads(data, offs)
    step = TILE_ROWS * ROW_BYTES
    tiles = [padded[a : min(a + step, z)] for lo, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for a in range(lo, z, step)]
    files = [_other_form(t, f) for t, f in zip(tiles, webp.encode_gray(tiles, WIDTH), strict=True)]
    out, k = [], 0
    for n in -(-np.diff(at) // step):
        out.append(b"".join(files[k : k + n]))
        k += n
    return out


def split_files(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        n = 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        out.append(stored[at : at + n])
        at += n
    return out


def load(stored: list[bytes]) -> list[np.ndarray]:
    """The payload of each stored form."""
    files = [split_files(s) for s in stored]
    images = webp.decode_green([f for fs in files for f in fs])
    out, k = [], 0
    for fs in files:
        parts = images[k : k + len(fs)]
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8))
        k += len(fs)
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_bytes, media)."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(store(data, offs), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _groups(b: pa.RecordBatch, column: str, most: int = 2_000_000):
    size = np.array([len(x.as_buffer()) for x in b.column(column)])
    group = np.cumsum(size) // most
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield b.slice(int(at[0]), len(at))


def load_payloads(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media) with the payload read back in place of media."""

    def run(batches):
        for b in batches:
            for part in _groups(b, "media"):
                back = load(part.column("media").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array([x.tobytes() for x in back], pa.binary())], ["doc_id", "n_bytes", "payload"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary")


def read_pixels(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, width, height, pixels): the pixels as B, G, R, A bytes, row by row; null for what can't be decoded."""

    def run(batches):
        for b in batches:
            keys, ws, hs, px = b.column(0), [], [], []
            for f in b.column(1).to_pylist():
                try:
                    image = webp.decode_images([f])[0] if f is not None else None
                except (webp.BadImage, IndexError):
                    image = None
                ws.append(None if image is None else image.shape[1])
                hs.append(None if image is None else image.shape[0])
                px.append(None if image is None else image.tobytes())
            yield pa.RecordBatch.from_arrays([keys, pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(px, pa.binary())], [key, "width", "height", "pixels"])

    src = df.select(key, column)
    return src.mapInArrow(run, f"{key} {src.schema[0].dataType.simpleString()}, width int, height int, pixels binary")


def features(payload: np.ndarray) -> str:
    """Rows, mean sample, mean absolute step between samples and the share of non-zero samples, to six places."""
    x = payload.astype(np.int32)
    step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    return f"rows={len(x) // ROW_BYTES};mean={x.mean():.6f};step={step:.6f};filled={np.count_nonzero(x) / max(len(x), 1):.6f}"


def digests(stored: DataFrame) -> DataFrame:
    """stored(doc_id, n_bytes, media) read back, with digests of both forms and the features."""

    def run(batches):
        for b in batches:
            for part in _groups(b, "media"):
                media = part.column("media").to_pylist()
                back = load(media)
                cols = [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-64:].tobytes()) for x in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([features(x) for x in back]),
                ]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGEST)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digests(store_texts(table(spark, sf_dir, "documents")))

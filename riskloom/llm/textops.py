"""Whole texts as byte arrays: words, hashes and chunks, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in groups of about this many bytes (a longer text is a group of its own).
CHUNK_BYTES = 2_000_000
#: The same where arrays of eight bytes for each byte of text add up: what a worker has once taken it mostly keeps.
LEAN_BYTES = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

#: One fixed 64-bit value per byte.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=_U) | _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base ("up") or of its inverse modulo 2**64 ("down")."""
    if len(_POWERS[kind]) < n:
        grown = np.full(1 << (n - 1).bit_length(), _BASE if kind == "up" else _INVERSE, _U)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[kind] = np.multiply.accumulate(grown)
    return _POWERS[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(texts) else np.zeros(1, np.int64)


def chunks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for groups of whole texts of about ``size`` bytes (CHUNK_BYTES)."""
    data, offs = buffers(texts)
    size = CHUNK_BYTES if size is None else size
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """P with P[i] the hash sum of the first i bytes; see span_hash."""
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans [start, end): equal bytes, equal hashes."""
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * powers("down", len(prefix))[start]
        return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) for runs of bytes outside ``breaks``."""
    word = ~breaks[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)

"""Lossless WebP: a decoder that works on many images at once, and two encoders.

``decode_images`` reads every feature of the lossless format, in simple and extended
files: prefix codes (simple and normal, several groups), back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Headers
are parsed one image after the other; the pixel streams of a batch are decoded in step,
one symbol of each image at a time, by numpy gathers into code tables side by side.

``encode_gray`` writes many grey images in one go: the subtract-green transform, prefix
codes of each image's own counts and, where that is smaller, back-references.
``encode_image`` is a plain encoder, pixel by pixel, that can use every transform, the
cache and back-references.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

MAX_LENGTH = 15
N_LENGTH, N_DISTANCE = 24, 40
#: Fixed by the format: the order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 short distances: neighbours by distance, then lower rows first, then right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
_NEAR = np.array(NEAR)
_CACHE_HASH = 0x1E35A7BD
#: So many streams of a batch that aren't plain are decoded one by one.
FEW = 32
#: Plain streams of at most so many bytes and pixels are looked up at all of their bits, so many bits or pixels at a time, in strides of so many symbols.
PLAIN_BYTES, PLAIN_PIXELS, BLOCK_BITS, STRIDE = 1 << 18, 1 << 20, 1 << 19, 16


#: So many prefix codes of like size are worked out side by side.
HUFFMAN_ROWS = 256
_MERGED = np.iinfo(np.int64).max


class BadImage(ValueError):
    """The bytes are no lossless WebP image."""


# ---------------------------------------------------------------- bits and codes


class BitReader:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, len(data) * 8

    def read(self, n: int) -> int:
        if self.pos + n > self.end:
            raise BadImage("truncated")
        a = self.pos >> 3
        out = int.from_bytes(self.data[a : a + 8], "little") >> (self.pos & 7) & ((1 << n) - 1)
        self.pos += n
        return out


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= (value & ((1 << n) - 1)) << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


_REVERSED = np.array([int(format(i, "015b")[::-1], 2) for i in range(1 << MAX_LENGTH)], np.int64)


def canonical_many(lengths: np.ndarray) -> np.ndarray:
    """Codes for each row of code lengths at once, their bits in reading order (first bit lowest)."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    size = np.int64(1) << (MAX_LENGTH - n)
    before = np.cumsum(size) - size
    out = np.zeros(lengths.shape, np.uint64)
    out[row, symbol] = _REVERSED[before - before[np.searchsorted(row, row)]] if len(row) else 0
    return out


def canonical(lengths) -> list[int]:
    return canonical_many(np.array([list(lengths)])).tolist()[0]


_TABLES: dict[bytes, np.ndarray] = {}


def code_table(lengths) -> np.ndarray:
    """2**width entries symbol << 4 | bits to skip; one symbol alone needs no bits."""
    key = np.asarray(lengths, np.uint8).tobytes()
    if key in _TABLES:
        return _TABLES[key]
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        table = np.zeros(1, np.int32)
    elif len(used) == 1:
        table = np.array([used[0] << 4], np.int32)
    else:
        if sum(2.0 ** -lengths[s] for s in used) != 1:
            raise BadImage("incomplete prefix code")
        # in the order of codes each symbol fills its share; places are read with the first bit lowest
        n = np.array([lengths[x] for x in used])
        width = int(n.max())
        order = np.argsort(n, kind="stable")
        table = np.empty(1 << width, np.int32)
        table[_REVERSED[: 1 << width] >> (MAX_LENGTH - width)] = np.repeat((np.array(used)[order] << 4) | n[order], 1 << (width - n[order]))
    if len(_TABLES) > 256:
        _TABLES.clear()
    _TABLES[key] = table
    return table


def _read_symbol(r: BitReader, table: np.ndarray) -> int:
    a = r.pos >> 3
    e = int(table[int.from_bytes(r.data[a : a + 4], "little") >> (r.pos & 7) & (len(table) - 1)])
    r.read(e & 15)
    return e >> 4


def read_code(r: BitReader, size: int) -> np.ndarray:
    lengths = [0] * size
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise BadImage("symbol out of range")
            lengths[s] = 1
        return code_table(lengths)
    first = [0] * 19
    for k in range(4 + r.read(4)):
        first[LENGTH_ORDER[k]] = r.read(3)
    table = code_table(first)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = _read_symbol(r, table)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        n, v = (3 + r.read(2), before) if s == 16 else (3 + r.read(3), 0) if s == 17 else (11 + r.read(7), 0)
        if at + n > size:
            raise BadImage("too many code lengths")
        lengths[at : at + n] = [v] * n
        at += n
    return code_table(lengths)


def code_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the code_table of each row of code lengths side by side, where each begins, their sizes less one)."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol].astype(np.int64)
    used = np.bincount(row, minlength=len(lengths))
    if (np.bincount(row, 1 << (MAX_LENGTH - n), len(lengths))[used > 1] != 1 << MAX_LENGTH).any():
        raise BadImage("incomplete prefix code")
    n[used[row] == 1] = 0
    width = np.zeros(len(lengths), np.int64)
    width[used > 1] = lengths[used > 1].max(1)
    at = np.cumsum(1 << width) - (1 << width)
    order = np.argsort(row << 4 | n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    share = 1 << (width[row] - n)
    owner = np.repeat(row, share)
    place = np.arange(len(owner)) - (np.cumsum(1 << width * (used > 0)) - (1 << width) * (used > 0))[owner]
    flat = np.zeros(int((1 << width).sum()), np.int64)
    flat[at[owner] + (_REVERSED[place] >> (MAX_LENGTH - width[owner]))] = np.repeat(symbol << 4 | n, share)
    return flat, at, (1 << width) - 1


# what a code length symbol stands for: so many extra bits, at least so many lengths
_LENGTH_EXTRA, _LENGTH_RUN = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])


def read_codes(window: np.ndarray, pos: np.ndarray, limit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(code lengths, bits behind them): read_code for one code of each of many images, in step."""
    lengths, pos = np.zeros((len(pos), size), np.uint8), pos.copy()
    w = _look(window, pos)
    simple = np.flatnonzero(w & 1)
    if len(simple):
        v = w[simple]
        two, wide = v >> 1 & 1, v >> 2 & 1
        a, n = v >> 3 & np.where(wide, 255, 1), np.where(wide, 11, 4)
        b = np.where(two, v >> n & 255, a)
        if max(a.max(), b.max()) >= size:
            raise BadImage("symbol out of range")
        lengths[simple, a] = lengths[simple, b] = 1
        pos[simple] += n + 8 * two
    act = np.flatnonzero(w & 1 == 0)
    if len(act):
        n = 4 + (w[act] >> 1 & 15)
        v = _look(window, pos[act] + 5) | _look(window, pos[act] + 53) << 48
        ks = np.arange(19)
        first = np.zeros((len(act), 19), np.uint8)
        first[:, LENGTH_ORDER] = np.where(ks < n[:, None], v[:, None] >> 3 * ks & 7, 0)
        to = pos[act] + 5 + 3 * n
        flat, table, mask = code_tables(first)
        v = _look(window, to)
        n = 2 + 2 * (v >> 1 & 7)
        left = np.where(v & 1, 2 + (v >> 4 & (1 << n) - 1), size)
        to += np.where(v & 1, 4 + n, 1)
        at, before, runs = np.zeros(len(act), np.int64), np.full(len(act), 8), []
        while len(act):
            v = _look(window, to)
            e = flat[table + (v & mask)]
            symbol, n = e >> 4, e & 15
            extra = _LENGTH_EXTRA[symbol]
            run = _LENGTH_RUN[symbol] + (v >> n & (1 << extra) - 1)
            to += n + extra
            value = np.where(symbol < 16, symbol, np.where(symbol == 16, before, 0))
            before = np.where(value > 0, value, before)
            runs.append((act * size + at, run, value))
            at, left = at + run, left - 1
            if (at > size).any():
                raise BadImage("too many code lengths")
            on = (at < size) & (left > 0)
            if not on.all():
                pos[act] = to
                act, to, at, left, before, table, mask = (x[on] for x in (act, to, at, left, before, table, mask))
        start, run, value = (np.concatenate(x) for x in zip(*runs, strict=True))
        start, run, value = start[value > 0], run[value > 0], value[value > 0]
        lengths.reshape(-1)[np.arange(run.sum()) + np.repeat(start - (np.cumsum(run) - run), run)] = np.repeat(value, run)
    if (pos > limit).any():
        raise BadImage("truncated")
    return lengths, pos


# ---------------------------------------------------------------- decoder


class _Stream:
    """An entropy-coded image: where its pixels begin and under which codes."""

    def __init__(self, r: BitReader, width: int, height: int, main: bool):
        self.width, self.height = width, height
        self.cache_bits = r.read(4) if r.read(1) else 0
        if self.cache_bits > 11:
            raise BadImage("colour cache too large")
        self.meta, self.meta_bits, groups = None, 0, 1
        if main and r.read(1):
            self.meta_bits = r.read(3) + 2
            w, h = (-(-x // (1 << self.meta_bits)) for x in (width, height))
            self.meta = (_sub_image(r, w, h) >> 8 & 0xFFFF).astype(np.int64).reshape(h, w)
            groups = int(self.meta.max()) + 1
        sizes = (256 + N_LENGTH + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, N_DISTANCE)
        self.groups = [[read_code(r, n) for n in sizes] for _ in range(groups)]
        self.data, self.pos = r.data, r.pos


def _sub_image(r: BitReader, width: int, height: int) -> np.ndarray:
    s = _Stream(r, width, height, False)
    pixels, ends = decode_streams([s])
    r.pos = int(ends[0])
    return pixels[0]


def _window(data: list[bytes]) -> np.ndarray:
    """The 64 bits from each byte on, of bytes one after the other and some zeros behind them."""
    raw = np.frombuffer(b"".join(data) + bytes(1024), np.uint8)
    out = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        out |= raw[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _look(window: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """At least 56 bits from each place on."""
    return (window[pos >> 3] >> (pos & 7).astype(np.uint64)).view(np.int64) & (1 << 56) - 1


def _plain(s: _Stream) -> bool:
    """Whether green alone takes bits, under one group of codes and without a cache: so are nearly all images of text."""
    return not s.cache_bits and s.meta is None and all(len(t) == 1 and not t[0] & 15 for t in s.groups[0][1:4])


def _decode_one(s: _Stream) -> tuple[np.ndarray, int]:
    """decode_streams of one stream without a meta image, symbol by symbol: for the few that would hold up many."""
    raw, limit, pos, size = s.data + bytes(16), 8 * len(s.data), s.pos, s.width * s.height
    tables = [t.tolist() for t in s.groups[0]]
    shift, out, cache = 32 - s.cache_bits, [], {}

    def symbol(code: int) -> int:
        nonlocal pos
        a = pos >> 3
        e = tables[code][int.from_bytes(raw[a : a + 4], "little") >> (pos & 7) & (len(tables[code]) - 1)]
        pos += e & 15
        return e >> 4

    def value(prefix: int) -> int:
        nonlocal pos
        if prefix < 4:
            return prefix + 1
        n, a = (prefix - 2) >> 1, pos >> 3
        got = int.from_bytes(raw[a : a + 8], "little") >> (pos & 7) & ((1 << n) - 1)
        pos += n
        return ((2 + (prefix & 1)) << n) + got + 1

    while len(out) < size:
        green, at = symbol(0), len(out)
        if green < 256:
            red, blue, alpha = symbol(1), symbol(2), symbol(3)
            out.append(alpha << 24 | red << 16 | green << 8 | blue)
        elif green >= 256 + N_LENGTH:
            out.append(cache.get(green - 256 - N_LENGTH, 0))
        else:
            length = value(green - 256)
            d = value(symbol(4))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * s.width)
            if d > at or at + length > size:
                raise BadImage("bad back-reference")
            for k in range(at - d, at - d + length):
                out.append(out[k])
        if s.cache_bits:
            for v in out[at:]:
                cache[(_CACHE_HASH * v & 0xFFFFFFFF) >> shift] = v
        if pos > limit:
            raise BadImage("truncated")
    return np.array(out, np.uint32), pos


def decode_streams(streams: list[_Stream], among: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """The ARGB pixels (uint32) of each stream, and the bit after the last one used; among so many more streams read elsewhere."""
    rest = [i for i, s in enumerate(streams) if not _plain(s)]
    if len(streams) + among > FEW >= len(rest) > 0 and all(streams[i].meta is None for i in rest):
        many = [s for i, s in enumerate(streams) if i not in rest]
        pixels, ends = decode_streams(many) if many else ([], np.zeros(0, np.int64))
        ends = ends.tolist()
        for i in rest:
            one, end = _decode_one(streams[i])
            pixels.insert(i, one)
            ends.insert(i, end)
        return pixels, np.array(ends)
    n = len(streams)
    starts = np.cumsum([0] + [len(s.data) for s in streams])
    window = _window([s.data for s in streams])
    pos = np.array([8 * a + s.pos for a, s in zip(starts, streams, strict=False)], np.int64)
    first, size = pos.copy(), np.array([s.width * s.height for s in streams], np.int64)
    limit = 8 * starts[1:]
    # all tables side by side; group g of image i has rows base[i] + g
    flat, where, rows, masks = [], {}, [], []
    base = np.zeros(n, np.int64)
    used = 0
    for i, s in enumerate(streams):
        base[i] = len(rows)
        for g in s.groups:
            row, mask = [], []
            for t in g:
                if id(t) not in where:
                    where[id(t)] = used
                    flat.append(t)
                    used += len(t)
                row.append(where[id(t)])
                mask.append(len(t) - 1)
            rows.append(row)
            masks.append(mask)
    flat, rows, masks = np.concatenate(flat), np.array(rows, np.int64), np.array(masks, np.uint64)
    # codes of one symbol take no bits: where that holds for all but green, a pixel's other channels are known
    heads = flat[rows[:, 1:4]]
    still = not masks[:, 1:4].any() and not (heads & 15).any()
    others = ((heads[:, 2] >> 4) << 24 | (heads[:, 0] >> 4) << 16 | heads[:, 1] >> 4).astype(np.int64)
    out_at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(out_at[-1]), np.uint32)
    p = np.zeros(n, np.int64)
    bits = np.array([s.cache_bits for s in streams], np.int64)
    cached = bool(bits.any())
    cache = np.zeros((n, 1 << int(bits.max(initial=0))), np.uint32) if cached else None
    widths = np.array([s.width for s in streams], np.int64)
    metas = any(s.meta is not None for s in streams)
    act = np.flatnonzero(size > 0)
    if still and not cached and not metas and max(len(s.data) for s in streams) <= PLAIN_BYTES and size.max() <= PLAIN_PIXELS:
        greens, pos = _decode_plain(pos, size, limit, widths, window, flat, rows[base], masks[base].astype(np.int64))
        out = np.repeat(others[base].astype(np.uint32), size) | greens.astype(np.uint32) << np.uint32(8)
        return [out[out_at[i] : out_at[i + 1]] for i in range(n)], pos - first + np.array([s.pos for s in streams], np.int64)

    def look(at, code, row):
        w = window[at >> 3] >> (at & 7).astype(np.uint64)
        e = flat[rows[row, code] + (w & masks[row, code]).astype(np.int64)]
        return at + (e & 15), e >> 4

    def value(i, symbol):
        """A length or distance from its prefix symbol."""
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        a = int(pos[i])
        got = int(window[a >> 3]) >> (a & 7) & ((1 << extra) - 1)
        pos[i] = a + extra
        return ((2 + (symbol & 1)) << extra) + got + 1

    while len(act):
        row = base[act]
        if metas:
            row = row.copy()
            for k, i in enumerate(act):
                s = streams[i]
                if s.meta is not None:
                    y, x = divmod(int(p[i]), s.width)
                    row[k] += s.meta[y >> s.meta_bits, x >> s.meta_bits]
        at, green = look(pos[act], 0, row)
        literal = green < 256
        if literal.all():
            lit, lrow = act, row
        else:
            lit, lrow = act[literal], row[literal]
            pos[act] = at
            for i, s, g in zip(act[~literal].tolist(), green[~literal].tolist(), row[~literal].tolist(), strict=True):
                o = int(out_at[i])
                if s >= 256 + N_LENGTH:
                    out[o + p[i]] = cache[i, s - 256 - N_LENGTH]
                    n_new = 1
                else:
                    n_new = value(i, s - 256)
                    a, d = look(pos[i : i + 1], 4, np.array([g]))
                    pos[i] = a[0]
                    d = value(i, int(d[0]))
                    if d > 120:
                        d -= 120
                    else:
                        x, y = NEAR[d - 1]
                        d = max(1, x + y * int(widths[i]))
                    q = int(p[i])
                    if d > q or q + n_new > size[i]:
                        raise BadImage("bad back-reference")
                    for k in range(0, n_new, d):
                        m = min(d, n_new - k)
                        out[o + q + k : o + q + k + m] = out[o + q + k - d : o + q + k - d + m]
                if cached and bits[i]:
                    for v in out[o + p[i] : o + p[i] + n_new].tolist():
                        cache[i, (_CACHE_HASH * v & 0xFFFFFFFF) >> (32 - int(bits[i]))] = v
                p[i] += n_new
            at, green = at[literal], green[literal]
        if len(lit):
            if still:
                argb = (others[lrow] | green << 8).astype(np.uint32)
            else:
                at, red = look(at, 1, lrow)
                at, blue = look(at, 2, lrow)
                at, alpha = look(at, 3, lrow)
                argb = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)
            out[out_at[lit] + p[lit]] = argb
            if cached:
                own = bits[lit] > 0
                if own.any():
                    v, b = argb[own].astype(np.uint64), bits[lit][own]
                    cache[lit[own], ((v * np.uint64(_CACHE_HASH) & np.uint64(0xFFFFFFFF)) >> (32 - b).astype(np.uint64)).astype(np.int64)] = argb[own]
            pos[lit] = at
            p[lit] += 1
        done = p[act] >= size[act]
        if done.any() or (pos[act] > limit[act]).any():
            if (pos[act] > limit[act]).any():
                raise BadImage("truncated")
            act = act[~done]
    return [out[out_at[i] : out_at[i + 1]] for i in range(n)], pos - first + np.array([s.pos for s in streams], np.int64)


def _value(window: np.ndarray, pos: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols, and the bits after them."""
    n = np.maximum(symbol - 2, 0) >> 1
    return np.where(symbol < 4, symbol, (2 + (symbol & 1) << n) + (_look(window, pos) & (1 << n) - 1)) + 1, pos + n


def _decode_plain(pos, size, limit, widths, window, flat, rows, masks) -> tuple[np.ndarray, np.ndarray]:
    """(greens of all images one after the other, bits after the last one used) where each image has one group, no colour cache, and green alone takes bits.

    What would begin at a bit, and where it would end, is looked up for all bits side by side; that gives
    strides of STRIDE symbols, which lead from each image's first symbol to all others.
    """
    out_at = np.concatenate([[0], np.cumsum(size)])
    out, ends = np.zeros(int(out_at[-1]), np.uint8), pos.copy()
    still = masks[:, 0] == 0  # one symbol, which takes no bits
    if (flat[rows[still, 0]] >> 4 >= 256).any():
        raise BadImage("bad back-reference")
    for i in np.flatnonzero(still).tolist():
        out[out_at[i] : out_at[i + 1]] = flat[rows[i, 0]] >> 4
    if (pos > limit).any() or (pos[~still] == limit[~still]).any():
        raise BadImage("truncated")
    todo = np.flatnonzero(~still & (size > 0))
    block = np.cumsum(np.maximum(limit[todo] - pos[todo], size[todo])) // BLOCK_BITS
    for own in np.split(todo, np.flatnonzero(np.diff(block)) + 1) if len(todo) else ():
        greens, ends[own] = _decode_block(pos[own], size[own], limit[own], widths[own], window, flat, rows[own], masks[own])
        k = 0
        for i, n in zip(own.tolist(), size[own].tolist(), strict=True):
            out[out_at[i] : out_at[i] + n] = greens[k : k + n]
            k += n
    return out, ends


def _decode_block(pos, size, limit, widths, window, flat, rows, masks) -> tuple[np.ndarray, np.ndarray]:
    n_bytes = (limit >> 3) - (pos >> 3)
    at = np.concatenate([[0], np.cumsum(n_bytes)])
    image = np.repeat(np.arange(len(pos)), n_bytes)
    byte = np.arange(at[-1]) + ((pos >> 3) - at[:-1])[image]
    entry, w, mask, table = np.empty((len(byte), 8), np.int64), window[byte], masks[image, 0], rows[image, 0]
    for k in range(8):
        entry[:, k] = flat[((w >> np.uint64(k)).view(np.int64) & mask) + table]
    entry = entry.reshape(-1)
    good = 8 * int(at[-1])  # behind the last symbol of an image; one more: behind one that its image cuts off
    step = np.arange(good + 2)
    step[:good] += entry & 15
    # copies: a length, a distance symbol and its distance
    copy = np.flatnonzero(entry >= 256 << 4)
    owner = image[copy >> 3]
    begin = 8 * byte[copy >> 3] + (copy & 7)
    length, to = _value(window, begin + (entry[copy] & 15), (entry[copy] >> 4) - 256)
    e = flat[rows[owner, 4] + (_look(window, to) & masks[owner, 4])]
    distance, to = _value(window, to + (e & 15), e >> 4)
    near = distance <= len(NEAR)
    x, y = _NEAR[np.where(near, distance, 1) - 1].T
    distance = np.where(near, np.maximum(1, x + y * widths[owner]), distance - len(NEAR))
    step[copy] = copy + to - begin
    # only an image's last bits, and copies, can lead beyond its end
    stop, start = 8 * at[1:], 8 * at[:-1] + (pos & 7)
    last = np.concatenate([np.maximum(stop[:, None] - 1 - np.arange(MAX_LENGTH), start[:, None]).reshape(-1), copy])
    beyond = step[last] - stop[image[last >> 3]]
    step[last] = np.where(beyond < 0, step[last], good + (beyond > 0))
    strides = [step]
    while 1 << len(strides) <= STRIDE:
        strides.append(strides[-1][strides[-1]])
    now, firsts = start, []
    while len(now):
        for _ in range(8):
            firsts.append(now)
            now = strides[-1][now]
        now = now[now < good]
    met = np.sort(np.concatenate(firsts))
    met = met[: np.searchsorted(met, good)]
    for s in strides[-2::-1]:
        met = np.stack([met, s[met]], 1).reshape(-1)
        met = met[met < good]
    # the pixels of each symbol
    green, after, owner = entry[met] >> 4, step[met], image[met >> 3]
    count = (after <= good).astype(np.int64)
    copied = np.flatnonzero((green >= 256) & (after <= good))
    which = np.searchsorted(copy, met[copied])
    count[copied] = length[which]
    first = np.searchsorted(met, start)
    place = np.cumsum(count) - count
    place -= place[first][owner]
    kept = place < size[owner]
    if (np.bincount(owner, count, len(pos)) < size).any():
        raise BadImage("truncated")
    back = kept[copied]
    copied, distance = copied[back], distance[which[back]]
    if (distance > place[copied]).any() or (place + count > size[owner])[copied].any():
        raise BadImage("bad back-reference")
    final = first + np.bincount(owner[kept], minlength=len(pos)) - 1
    ends = pos + np.where(after[final] < good, after[final], stop) - start
    place += (np.cumsum(size) - size)[owner]
    out = np.zeros(int(size.sum()), np.uint8)
    literal = np.flatnonzero(kept & (green < 256))
    out[place[literal]] = green[literal]
    if len(copied):
        n = count[copied]
        to = np.arange(n.sum()) + np.repeat(place[copied] - (np.cumsum(n) - n), n)
        source = np.arange(len(out))
        source[to] -= np.repeat(distance, n)
        while True:  # copies of copies: twice as far back each time
            further = source[source[to]]
            if (further == source[to]).all():
                break
            source[to] = further
        out[to] = out[source[to]]
    return out, ends


def lossless_chunk(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file, alone or among others (an extended file)."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            if len(body) < 5 or body[0] != 0x2F:
                break
            return body
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image")


def _open(data: bytes):
    """(stream, transforms in reading order, width, height) of a RIFF file."""
    body = lossless_chunk(data)
    head = int.from_bytes(body[1:5], "little")
    width, height = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1
    if head >> 29:
        raise BadImage("unknown version")
    r = BitReader(body, 40)
    transforms, kinds, inner = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in kinds:
            raise BadImage("a transform twice")
        kinds.add(kind)
        if kind in (0, 1):
            bits = r.read(3) + 2
            w, h = -(-inner // (1 << bits)), -(-height // (1 << bits))
            transforms.append((kind, bits, _sub_image(r, w, h).reshape(h, w), inner))
        elif kind == 2:
            transforms.append((2, 0, None, inner))
        else:
            n = r.read(8) + 1
            table = _sub_image(r, n, 1).view(np.uint8).reshape(n, 4)
            table = np.cumsum(table, axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((3, bits, table, inner))
            inner = -(-inner // (1 << bits))
    return _Stream(r, inner, height, True), transforms, width, height


def _average(a, b):
    return (a.astype(np.int32) + b) >> 1


def _predict(mode: int, left, top, right, corner) -> np.ndarray:
    """The prediction of one mode for channel arrays (..., 4) in memory order B, G, R, A."""
    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7):
        return _average(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _average(top, corner if mode == 8 else right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    a, b, c = (x.astype(np.int32) for x in (left, top, corner))
    if mode == 11:
        near = np.abs(b - c).sum(-1, keepdims=True) < np.abs(a - c).sum(-1, keepdims=True)
        return np.where(near, a, b)
    if mode == 12:
        return np.clip(a + b - c, 0, 255)
    m = (a + b) >> 1
    return np.clip(m + np.trunc((m - c) / 2).astype(np.int32), 0, 255)


def _neighbours(px: np.ndarray, y: int, x: int):
    flat, w = px.reshape(-1, 4), px.shape[1]
    i = y * w + x
    return flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1]


def _unpredict(argb: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    px = argb.view(np.uint8).reshape(-1, width, 4).copy()
    px[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    px[0] = np.cumsum(px[0], axis=0, dtype=np.uint8)
    modes = modes >> 8 & 15
    for y in range(1, len(px)):
        px[y, 0] += px[y - 1, 0]
        kinds = set(np.minimum(modes[y >> bits], 13).tolist())
        if kinds == {1}:  # each pixel on its left neighbour
            px[y] = np.cumsum(px[y], axis=0, dtype=np.uint8)
            continue
        if kinds == {2}:  # each on the one above
            px[y, 1:] += px[y - 1, 1:]
            continue
        for x in range(1, width):
            mode = min(int(modes[y >> bits, x >> bits]), 13)
            px[y, x] += _predict(mode, *_neighbours(px, y, x)).astype(np.uint8)
    return px.reshape(-1).view(np.uint32)


def _cross(argb: np.ndarray, width: int, bits: int, table: np.ndarray, sign: int) -> np.ndarray:
    px = argb.view(np.uint8).reshape(-1, width, 4).copy()
    y, x = np.mgrid[: len(px), :width]
    m = np.ascontiguousarray(table).view(np.int8).reshape(*table.shape, 4)[y >> bits, x >> bits].astype(np.int32)
    green, red = px[..., 1].view(np.int8).astype(np.int32), px[..., 2].copy()
    new_red = (red + sign * ((m[..., 0] * green) >> 5)).astype(np.uint8)
    plain = (new_red if sign > 0 else red).view(np.int8).astype(np.int32)
    px[..., 0] = (px[..., 0] + sign * (((m[..., 1] * green) >> 5) + ((m[..., 2] * plain) >> 5))).astype(np.uint8)
    px[..., 2] = new_red
    return px.reshape(-1).view(np.uint32)


def _undo(argb: np.ndarray, transform) -> np.ndarray:
    kind, bits, table, width = transform
    if kind == 0:
        return _unpredict(argb, width, bits, table)
    if kind == 1:
        return _cross(argb, width, bits, table, 1)
    if kind == 2:
        px = argb.view(np.uint8).reshape(-1, 4).copy()
        px[:, 0] += px[:, 1]
        px[:, 2] += px[:, 1]
        return px.reshape(-1).view(np.uint32)
    inner, each = -(-width // (1 << bits)), 8 >> bits
    green = (argb >> 8 & 255).reshape(-1, inner)
    x = np.arange(width)
    index = green[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each) & ((1 << each) - 1)
    return np.concatenate([table, np.zeros(256, np.uint32)])[index].reshape(-1).astype(np.uint32)


def decode_green(files: list[bytes]) -> list[np.ndarray]:
    """The green of each image's pixels, row by row. Those with no transform but subtract-green, one group, no cache and bits for green alone are read side by side."""
    bodies = [lossless_chunk(f) for f in files]
    pixels = [((h & 0x3FFF) + 1) * ((h >> 14 & 0x3FFF) + 1) for h in (int.from_bytes(b[1:5], "little") for b in bodies)]
    usual = np.array([k for k, b in enumerate(bodies) if 5 < len(b) <= PLAIN_BYTES and pixels[k] <= PLAIN_PIXELS and b[4] >> 5 == 0 and b[5] & 63 == 5], np.int64)
    out: list = [None] * len(files)
    if len(usual):
        data = [bodies[k] for k in usual.tolist()]
        window = _window(data)
        limit = 8 * np.cumsum([len(b) for b in data])
        pos = np.concatenate([[0], limit[:-1]]) + 8
        head = _look(window, pos)
        width, height = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1
        pos += 38
        codes = []
        for n in (256 + N_LENGTH, 256, 256, 256, N_DISTANCE):
            lengths, pos = read_codes(window, pos, limit, n)
            codes.append(lengths)
        plain = np.flatnonzero(np.all([(c > 0).sum(1) < 2 for c in codes[1:4]], axis=0))
        flat, table, mask = code_tables(codes[0][plain])
        far, far_table, far_mask = code_tables(codes[4][plain])
        rows, masks = np.zeros((2, len(plain), 5), np.int64)
        rows[:, 0], masks[:, 0], rows[:, 4], masks[:, 4] = table, mask, len(flat) + far_table, far_mask
        size = (width * height)[plain]
        greens, _ = _decode_plain(pos[plain], size, limit[plain], width[plain], window, np.concatenate([flat, far]), rows, masks)
        for k, a, n in zip(usual[plain].tolist(), (np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
            out[k] = greens[a : a + n]
    rest = [k for k, x in enumerate(out) if x is None]
    for k, x in zip(rest, decode_images([files[k] for k in rest], len(files) - len(rest)), strict=True):
        out[k] = np.ascontiguousarray(x[..., 1]).reshape(-1)
    return out


def decode_images(files: list[bytes], among: int = 0) -> list[np.ndarray]:
    """Pixel arrays (height, width, 4) uint8 in the order B, G, R, A; among: see decode_streams."""
    opened = [_open(f) for f in files]
    if not opened:
        return []
    pixels, _ = decode_streams([o[0] for o in opened], among)
    out = []
    for argb, (_, transforms, width, height) in zip(pixels, opened, strict=True):
        for t in reversed(transforms):
            argb = _undo(np.ascontiguousarray(argb), t)
        out.append(argb.view(np.uint8).reshape(height, width, 4))
    return out


# ---------------------------------------------------------------- encoders


def riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def huffman_lengths(counts: dict[int, int], size: int, most: int = MAX_LENGTH) -> list[int]:
    """Complete code lengths of at most ``most`` bits (counts are flattened until they fit)."""
    out = [0] * size
    counts = {s: c for s, c in counts.items() if c}
    if len(counts) < 2:
        for s in counts:
            out[s] = 1
        return out
    while True:
        heap = [(c, s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                out[s] = d
            return out
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def huffman_many(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """huffman_lengths of each row of counts, side by side."""
    used = (counts > 0).sum(1)
    out = (counts > 0).astype(np.int64)
    order = np.argsort(used, kind="stable")
    order = order[used[order] > 1]
    for rows in np.split(order, range(HUFFMAN_ROWS, len(order), HUFFMAN_ROWS)) if len(order) else ():
        width = int(used[rows[-1]])
        row, symbol = np.nonzero(counts[rows])
        column = np.arange(len(row)) - (np.cumsum(used[rows]) - used[rows])[row]
        # what isn't merged yet: count, then smallest symbol; leaves are nodes 0.. and merged ones follow from width on
        key, node = np.full((len(rows), width), _MERGED), np.tile(np.arange(width), (len(rows), 1))
        key[row, column] = counts[rows][row, symbol] << 16 | symbol
        parent = np.full((len(rows), 2 * width), 2 * width - 1)
        r = np.arange(len(rows))
        for k in range(width - 1):
            if used[rows[r[0]]] < k + 2:
                live = used[rows[r]] >= k + 2
                r, key, node = r[live], key[live], node[live]
            i = np.arange(len(r))
            a = key.argmin(1)
            low = key[i, a]
            key[i, a] = _MERGED
            b = key.argmin(1)
            high = key[i, b]
            key[i, b] = _MERGED
            parent[r, node[i, a]] = parent[r, node[i, b]] = width + k
            key[i, a] = ((low >> 16) + (high >> 16)) << 16 | np.minimum(low & 0xFFFF, high & 0xFFFF)
            node[i, a] = width + k
        depth = np.full((len(rows), 2 * width), -1)
        i = np.arange(len(rows))
        for k in range(2 * width - 2, width - 1, -1):
            depth[:, k] = depth[i, parent[:, k]] + 1
        out[rows[row], symbol] = depth[row, parent[row, column]] + 1
    deep = np.flatnonzero(out.max(1, initial=0) > most)
    if len(deep):
        out[deep] = huffman_many((counts[deep] + 1) // 2, most)
    return out


def write_code(w: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens, at = [], 0
    while at < len(lengths):
        v, n = lengths[at], 1
        while at + n < len(lengths) and lengths[at + n] == v:
            n += 1
        at += n
        if v:
            tokens.append((v, 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
                n -= k
            tokens += [(v, 0, 0)] * n
        else:
            while n >= 3:
                k = min(n, 138)
                tokens.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                n -= k
            tokens += [(0, 0, 0)] * n
    first = huffman_lengths(Counter(t[0] for t in tokens), 19, 7)
    codes = canonical(first)
    w.put(0, 1)
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(first[k], 3)
    w.put(0, 1)
    alone = sum(x > 0 for x in first) == 1
    for s, extra, n in tokens:
        if not alone:
            w.put(codes[s], first[s])
        w.put(extra, n)


def code_elements(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """write_code for each row of code lengths: (row, value, bits) of what is written, row after row."""
    used = (lengths > 0).sum(1)
    short = (used <= 2) & ~(lengths[:, 256:] > 0).any(1)
    a = (lengths > 0).argmax(1)
    b = lengths.shape[1] - 1 - (lengths[:, ::-1] > 0).argmax(1)
    two = used == 2
    rows = [np.flatnonzero(short)]
    values = [(5 | two << 1 | np.where(used > 0, a, 0) << 3 | np.where(two, b, 0) << 11)[short]]
    widths = [(11 + 8 * two)[short]]
    long = np.flatnonzero(~short)
    if len(long):
        flat, size = lengths[long].reshape(-1), lengths.shape[1]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[::size] = True
        start = np.flatnonzero(new)
        n, v, zero = np.diff(np.append(start, len(flat))), flat[start], flat[start] == 0
        # a length itself, repeats of the greatest size, one smaller repeat, or else the last one or two as they are
        left, most = n - ~zero, np.where(zero, 138, 6)
        full, left = left // most, left % most
        many = np.where(zero, 18, 16)
        again = np.where(zero, np.where(left >= 11, 18, 17), 16)
        symbol = np.stack([v, many, again, v], 1).reshape(-1)
        extra = np.stack([0 * n, np.where(zero, 127, 3), left - np.where(again == 18, 11, 3), 0 * n], 1).reshape(-1)
        times = np.stack([1 - zero, full, left >= 3, np.where(left < 3, left, 0)], 1).reshape(-1)
        symbol, extra, owner = (np.repeat(x, times) for x in (symbol, extra, np.repeat(start // size, 4)))
        first = huffman_many(np.bincount(owner * 19 + symbol, minlength=19 * len(long)).reshape(-1, 19), 7)
        codes = canonical_many(first).astype(np.int64)
        n_bits = np.where((first > 0).sum(1) == 1, 0, first.T).T[owner, symbol]
        stored = first[:, LENGTH_ORDER]
        three = 3 * np.arange(10)
        head = [(np.full(len(long), 30), 5), ((stored[:, :10] << three).sum(1), 30), ((stored[:, 10:] << three[:9]).sum(1), 27), (np.zeros(len(long), np.int64), 1)]
        rows += [long] * 4 + [long[owner]]
        values += [x for x, _ in head] + [np.where(n_bits > 0, codes[owner, symbol], 0) | extra << n_bits]
        widths += [np.full(len(long), k) for _, k in head] + [n_bits + _LENGTH_EXTRA[symbol]]
    rows, values, widths = (np.concatenate(x) for x in (rows, values, widths))
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order], widths[order]


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix of many."""
    v = value - 1
    top = np.maximum(np.frexp(v)[1] - 1, 1).astype(np.int64)
    half = v >> (top - 1) & 1
    low = v < 4
    return np.where(low, v, 2 * top + half), np.where(low, 0, v - (2 + half << (top - 1))), np.where(low, 0, top - 1)


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def _write_stream(w: BitWriter, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = False, meta: np.ndarray | None = None, meta_bits: int = 2) -> None:
    px = argb.tolist()
    threes = [*zip(px, px[1:], px[2:], strict=False), *(tuple(px[k:]) for k in range(max(0, len(px) - 2), len(px)))] if references else []
    steps, cache, seen, i = [], {}, {}, 0
    while i < len(px):
        run, dist = 0, 0
        if references:
            j = seen.get(threes[i])
            if j is not None:
                while i + run < len(px) and px[j + run] == px[i + run] and run < 4096:
                    run += 1
                dist = i - j
        k = (_CACHE_HASH * px[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if run >= 3:
            step, n = ("copy", run, dist), run
        elif cache_bits and cache.get(k) == px[i]:
            step, n = ("cache", k), 1
        else:
            step, n = ("pixel", px[i]), 1
        group = int(meta[i // width >> meta_bits, i % width >> meta_bits]) if meta is not None else 0
        steps.append((group, step))
        for q in range(i, i + n) if cache_bits else ():
            cache[(_CACHE_HASH * px[q] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[q]
        for q in range(i, i + n) if references else ():
            seen[threes[q]] = q
        i += n
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(0 if meta is None else 1, 1)
        if meta is not None:
            groups = int(meta.max()) + 1
            w.put(meta_bits - 2, 3)
            _write_stream(w, (meta.astype(np.uint32) << 8).reshape(-1), meta.shape[1], False)
    near = _near_of(width)
    sizes = (256 + N_LENGTH + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCE)
    counts = [[Counter() for _ in sizes] for _ in range(groups)]
    coded = {}
    for (g, s), times in Counter(steps).items():
        if s[0] == "pixel":
            v = s[1]
            out = [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]
        elif s[0] == "cache":
            out = [(0, 256 + N_LENGTH + s[1], 0, 0)]
        else:
            a, b = _prefix(s[1]), _prefix(near.get(s[2], s[2] + 120))
            out = [(0, 256 + a[0], *a[1:]), (4, *b)]
        for c, symbol, _, _ in out:
            counts[g][c][symbol] += times
        coded[g, s] = out
    lengths = [[huffman_lengths(c, n) for c, n in zip(cs, sizes, strict=True)] for cs in counts]
    codes = [[canonical(x) for x in ls] for ls in lengths]
    for ls in lengths:
        for x in ls:
            write_code(w, x)
    several = [[sum(x > 0 for x in one) > 1 for one in ls] for ls in lengths]
    written = {}
    for (g, s), out in coded.items():
        one = BitWriter()
        for c, symbol, extra, n in out:
            if several[g][c]:
                one.put(codes[g][c][symbol], lengths[g][c][symbol])
            one.put(extra, n)
        written[g, s] = one.value, one.n
    for k in range(0, len(steps), 256):
        some = BitWriter()
        for step in steps[k : k + 256]:
            some.put(*written[step])
        w.put(some.value, some.n)


def encode_image(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = False, block_bits: int = 2, modes: np.ndarray | None = None, multipliers: np.ndarray | None = None, meta: np.ndarray | None = None) -> bytes:
    """pixels (height, width, 4) B, G, R, A; transforms of "predictor", "cross", "green", "palette" are applied in that order."""
    height, width = pixels.shape[:2]
    argb = np.ascontiguousarray(pixels, np.uint8).reshape(-1).view(np.uint32)
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    inner = width
    for t in transforms:
        w.put(1, 1)
        h, b = -(-height // (1 << block_bits)), -(-inner // (1 << block_bits))
        if t == "palette":
            table, index = np.unique(argb, return_inverse=True)
            n = len(table)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            w.put(3, 2)
            w.put(n - 1, 8)
            delta = np.diff(table.view(np.uint8).reshape(n, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            _write_stream(w, np.ascontiguousarray(delta).reshape(-1).view(np.uint32), n, False)
            narrow, each = -(-inner // (1 << bits)), 8 >> bits
            grid = np.zeros((height, narrow << bits), np.uint32)
            grid[:, :inner] = index.reshape(height, inner)
            packed = (grid.reshape(height, narrow, 1 << bits) << (np.arange(1 << bits) * each).astype(np.uint32)).sum(-1).astype(np.uint32)
            argb, inner = (packed << 8 | 0xFF000000).reshape(-1).astype(np.uint32), narrow
        elif t == "green":
            w.put(2, 2)
            px = argb.view(np.uint8).reshape(-1, 4).copy()
            px[:, 0] -= px[:, 1]
            px[:, 2] -= px[:, 1]
            argb = px.reshape(-1).view(np.uint32)
        elif t == "cross":
            table = (multipliers if multipliers is not None else np.full((h, b), 0x00102030)).astype(np.uint32)
            w.put(1, 2)
            w.put(block_bits - 2, 3)
            _write_stream(w, table.reshape(-1), b, False)
            argb = _cross(argb, inner, block_bits, table, -1)
        else:
            mode = modes if modes is not None else np.arange(h * b).reshape(h, b) % 14
            w.put(0, 2)
            w.put(block_bits - 2, 3)
            _write_stream(w, (mode.astype(np.uint32) << 8).reshape(-1), b, False)
            px = argb.view(np.uint8).reshape(height, inner, 4)
            out = px.copy()
            out[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
            out[0, 1:] -= px[0, :-1]
            for y in range(1, height):
                out[y, 0] -= px[y - 1, 0]
                for x in range(1, inner):
                    out[y, x] -= _predict(int(mode[y >> block_bits, x >> block_bits]), *_neighbours(px, y, x)).astype(np.uint8)
            argb = out.reshape(-1).view(np.uint32)
    w.put(0, 1)
    _write_stream(w, argb, inner, True, cache_bits, references, meta)
    return riff(w.bytes())


#: Longest code and shortest back-reference of encode_gray; the bytes that begin one must agree in full.
GRAY_BITS, GRAY_COPY = 11, 16
def copies(data: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies of GRAY_COPY bytes or more inside each image, from left to right, the nearest earlier place taken."""
    from riskloom.llm.textops import prefix_hash, span_hash

    n = len(data) - GRAY_COPY + 1
    if n < 1:
        return []
    image = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    # places to begin at: behind a space or line end, and every so many bytes, which runs need
    begins = (np.arange(n) - edge[image[:n]]) & (GRAY_COPY - 1) == 0  # a power of two
    begins[1:] |= (data[: n - 1] == 32) | (data[: n - 1] == 10)
    at = np.flatnonzero(begins & (image[:n] == image[GRAY_COPY - 1 :]))
    h = span_hash(prefix_hash(data), at, at + GRAY_COPY)
    with np.errstate(over="ignore"):
        h += image[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = (h & np.uint64((1 << 20) - 1)).view(np.int64)
    alike = np.bincount(low, minlength=1 << 20)[low] > 1  # the rest has no earlier place
    at, h = at[alike], h[alike]
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (image[at[order]][1:] == image[at[order]][:-1])
    earlier = np.full(len(data), -1)
    earlier[at[order][1:][same]] = at[order][:-1][same]
    found, free, raw = [], 0, data.tobytes()
    again = np.flatnonzero(earlier >= 0)
    for p, q, end in zip(again.tolist(), earlier[again].tolist(), edge[image[again] + 1].tolist(), strict=True):
        if p < free:
            continue
        most, length = min(end - p, 4096), 0
        while length < most:
            n = min(64, most - length)
            differ = int.from_bytes(raw[p + length : p + length + n], "little") ^ int.from_bytes(raw[q + length : q + length + n], "little")
            if differ:
                length += (differ & -differ).bit_length() - 1 >> 3
                break
            length += n
        if length >= GRAY_COPY:
            found.append((p, length, p - q))
            free = p + length
    return found


def _near_of(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def encode_gray(images: list[np.ndarray], width: int) -> list[bytes]:
    """One file for each image of width * k bytes, every byte a pixel of equal red, green and blue."""
    sizes = np.array([len(x) for x in images])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    data = np.concatenate(images)
    n, size = len(images), 256 + N_LENGTH
    image = np.repeat(np.arange(n), sizes)
    # what each image would take with and without its copies
    cell = image * size + data
    plain = np.bincount(cell, minlength=n * size).reshape(n, size)
    lengths, distances = huffman_many(plain, GRAY_BITS), np.zeros((n, N_DISTANCE), np.int64)
    place, length, distance = np.array(copies(data, edge), np.int64).reshape(-1, 3).T
    if len(place):
        near = np.arange(int(distance.max()) + 1) + len(NEAR)
        for d, code in _near_of(width).items():
            if d < len(near):
                near[d] = code
        owner = image[place]
        a, b = _prefixes(length), _prefixes(near[distance])
        some, own = np.unique(owner, return_inverse=True)
        inside = np.arange(length.sum()) + np.repeat(place - (np.cumsum(length) - length), length)
        symbols = np.concatenate([np.repeat(own, length) * size + data[inside], own * size + 256 + a[0]])
        change = np.bincount(symbols, np.repeat([-1, 1], [len(inside), len(own)]), len(some) * size)
        counts = plain[some] + change.astype(np.int64).reshape(-1, size)
        far = np.bincount(own * N_DISTANCE + b[0], minlength=len(some) * N_DISTANCE).reshape(-1, N_DISTANCE)
        mine, theirs, kinds = huffman_many(counts, GRAY_BITS), huffman_many(far, GRAY_BITS), (far > 0).sum(1)
        extra = np.bincount(own, a[2] + b[2], len(some)).astype(np.int64)
        cost = (counts * mine).sum(1) + np.where(kinds > 1, (far * theirs).sum(1), 0) + extra + 5 * kinds + 24
        better = cost < (plain[some] * lengths[some]).sum(1)
        lengths[some[better]], distances[some[better]] = mine[better], theirs[better]
        taken = better[own]
        place, length, owner = place[taken], length[taken], owner[taken]
        a, b = ([x[taken] for x in y] for y in (a, b))
    codes, far_codes = canonical_many(lengths), canonical_many(distances)
    alone, far_alone = (lengths > 0).sum(1) < 2, (distances > 0).sum(1) < 2
    bits_of, far_bits = np.where(alone[:, None], 0, lengths), np.where(far_alone[:, None], 0, distances)
    still = BitWriter()
    for symbol in (0, 0, 255):  # of red, blue and alpha
        write_code(still, [int(c == symbol) for c in range(256)])
    each = np.arange(n)
    # the head; subtract green, which leaves red and blue at zero, no more transforms, no colour cache, one group
    heads = [(np.full(n, 0x2F | (width - 1) << 8), 22), (sizes // width - 1 | 1 << 14, 18), (np.full(n, 5), 6)]
    parts = [(each, v, np.full(n, k)) for v, k in heads] + [code_elements(lengths)]
    parts += [(each, np.full(n, still.value >> k & 0x7FF), np.full(n, 11)) for k in (0, 11, 22)] + [code_elements(distances)]
    # an element a byte: its code, or a copy's length, its distance, and nothing for the rest of the copy
    value, bits = codes.reshape(-1)[cell], bits_of.reshape(-1)[cell]
    if len(place):
        inside = np.arange(length.sum()) + np.repeat(place - (np.cumsum(length) - length), length)
        value[inside] = bits[inside] = 0
        for k, ((symbol, extra, n_extra), table, widths) in enumerate(((a, codes[:, 256:], bits_of[:, 256:]), (b, far_codes, far_bits))):
            n_bits = widths[owner, symbol]
            value[place + k] = np.where(n_bits > 0, table[owner, symbol], 0).astype(np.uint64) | extra.astype(np.uint64) << n_bits.astype(np.uint64)
            bits[place + k] = n_bits + n_extra
    return _pack_elements([*parts, (image, value, bits)], n)


def _pack_elements(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[bytes]:
    """Files of the given parts one after the other, each (image, value, bits) of its elements (at most 32 bits each, without bits 0), images in order; all packed into 32-bit words."""
    sums, inner = np.zeros((len(parts) + 1, n), np.int64), []
    for k, (owner, _, bits) in enumerate(parts):
        total = np.concatenate([[0], np.cumsum(bits)])
        first = total[np.searchsorted(owner, np.arange(n + 1))]
        sums[k + 1] = sums[k] + np.diff(first)
        inner.append(total[:-1] - first[owner])
    n_bytes = -(-sums[-1] // 8)
    at = np.concatenate([[0], np.cumsum(n_bytes + 8)])
    words = np.zeros(int(at[-1]) // 4 + 4, np.uint64)
    for (owner, value, bits), begin, place in zip(parts, sums, inner, strict=False):
        place += (8 * at[:-1] + begin)[owner]
        shifted = value.astype(np.uint64) << (place & 31).astype(np.uint64)
        word = place >> 5
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        if len(new):  # elements never overlap, so sums are unions
            words[word[new]] += np.add.reduceat(shifted, new)
    low, high = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32), (words >> np.uint64(32)).astype(np.uint32)
    low[1:] |= high[:-1]
    stream = low.view(np.uint8)
    return [riff(stream[a : a + k].tobytes()) for a, k in zip(at.tolist(), n_bytes.tolist(), strict=False)]

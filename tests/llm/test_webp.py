"""Lossless WebP: bit streams written by hand with pixels worked out by hand, grey images, extended files, and what the query stores."""

import collections

import numpy as np
import pytest

from riskloom.llm import media, webp
from riskloom.llm.common import table


class Hand:
    """A bit stream written field by field, as the format's text has them."""

    def __init__(self, width, height):
        self.w = webp.BitWriter()
        for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.w.put(value, n)

    def bits(self, *fields):
        for value, n in fields:
            self.w.put(value, n)
        return self

    def one(self, symbol):
        """A simple prefix code of one symbol: it takes no bits."""
        return self.bits((1, 1), (0, 1), (1, 1), (symbol, 8))

    def two(self, a, b):
        """A simple prefix code of two symbols: a is 0, b is 1."""
        return self.bits((1, 1), (1, 1), (1, 1), (a, 8), (b, 8))

    def pixel_codes(self, green, red=0, blue=0, alpha=255, distance=0):
        for x in (green, red, blue, alpha, distance):
            self.two(*x) if isinstance(x, tuple) else self.one(x)
        return self

    def sub_image(self, green=0, red=0, blue=0, alpha=255):
        """An image of equal pixels: no colour cache, five codes of one symbol."""
        return self.bits((0, 1)).pixel_codes(green, red, blue, alpha)

    def decode(self):
        """Pixels as (red, green, blue, alpha)."""
        body = self.w.bytes() + bytes(8)
        return webp.decode_images([webp.riff(body)])[0][..., [2, 1, 0, 3]].tolist()


PLAIN = ((0, 1), (0, 1), (0, 1))  # no transform, no colour cache, no groups


def test_literal_pixels():
    h = Hand(2, 1).bits(*PLAIN).pixel_codes((10, 20), red=30, blue=(40, 50), alpha=255)
    h.bits((1, 1), (0, 1), (0, 1), (1, 1))  # green 20, blue 40; green 10, blue 50
    assert h.decode() == [[[30, 20, 40, 255], [30, 10, 50, 255]]]


def test_subtract_green():
    h = Hand(1, 1).bits((1, 1), (2, 2), *PLAIN).pixel_codes(200, red=100, blue=5)
    assert h.decode() == [[[(100 + 200) % 256, 200, 205, 255]]]


def test_palette():
    # colours as differences: (1, 2, 3, 4), then (1, 2, 3, 4) + (10, 20, 30, 40); two colours are eight to a pixel
    h = Hand(3, 1).bits((1, 1), (3, 2), (1, 8))
    h.bits((0, 1)).pixel_codes((2, 20), red=(1, 10), blue=(3, 30), alpha=(4, 40))
    h.bits((0, 1), (0, 1), (0, 1), (0, 1)).bits((1, 1), (1, 1), (1, 1), (1, 1))
    h.bits(*PLAIN).pixel_codes(0b110)  # indices 0, 1, 1
    assert h.decode() == [[[1, 2, 3, 4], [11, 22, 33, 44], [11, 22, 33, 44]]]


def test_cross_colour():
    # red takes (16 * 64) >> 5 = 32; blue takes (-32 * 64) >> 5 = -64 and (8 * 42) >> 5 = 10
    h = Hand(1, 1).bits((1, 1), (1, 2), (0, 3)).sub_image(green=256 - 32, red=8, blue=16)
    h.bits(*PLAIN).pixel_codes(64, red=10, blue=100)
    assert h.decode() == [[[42, 64, 100 - 64 + 10, 255]]]


@pytest.mark.parametrize("mode,last", [(0, (7, 7, 7, 255)), (1, (21, 21, 21, 255)), (2, (21, 21, 21, 255)), (4, (14, 14, 14, 255)), (7, (21, 21, 21, 255)), (11, (21, 21, 21, 255)), (12, (28, 28, 28, 255))])
def test_predictor(mode, last):
    # 2 x 2 of residuals 7 (alpha 0): the first pixel on opaque black, the row's rest on the left, the column's on the top
    h = Hand(2, 2).bits((1, 1), (0, 2), (0, 3)).sub_image(green=mode)
    h.bits(*PLAIN).pixel_codes(7, red=7, blue=7, alpha=0)
    assert h.decode() == [[[7, 7, 7, 255], [14, 14, 14, 255]], [[14, 14, 14, 255], list(last)]]


def test_back_reference():
    # green 9 once, then a copy of length 3 (symbol 256 + 2) at distance code 2, one pixel to the left
    h = Hand(4, 1).bits(*PLAIN)
    h.bits((0, 1), (15, 4))  # a normal code: lengths of all 19 code length codes follow
    first = {0: 1, 1: 2, 18: 2}
    for k in webp.LENGTH_ORDER:
        h.bits((first.get(k, 0), 3))
    h.bits((0, 1))  # all 280 lengths are given
    # codes: 0 -> "0", 1 -> "10", 18 -> "11": nine zeros, a one, 248 zeros, a one, 21 zeros
    zero, one, many = ((0, 1),), ((1, 1), (0, 1)), lambda n: ((1, 1), (1, 1), (n - 11, 7))
    h.bits(*zero * 9, *one, *many(138), *many(110), *one, *many(21))
    h.one(8).one(7).one(255)
    h.one(1)  # distance symbol 1: distance code 2, the pixel to the left
    h.bits((0, 1), (1, 1))
    assert h.decode() == [[[8, 9, 7, 255]] * 4]


def test_colour_cache():
    # one cache bit: green 5 as a literal, then the cache's entry for it
    argb = 255 << 24 | 5 << 8
    slot = (0x1E35A7BD * argb & 0xFFFFFFFF) >> 31
    h = Hand(2, 1).bits((0, 1), (1, 1), (1, 4), (0, 1))
    h.bits((0, 1), (15, 4))
    first = {0: 1, 1: 2, 18: 2}
    for k in webp.LENGTH_ORDER:
        h.bits((first.get(k, 0), 3))
    h.bits((0, 1))
    zero, one, many = ((0, 1),), ((1, 1), (0, 1)), lambda n: ((1, 1), (1, 1), (n - 11, 7))
    h.bits(*zero * 5, *one, *many(138), *many(136), *zero * slot, *one, *zero * (1 - slot))
    h.one(0).one(0).one(255).one(0)
    h.bits((0, 1), (1, 1))
    assert h.decode() == [[[0, 5, 0, 255]] * 2]


def test_extended_files():
    px = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    body = webp.lossless_chunk(webp.encode_image(px))

    def chunk(name, data):
        return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)

    inner = b"WEBP" + chunk(b"VP8X", bytes(10)) + chunk(b"ICCP", b"odd") + chunk(b"VP8L", body) + chunk(b"EXIF", b"abcd")
    file = b"RIFF" + len(inner).to_bytes(4, "little") + inner
    assert (webp.decode_images([file])[0] == px).all()
    with pytest.raises(webp.BadImage):
        webp.decode_images([b"RIFF" + (30).to_bytes(4, "little") + b"WEBP" + chunk(b"VP8X", bytes(10))])


def test_grey_images():
    rng = np.random.default_rng(1)
    line = rng.integers(97, 123, 50, dtype=np.uint8)
    images = [rng.integers(0, 256, 64 * k, dtype=np.uint8) for k in (1, 5, 128)]
    images += [np.zeros(64, np.uint8), np.full(640, 7, np.uint8), np.tile(np.concatenate([line, [32]]), 200)[: 64 * 128].astype(np.uint8), np.frombuffer(b"ab" * 32, np.uint8), rng.integers(97, 100, 64 * 40, dtype=np.uint8)]
    for image, out in zip(images, webp.decode_images(webp.encode_gray(images, 64)), strict=True):
        assert (out[..., :3] == image.reshape(-1, 64, 1)).all() and (out[..., 3] == 255).all()
    assert webp.encode_gray(images, 64)[3:6] == [f for i in images[3:6] for f in webp.encode_gray([i], 64)]
    assert len(webp.encode_gray(images, 64)[5]) < 400  # one line and its copies


def test_many_codes_at_once():
    rng = np.random.default_rng(3)
    rows = np.array([webp.huffman_lengths({int(s): int(rng.integers(1, 1000)) for s in rng.choice(60, k, replace=False)}, 60) for k in (2, 3, 17, 60)])
    for lengths, codes in zip(rows, webp.canonical_many(rows), strict=True):
        code, last = 0, 0
        for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            assert int(format(code, f"0{n}b")[::-1], 2) == codes[s]
            code, last = code + 1, n


def test_what_the_query_stores(spark, monkeypatch):
    """Every transform, the cache and back-references stand in stored tiles and come out whole."""
    monkeypatch.setattr(media, "PROBES", 16)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.toArrow()
    seen, texts = collections.Counter(), rows.column("text").combine_chunks()
    from riskloom.llm.textops import chunks

    for _, _, data, offs in chunks(texts):
        stored = media.store(data, offs)
        padded, at = media.payloads(data, offs)
        assert all((x == padded[a:z]).all() for x, a, z in zip(media.load(stored), at[:-1], at[1:], strict=True))
        for file in (f for s in stored for f in media.split_files(s)):
            stream, transforms, _, _ = webp._open(file)
            seen.update({0: "predictor", 1: "cross-colour", 2: "subtract-green", 3: "palette"}[t[0]] for t in transforms)
            seen["cache"] += stream.cache_bits > 0
            seen["copies"] += len(stream.groups[0][4]) > 1 or int(stream.groups[0][4][0]) > 0
            seen["codes"] += len(stream.groups[0][0]) > 1
    assert min(seen[k] for k in ("predictor", "cross-colour", "subtract-green", "palette", "cache", "copies", "codes")) > 0, seen


def test_plain_streams_are_not_held_up_by_a_few_others():
    """Images whose green alone takes bits are decoded side by side, few others one by one; all come out as when decoded alone."""
    draw = np.random.default_rng(9)
    tiles = [np.frombuffer((b"the quick brown fox " * 40 + bytes(draw.integers(97, 100, 400).astype(np.uint8)))[: 64 * int(draw.integers(1, 18))], np.uint8) for _ in range(60)]
    files = webp.encode_gray(tiles, 64)
    pixels = [draw.integers(0, 5, (6, 9, 4)).astype(np.uint8) for _ in range(6)]
    others = [webp.encode_image(p, (), references=k % 2 == 0, cache_bits=(0, 6, 3)[k % 3]) for k, p in enumerate(pixels)]
    mixed = files[:20] + others[:3] + files[20:] + others[3:]
    streams = [webp._open(f)[0] for f in mixed]
    assert 0 < sum(not webp._plain(s) for s in streams) <= webp.FEW < len(streams)
    together = webp.decode_images(mixed)
    want = [*tiles[:20], *pixels[:3], *tiles[20:], *pixels[3:]]
    for x, w, f in zip(together, want, mixed, strict=True):
        assert np.array_equal(x, webp.decode_images([f])[0])
        assert np.array_equal(x if w.ndim == 3 else x[..., 1].reshape(-1), w)
    body = webp.lossless_chunk(files[0])
    for cut in range(8, len(body) - 1, 7):
        with pytest.raises((webp.BadImage, IndexError)):
            webp.decode_images([*files, webp.riff(body[:cut])])


def _grey_tiles(draw):
    words = [bytes(draw.integers(97, 123, draw.integers(2, 9)).astype(np.uint8)) for _ in range(40)]
    texts = [b" ".join(words[i] for i in draw.integers(0, 40, int(draw.integers(20, 900)))) for _ in range(40)]
    tiles = [np.frombuffer((t + bytes(64))[: min(len(t) // 64 + 1, 128) * 64], np.uint8) for t in texts]
    tiles += [np.zeros(64, np.uint8), np.full(640, 9, np.uint8), np.frombuffer(b"ab" * 96, np.uint8), draw.integers(0, 256, 8192).astype(np.uint8)]
    return [*tiles, np.concatenate([np.full(1 << k, 40 + k, np.uint8) for k in range(13)])[:8128]]  # the last one has deep codes


def test_codes_are_made_and_read_for_all_images_at_once(monkeypatch):
    """What is worked out code by code, in Python, doesn't grow with the number of images."""
    tiles, calls = _grey_tiles(np.random.default_rng(11)), collections.Counter()
    for name in ("read_code", "code_table", "huffman_lengths", "write_code"):
        def counted(*args, _name=name, _call=getattr(webp, name)):
            calls[_name] += 1
            return _call(*args)

        monkeypatch.setattr(webp, name, counted)
    seen = []
    for some in (tiles[:1], tiles):
        calls.clear()
        stored = webp.encode_gray(some, 64)
        assert all(np.array_equal(a, b) for a, b in zip(webp.decode_green(stored), some, strict=True))
        seen.append(dict(calls))
    assert seen[0] == seen[1]


def test_many_images_come_out_as_one_by_one(monkeypatch):
    """Blocks of any size and strides of any length; with images of other kinds among them; cut and changed files are refused or read alike."""
    draw = np.random.default_rng(12)
    tiles = _grey_tiles(draw)
    files = webp.encode_gray(tiles, 64)
    assert files == [f for t in tiles for f in webp.encode_gray([t], 64)]
    pixels = [draw.integers(0, 5, (6, 9, 4)).astype(np.uint8) for _ in range(4)]
    others = [webp.encode_image(p, t) for p, t in zip(pixels, (("green",), ("predictor",), ("palette",), ("cross", "green")), strict=True)]
    for bits, stride in ((1 << 9, 1), (1 << 14, 4), (1 << 19, 16)):
        monkeypatch.setattr(webp, "BLOCK_BITS", bits)
        monkeypatch.setattr(webp, "STRIDE", stride)
        for got, want in zip(webp.decode_green([*others[:2], *files, *others[2:]]), [*pixels[:2], *tiles, *pixels[2:]], strict=True):
            assert np.array_equal(got, want[..., 1].reshape(-1) if want.ndim == 3 else want)
    with monkeypatch.context() as m:  # large images are not looked up at all bits at once
        m.setattr(webp, "PLAIN_PIXELS", 640)
        m.setattr(webp, "_decode_block", lambda pos, size, *rest, _call=webp._decode_block: _call(pos, size, *rest) if size.max() <= 640 else pytest.fail("too large"))
        assert all(np.array_equal(got, want) for got, want in zip(webp.decode_green(files), tiles, strict=True))
    assert webp.decode_green([]) == [] and len(webp.decode_green(others[:1])) == 1

    def read(f):
        try:
            s = webp._open(f)[0]
            return (webp._decode_one(s)[0] >> 8 & 255).astype(np.uint8).tobytes() if s.meta is None and webp._plain(s) else None
        except (webp.BadImage, IndexError):
            return "refused"

    outcomes = collections.Counter()
    short = [f for f in files if len(f) < 1500]
    for k in range(150):
        f = bytearray(short[k % len(short)])
        f[int(draw.integers(26, len(f)))] ^= 1 << int(draw.integers(0, 8))
        f = bytes(f) if k % 3 else webp.riff(webp.lossless_chunk(bytes(f))[: int(draw.integers(6, len(f) - 20))])
        want = read(f)
        if want == "refused":
            with pytest.raises((webp.BadImage, IndexError)):
                webp.decode_green([files[0], f])
        elif want is not None:
            assert webp.decode_green([files[0], f])[1].tobytes() == want
        outcomes[want if want is None or want == "refused" else "read"] += 1
    assert min(outcomes["refused"], outcomes["read"]) > 10, outcomes


def test_many_codes_are_those_of_one_by_one():
    draw = np.random.default_rng(13)
    for size, most in ((19, 7), (40, 11), (280, 11), (280, 15)):
        counts = np.array([np.where(draw.random(size) < draw.random(), np.minimum(draw.zipf(1.2, size), 10**6), 0) for _ in range(12)] + [np.arange(size) == 3, np.zeros(size, int)])
        many = webp.huffman_many(counts, most)
        assert many.tolist() == [webp.huffman_lengths(dict(enumerate(c.tolist())), size, most) for c in counts]
        if size == 19:
            continue
        row, value, bits = webp.code_elements(many)
        writers = [webp.BitWriter() for _ in many]
        for r, v, n in zip(row.tolist(), value.tolist(), bits.tolist(), strict=True):
            writers[r].put(v, n)
        data = []
        for w, lengths in zip(writers, many.tolist(), strict=True):
            one = webp.BitWriter()
            webp.write_code(one, lengths)
            assert (w.value, w.n) == (one.value, one.n)
            data.append(w.bytes())
        limit = 8 * np.cumsum([len(d) for d in data])
        start = np.concatenate([[0], limit[:-1]])
        got, end = webp.read_codes(webp._window(data), start, limit, size)
        many[many.sum(1) == 0, 0] = 1  # a code without symbols is stored as that of symbol 0
        assert got.tolist() == many.tolist() and (end - start).tolist() == [w.n for w in writers]
        flat, at, mask = webp.code_tables(got)
        assert all(flat[a : a + m + 1].tolist() == webp.code_table(x).tolist() for a, m, x in zip(at.tolist(), mask.tolist(), got.tolist(), strict=True))

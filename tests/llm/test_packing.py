"""The sum-of-squares rule by definition, its memory bound, and token ids character by character."""

import random
import zlib

import numpy as np

from riskloom.llm import packing, tokens


def by_definition(sizes, window):
    """(windows as lists of piece numbers, counts by level): every choice tried, its squares summed anew."""
    wins = []

    def squares(levels):
        return sum(levels.count(x) ** 2 for x in set(levels) if 0 < x < window)

    for k, n in enumerate(sizes):
        levels = [sum(sizes[i] for i in w) for w in wins]
        options = []
        for level in {0, *levels}:
            if level == window or level + n > window:
                continue
            after = list(levels)
            if level:
                after.remove(level)
            options.append((squares([*after, level + n]), -level))
        level = -min(options)[1]
        if level:
            at = max(i for i, x in enumerate(levels) if x == level)
            wins.append([*wins.pop(at), k])
        else:
            wins.append([k])
    return wins


def test_rule_by_definition():
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 24) for _ in range(150)]
        state = packing.SumOfSquares(24)
        for k, n in enumerate(sizes):
            state.place(packing.Piece(k, 0, n, n, np.zeros(n, np.uint32)))
        got = sorted([p.doc for p in w] for w in [*state.done, *(w for ws in state.open.values() for w in ws)])
        want = by_definition(sizes, 24)
        # windows of one level are alike to the rule: their sizes and number agree
        assert sorted(sum(sizes[i] for i in w) for w in got) == sorted(sum(sizes[i] for i in w) for w in want)
        assert sorted(x for w in got for x in w) == list(range(150))


def test_many_open_windows_keep_the_rule():
    state = packing.SumOfSquares(100)
    for k in range(5000):
        state.place(packing.Piece(k, 0, 51, 51, np.zeros(51, np.uint32)))
    assert state.n_open == 5000 and not state.done
    for k in range(5000):
        state.place(packing.Piece(k, 0, 49, 49, np.zeros(49, np.uint32)))
    assert len(state.done) == 5000 and state.n_open == state.held == 0


def test_held_ids_are_bounded():
    state = packing.SumOfSquares(100, max_held=1000)
    rng, total = random.Random(1), 0
    for k in range(3000):
        n = rng.randint(40, 70)
        total += n
        state.place(packing.Piece(k, 0, n, n, np.zeros(n, np.uint32)))
        assert state.held <= 1000
    state.finish()
    assert sum(p.size for w in state.done for p in w) == total and not state.n_open and not state.held
    assert all(sum(p.size for p in w) <= 100 for w in state.done)


def test_rule_holds_beyond_the_bound():
    """Windows without ids stay open to the rule: the same windows get full, and no piece changes but for the last cuts."""
    rng = random.Random(2)
    sizes = [rng.randint(1, 70) for _ in range(2000)]
    states = packing.SumOfSquares(100), packing.SumOfSquares(100, max_held=200)
    for k, n in enumerate(sizes):
        for state in states:
            state.place(packing.Piece(k, 0, n, n, np.full(n, k, np.uint32)))
    shape = [([[p.doc for p in w] for w in s.done], {x: [[p.doc for p in w] for w in ws] for x, ws in s.open.items()}) for s in states]
    assert shape[0] == shape[1]
    for state in states:
        state.finish()
        got = sorted((p.doc, p.start, p.size, p.checksum()) for w in state.done for p in w)
        assert [g[0] for g in got if g[1] == 0] == list(range(2000)) and sum(g[2] for g in got) == sum(sizes)
        assert all(c == zlib.crc32(np.full(n, d, "<u4").tobytes()) for d, _, n, c in got)
        assert all(sum(p.size for p in w) <= 100 for w in state.done)


def test_ids_of_every_letter():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path(packing.TOKENIZER), 2)
    letters = [chr(c) for c in range(0xC0, 0x2C00)]
    texts = [x for c in letters for x in (c, c + "_", "a" + c + "!", c + "b.")]
    ids, edge = enc.encode(texts)
    want = enc.tok.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for k, (t, e) in enumerate(zip(texts, want, strict=True)) if ids[edge[k] : edge[k + 1]].tolist() != [*e.ids, 2]]
    assert wrong == []


def test_forgotten_pieces(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    few, many = tokens.Encoder(path, 2, max_pieces=5), tokens.Encoder(path, 2)
    for lo in range(0, 60, 7):
        texts = [f"word{i} It's river{i % 5}!! {'x' * (i % 3)}\tlast" for i in range(lo, lo + 7)]
        a, b = few.encode(texts), many.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()

"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces.

Pre-tokenisation never crosses white space, so a text's ids are those of its
pieces between spaces, tabs and line ends. Each distinct piece is encoded once by
the tokenizers library; the first max_pieces are kept, later ones live as long as
their group of texts. A piece of plain letters and digits with ASCII punctuation
after it is always cut between the two by the pre-tokeniser, and case is folded
before, so it is put together from its lower-case word and its punctuation.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np

MAX_PIECES = 1_500_000
#: Letters that fold to one lower-case letter each; U+0130 doesn't, so pieces with it are encoded whole.
_PLAIN = re.compile("([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0240]+)([!-/:-@\\[-`{-~]*)")


class Encoder:
    def __init__(self, path: str, end_id: int, max_pieces: int = MAX_PIECES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end, self.max_pieces = end_id, max_pieces
        self.at: dict[str, int] = {"": 0}
        self.ids, self.start, self.count = array("I"), array("q", [0]), array("q", [0])

    def _store(self, piece: str, ids) -> None:
        self.at[piece] = len(self.start)
        self.start.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)

    def _learn(self, pieces: set[str]) -> None:
        at, parts, need = self.at, [], set()
        for p in pieces:
            m = _PLAIN.fullmatch(p)
            cut = (m[1].lower(), m[2]) if m else (p, "")
            parts.append((p, *cut))
            need.update(x for x in cut if x not in at)
        need = sorted(need)
        for lo in range(0, len(need), 2000):
            some = need[lo : lo + 2000]
            for piece, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self._store(piece, array("I", e.ids))
        ids, start, count = self.ids, self.start, self.count
        for p, word, tail in parts:
            if p not in at:
                i, j = at[word], at[tail]
                if tail:
                    self._store(p, ids[start[i] : start[i] + count[i]] + ids[start[j] : start[j] + count[j]])
                else:
                    at[p] = i

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, where each text begins and the end)."""
        pieces = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        known = len(self.at)
        mark = len(self.start), len(self.ids)
        new = set(chain.from_iterable(pieces)).difference(self.at)
        if new:
            self._learn(new)
        flat = np.fromiter(map(self.at.__getitem__, chain.from_iterable(pieces)), np.int64)
        edge, out = self._gather(flat, np.array([len(ps) for ps in pieces], np.int64), len(texts))
        if len(self.at) > self.max_pieces and new:  # forget what this group has added
            for p in list(self.at)[known:]:
                del self.at[p]
            del self.start[mark[0] :], self.count[mark[0] :], self.ids[mark[1] :]
        return out, edge

    def _gather(self, flat: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        start, count, ids = np.frombuffer(self.start, np.int64), np.frombuffer(self.count, np.int64), np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        counts = count[flat]
        ends = np.concatenate([[0], np.cumsum(counts)])
        edge = ends[np.concatenate([[0], np.cumsum(per)])]
        src = np.repeat(start[flat] - ends[:-1], counts) + np.arange(ends[-1])
        out = np.full(int(ends[-1]) + n, self.end, np.uint32)
        out[np.arange(ends[-1]) + np.repeat(np.arange(n), np.diff(edge))] = ids[src]
        return edge + np.arange(n + 1), out


_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, end_id: int, max_pieces: int = MAX_PIECES) -> Encoder:
    """One encoder for each Python worker and setting."""
    key = (path, end_id, max_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]

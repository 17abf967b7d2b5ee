"""Packing token sequences by the sum-of-squares rule.

Online: a document goes to the fill level that minimises the sum of squared counts
of partially filled windows, tracked in an array over levels. A document longer
than a window first fills whole windows; its rest is placed by the rule.

Each input partition is packed on its own as its rows stream by, so nothing is
shuffled. The rule holds for any number of open windows: they are at most as many as
the partition's documents, and a piece is a few numbers. Its ids are needed only if it is cut
once more when the partition ends: then the windows that are still open are joined by
cutting pieces until at most one is partial, and that one is cut at powers of two, which
need no padding. So many ids as max_held are kept for this; beyond it the fullest open
windows, which would gain the least, give up theirs until half of it is free. They stay open
to the rule, and those that it doesn't fill are padded in the end.

Edge cases: a null or empty text is the end id alone; rows that repeat are packed
as often as they occur; a very long text spans as many windows as it needs; an
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import lean, table, tune
from riskloom.llm.tokens import MAX_PIECES

WINDOW = 4096
#: Ids (4 bytes each) kept in the open windows of one task for the cuts at its end.
MAX_HELD = 1 << 24
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
_GROUP_CHARS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(slots=True)
class Piece:
    """Ids of a document from ``start`` on; ``ids`` is None once only their crc32 is kept."""

    doc: int | None
    start: int
    size: int
    total: int
    ids: np.ndarray | None
    crc: int = 0

    def checksum(self) -> int:
        return self.crc if self.ids is None else zlib.crc32(self.ids.astype("<u4").tobytes())

    def forget(self) -> None:
        self.crc, self.ids = self.checksum(), None


def cut(pieces: Iterable[Piece], target: Callable[[int], int]) -> Iterator[list[Piece]]:
    """Windows filled with pieces, cut where a window is full; target gives a window's size from the ids left."""
    pieces = list(pieces)
    left = sum(p.size for p in pieces)
    filling, level, size = [], 0, target(left) if left else 0
    for p in pieces:
        at = 0
        while at < p.size:
            part = p.ids[at : at + size - level]
            filling.append(Piece(p.doc, p.start + at, len(part), p.total, part))
            at, level, left = at + len(part), level + len(part), left - len(part)
            if level == size:
                yield filling
                filling, level, size = [], 0, target(left) if left else 0
    if filling:
        yield filling


class SumOfSquares:
    """Places pieces; full windows come out of ``done`` as lists of pieces."""

    def __init__(self, size: int = WINDOW, max_held: int = MAX_HELD):
        self.size, self.max_held = size, max_held
        self.count = np.zeros(size + 1, np.int64)  # partial windows of each fill level
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open, self.held = 0, 0
        self.done: list[list[Piece]] = []

    def choose(self, n: int) -> int:
        """The level (0: a new window) after which the sum of squared counts is smallest; ties to the fullest window."""
        last = self.size - n
        here, there = self.count[1 : last + 1], self.count[1 + n :]
        change = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if last and here[-1]:  # a window that gets full counts no more
            change[-1] = 1 - 2 * here[-1]
        new = 2 * int(self.count[n]) + 1 if n < self.size else 0
        if not len(change):
            return 0
        k = last - 1 - int(np.argmin(change[::-1]))
        return k + 1 if change[k] <= new else 0

    def place(self, piece: Piece) -> None:
        level = self.choose(piece.size)
        window = self._take(level) if level else []
        window.append(piece)
        self._put(level + piece.size, window)
        if self.held > self.max_held:
            for level in sorted(self.open, reverse=True):
                for window in self.open[level]:
                    for p in window:
                        if p.ids is not None and self.held > self.max_held // 2:
                            self.held -= p.size
                            p.forget()

    def _take(self, level: int) -> list[Piece]:
        stack = self.open[level]
        window = stack.pop()
        if not stack:
            del self.open[level]
        self.count[level] -= 1
        self.n_open -= 1
        self.held -= sum(p.size for p in window if p.ids is not None)
        return window

    def _put(self, level: int, window: list[Piece]) -> None:
        if level == self.size:
            self.done.append(window)
        elif window:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
            self.n_open += 1
            self.held += sum(p.size for p in window if p.ids is not None)

    def finish(self) -> None:
        """Joins what is open, emptiest windows first, and cuts the last partial one at powers of two; windows without ids stay as they are."""
        rest: list[Piece] = []
        while self.n_open:
            window = self._take(min(self.open))
            if all(p.ids is not None for p in window):
                rest += window
            else:
                self.done.append(window)
        last: list[Piece] = []
        for window in cut(rest, lambda left: self.size):
            if sum(p.size for p in window) == self.size:
                self.done.append(window)
            else:
                last = window
        self.done += cut(last, lambda left: 1 << (left.bit_length() - 1))


def _pack(path: str | None, size: int, end_id: int, max_held: int, max_pieces: int):
    def run(batches):
        from riskloom.llm.tokens import encoder

        if path is None:
            import public_tokenizers

            enc = encoder(public_tokenizers.path(TOKENIZER), end_id, max_pieces)
        else:
            enc = encoder(path, end_id, max_pieces)
        state, seq = SumOfSquares(size, max_held), TaskContext.get().partitionId() << 33

        def rows():
            nonlocal seq
            cols = [[] for _ in range(7)]
            for window in state.done:
                offset = 0
                for p in window:
                    for c, v in zip(cols, (p.doc, p.start, p.size, p.checksum(), p.total, seq, offset), strict=True):
                        c.append(v)
                    offset += p.size
                seq += 1
            state.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        def group(docs, texts):
            ids, edge = enc.encode(texts)
            for k, doc in enumerate(docs):
                own = ids[edge[k] : edge[k + 1]]
                whole = len(own) - len(own) % size
                for start in range(0, whole, size):
                    state.done.append([Piece(doc, start, size, len(own), own[start : start + size])])
                if whole < len(own):
                    state.place(Piece(doc, whole, len(own) - whole, len(own), own[whole:].copy()))

        for b in batches:
            docs, texts, chars = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                chars += len(text or "")
                if chars >= _GROUP_CHARS:
                    group(docs, texts)
                    docs, texts, chars = [], [], 0
            if docs:
                group(docs, texts)
            yield rows()
        state.finish()
        yield rows()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = WINDOW, end_id: int = END_ID, max_held: int = MAX_HELD, max_pieces: int = MAX_PIECES) -> DataFrame:
    """One row for each piece of a document; tokenizer_path=None takes TOKENIZER from the installed public_tokenizers.

    max_pieces bounds the encoder's cache in each Python worker (about 180 bytes a piece).
    """
    return docs.select("doc_id", "text").mapInArrow(lean(_pack(tokenizer_path, size, end_id, max_held, max_pieces)), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack_documents(table(spark, sf_dir, "documents"))

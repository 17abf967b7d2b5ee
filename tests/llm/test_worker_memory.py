"""What the text stages of a pipeline take and keep in a Python worker."""

import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import common, jaccard, quality, textops

COUNTS = types.SimpleNamespace(value=np.zeros(jaccard.SKETCH, np.int32))


def _batch(n=1000, words=280):
    rng = random.Random(4)
    texts = [" ".join(f"word{rng.randrange(30_000)}" for _ in range(words)) for _ in range(n)]
    texts[1], texts[2], texts[5] = None, "", texts[4]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


WORK = {
    "contexts": lambda b: quality._contexts(quality.WORDS)(iter([b])),
    "sketch": lambda b: jaccard._sketch(5)(iter([b])),
    "classes": lambda b: pa.Table.from_batches(jaccard._classes(5)(iter([b]))),
    "records": lambda b: pa.Table.from_batches(jaccard._records(COUNTS, 1000, 5, 75)(iter([b]))),
    "sets": lambda b: pa.Table.from_batches(jaccard._sets(None, 5)(iter([b]))),
}
#: MB that numpy may have at once for a batch of 1000 texts of 2.5 kB.
MOST = {"contexts": 90, "sketch": 30, "classes": 20, "records": 20, "sets": 20}


@pytest.mark.parametrize("name", WORK)
def test_peak_of_a_batch(name):
    b = _batch()
    quality.index_vectors(quality.WORDS + quality.SHAPES)
    tracemalloc.start()
    try:
        WORK[name](b)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < MOST[name], peak


@pytest.mark.parametrize("name", WORK)
def test_groups_of_texts_do_not_matter(name, monkeypatch):
    b = _batch(60, 40)
    want = WORK[name](b)
    for module in (quality, jaccard):
        monkeypatch.setattr(module, "LEAN_BYTES", 100)
    got = WORK[name](b)
    assert got.equals(want) if isinstance(want, pa.Table) else np.array_equal(got, want)
    assert WORK[name](b.slice(0, 0)) is None if not isinstance(want, pa.Table) else True


def test_powers_are_no_longer_than_needed(monkeypatch):
    monkeypatch.setattr(textops, "_POWERS", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    for n in (0, 1, 2, 1000, 1024, 1025):
        assert len(textops.powers("up", n)) == n and len(textops._POWERS["up"]) <= max(2 * n, 1)
    assert int(textops.powers("up", 3)[2]) == int(textops._BASE) ** 2 % 2**64


def test_reserve_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: types.SimpleNamespace(release_unused=lambda: calls.append(1)))
    assert list(common.lean(lambda x: (y + 1 for y in x))(iter([1, 2]))) == [2, 3] and calls == [1]

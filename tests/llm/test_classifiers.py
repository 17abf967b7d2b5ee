"""The two classifiers against plain loops, and the rows they learn from."""

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import quality, toxicity
from riskloom.llm.textops import LOWER, buffers, prefix_hash, span_hash
from tests.llm.test_operators import DOCS, _labelled

TEXTS = ["The river went Quiet, 42 times!! the river", None, "", "aa  bb aa\tBB aa bb", "élan vital — 3.5%", "one"]


def _hash(raw: bytes) -> int:
    data = np.frombuffer(raw, np.uint8)
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(raw)]))[0])


# ---------------------------------------------------------------- quality


def _tokens(text):
    """(word slot, shape slot) of each token, by hand."""
    raw = (text or "").encode()
    kind = [0 if c in b" \t\n\x0b\x0c\r" else 2 if 48 <= c < 58 else 1 if c >= 128 or chr(c).isalpha() else 3 for c in raw]
    out, i = [], 0
    while i < len(raw):
        j = i
        while j < len(raw) and kind[j] == kind[i]:
            j += 1
        if kind[i]:
            out.append((raw[i:j], kind[i]))
        i = j
    slots, seen = [], set()
    hashes = [_hash(bytes(LOWER[np.frombuffer(t, np.uint8)])) for t, _ in out]
    for n, (t, k) in enumerate(out):
        upper = sum(65 <= c < 91 for c in t)
        case = 0 if not upper else 1 if upper == 1 and len(t) > 1 and 65 <= t[0] < 91 else 2 if upper == len(t) else 3
        length = sum(len(t) > edge for edge in (3, 6, 9, 13))
        shape = case * 5 + length if k == 1 else 20 + length if k == 2 else 24 + min(len(t), 5)
        three = tuple(hashes[n - 2 : n + 1]) if n > 1 else None
        if (n and hashes[n] == hashes[n - 1]) or (n > 1 and hashes[n] == hashes[n - 2]):
            shape = 60 + (k == 1)
        elif three in seen:
            shape += 30
        if three:
            seen.add(three)
        slots.append((hashes[n] % quality.WORDS, quality.WORDS + shape))
    return slots


def test_word_vectors_and_pooling_by_loops(spark):
    slots = quality.WORDS + quality.SHAPES
    place, sign, matrix = quality.index_vectors(slots)
    sums = np.zeros((slots, quality.DIMS))
    for text in TEXTS:
        toks = _tokens(text)
        for i in range(len(toks)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(toks):
                    sums[toks[i][0]] += matrix[toks[j][0]]
                    for n in range(0, quality.NONZERO, 2):  # shapes take half of the other's places
                        sums[toks[i][1], place[toks[j][0], n]] += sign[toks[j][0], n]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + matrix / 2
    got = quality.word_vectors(spark.createDataFrame(list(enumerate(TEXTS)), DOCS).repartition(3))
    assert np.allclose(got, want, atol=1e-5)
    x = quality.pooled(*buffers(pa.array(TEXTS)), got)
    for row, text in zip(x, TEXTS, strict=True):
        toks = _tokens(text)
        means = [np.mean([got[t[k]] for t in toks], axis=0) if toks else np.zeros(quality.DIMS) for k in (0, 1)]
        assert np.allclose(row, np.concatenate([*means, [np.log1p(len(toks))]]), atol=1e-4)


def test_a_text_is_read_alike_beside_any_other():
    words = ["a", "b", "c"]
    texts = [" ".join(words[(i * j + j // 3) % 3] for j in range(12)) for i in range(30)]
    alone = [quality.tokens(*buffers(pa.array([t]))) for t in texts]
    word, shape, first = quality.tokens(*buffers(pa.array(texts)))
    for k, (w, s, _) in enumerate(alone):
        assert word[first[k] : first[k + 1]].tolist() == w.tolist() and shape[first[k] : first[k + 1]].tolist() == s.tolist()


def test_network_by_loops():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 6)), (rng.random(200) < 0.5).astype(float)
    net = quality.Network().fit(x, y, x[:50], y[:50], epochs=3)
    for row, score in zip(x[:20], net.score(x[:20]), strict=True):
        z = net.p[3][0]
        for j in range(quality.HIDDEN):
            h = net.p[1][j] + sum((row[i] - net.mean[i]) / net.std[i] * net.p[0][i, j] for i in range(6))
            z += max(0.0, h) * net.p[2][j]
        assert abs(score - 1 / (1 + np.exp(-z / net.temperature))) < 1e-9


# ---------------------------------------------------------------- toxicity


def _word_logit(model, word: bytes) -> float:
    marked = b"\0" + bytes(LOWER[np.frombuffer(word, np.uint8)]) + b"\0"
    bag = [marked] + [marked[i : i + n] for n in toxicity.GRAMS if len(marked) > n for i in range(len(marked) - n + 1)]
    return float(np.mean([model.weights[_hash(g) % toxicity.BUCKETS] for g in bag]))


def test_toxicity_score_by_loops():
    model = toxicity.Model()
    model.weights, model.bias, model.window = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), -0.3, 4
    edge = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
    cut = bytes(set(range(256)) - set(edge))
    for text, score in zip(TEXTS, model.score(*buffers(pa.array(TEXTS))), strict=True):
        words = [w for w in (x.strip(cut) for x in (text or "").encode().split()) if w]
        # windows of four words, another every two; two words or fewer are one
        means = [np.mean([_word_logit(model, w) for w in words[i : i + 4]]) for i in range(0, max(1, len(words) - 2), 2)] if words else []
        assert abs(score - (1 / (1 + np.exp(-(max(means) + model.bias))) if means else 0)) < 1e-6


def test_documents_are_taken_up_to_the_budget():
    """No later document takes the place of one that is too long."""
    assert toxicity.fitting(np.array([5, 9, 3, 2, 1]), 10).tolist() == [True, False, False, False, False]
    assert toxicity.fitting(np.array([5, 5]), 10).tolist() == [True, True] and toxicity.fitting(np.zeros(0, int), 10).tolist() == []


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7])
def test_windows_by_loops(size):
    rng = np.random.default_rng(size)
    doc = np.sort(rng.choice([0, 2, 3, 5], 60))
    doc = np.concatenate([doc, [7], [9, 9]])
    logit = rng.normal(size=len(doc))
    step = max(1, size // 2)
    spans = [(d, lo + i, min(lo + i + 2 * step, hi)) for d in sorted(set(doc)) for lo, hi in [(np.searchsorted(doc, d), np.searchsorted(doc, d, "right"))] for i in range(0, max(1, hi - lo - step), step)]
    cut = toxicity.Windows.of(doc, size)
    assert cut.owner.tolist() == [d for d, _, _ in spans] and np.allclose(cut.means(logit), [logit[a:z].mean() for _, a, z in spans])
    slope = rng.normal(size=len(spans))
    want = np.zeros(len(doc))
    for s, (_, a, z) in zip(slope, spans):
        want[a:z] += s / (z - a)
    assert np.allclose(cut.to_words(slope.copy()), want)


def test_learning_does_not_depend_on_order_or_repeats(spark):
    docs, labels = _labelled(spark, 80)
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' zzz') as text")).union(docs)
    for train in (lambda d: quality.train_quality(spark, d, labels, max_train=40)[1].p[0], lambda d: toxicity.train_toxicity(spark, d, labels, max_train=30, max_bytes=20_000).weights):
        a, b = train(twice.repartition(5)), train(twice.orderBy("text").repartition(2))
        assert np.allclose(a, b, atol=1e-3)  # float sums of one text's vectors may differ in their last bits


def test_words_parameter(spark):
    docs, labels = _labelled(spark, 60)
    model = quality.train_quality(spark, docs, labels, n_words=512)
    assert model[0].shape == (512 + quality.SHAPES, quality.DIMS)
    assert quality.score_quality(spark, docs, model).where("quality_score between 0 and 1").count() == 60

"""Quality classifier: random-indexing word vectors and a small calibrated network.

1. Word vectors by random indexing over all documents. A token is a run of letters,
   digits or symbols; tokens hash into n_words slots (a parameter: words that share a
   slot share a vector; README has the accuracy for several sizes), and shape tokens
   (case, length, repetition inside the document) have slots of their own. Every slot
   owns a sparse ternary index vector; its context vector sums the index vectors of what
   stands one or two tokens away. The sums are one array of (n_words + SHAPES) x DIMS,
   added up by ``dense_reduce``: nothing that reaches the driver or is broadcast grows
   with the data.
2. A document is the mean of its tokens' vectors (words and shapes apart).
3. A two-layer network (numpy, fixed seed) is fitted on at most max_train labelled
   documents, the first by a hash of doc_id; a fifth of the labels' keys calibrates its
   temperature.

Labels are learnt only from rows with crc32(doc_id as text) mod 5 <> 0; label, lang,
source and doc_id are no inputs of a score.

Edge cases: a null or empty text is the zero vector and gets that vector's score;
equal texts get equal scores; a null label teaches nothing; rows that repeat a doc_id
are scored each and count once in the fit (the text of the smallest hash); with labels of one class only (or none) the score is that class's
smoothed share; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import dense_reduce, held_out, lean, table, tune
from riskloom.llm.textops import LEAN_BYTES, LOWER, chunks, mix, prefix_hash, span_hash

WORDS = 1 << 14
SHAPES = 64
DIMS = 64
NONZERO = 4
#: The bound on the labelled rows that the network is fitted on.
MAX_TRAIN = 20_000
HIDDEN = 32


@functools.cache
def index_vectors(slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, signs, matrix) of the sparse ternary index vectors."""
    rng = np.random.default_rng(5)
    place = np.argsort(rng.random((slots, DIMS)), axis=1)[:, :NONZERO].astype(np.int64)
    sign = rng.choice([-1.0, 1.0], (slots, NONZERO))
    matrix = np.zeros((slots, DIMS), np.float32)
    np.put_along_axis(matrix, place, sign.astype(np.float32), axis=1)
    return place, sign, matrix


#: Byte classes: 0 white space, 1 letter (all non-ASCII bytes), 2 digit, 3 symbol.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def tokens(data: np.ndarray, offs: np.ndarray, n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word slot, shape slot, first token of each text and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    first = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    h = span_hash(prefix_hash(LOWER[data]), starts, ends)
    word = (h % np.uint64(n_words)).astype(np.int64)
    size = ends - starts
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps = caps[ends] - caps[starts]
    case = np.where(caps == 0, 0, np.where((caps == 1) & (size > 1) & _UPPER[data[starts]], 1, np.where(caps == size, 2, 3)))
    length = np.searchsorted([3, 6, 9, 13], size)
    letter = kind[starts] == 1
    shape = np.where(letter, case * 5 + length, np.where(kind[starts] == 2, 20 + np.minimum(length, 4), 25 + np.minimum(size, 5) - 1))
    # repetition: the same token one or two back, or a run of three tokens seen before in this text
    same = np.zeros(len(starts), bool)
    for back in (1, 2):
        if len(h) > back:
            same[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    tri = h.copy()
    if len(h) > 2:
        with np.errstate(over="ignore"):
            tri[2:] = mix(h[2:] + h[1:-1] * np.uint64(3) + h[:-2] * np.uint64(7) + doc[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            # a text's first two tokens end no run of three: each gets a value of its own
            early = np.flatnonzero(np.arange(len(h)) - first[doc] < 2)
            tri[early] = mix(early.astype(np.uint64) ^ np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(tri, kind="stable")
        seen = np.zeros(len(tri), bool)
        seen[order[1:]] = tri[order[1:]] == tri[order[:-1]]
    else:
        seen = np.zeros(len(tri), bool)
    shape = np.where(same, 60 + letter, np.where(seen, 30 + shape, shape))
    return word, n_words + shape, first


def _contexts(n_words: int):
    def run(batches) -> np.ndarray | None:
        slots = n_words + SHAPES
        place, sign, _ = index_vectors(slots)
        total = np.zeros(slots * DIMS)
        seen = False
        for b in batches:
            parts = []
            for lo, _, data, offs in chunks(b.column("text"), LEAN_BYTES):
                word, shape, first = tokens(data, offs, n_words)
                parts.append((word, shape, np.repeat(np.arange(lo, lo + len(offs) - 1), np.diff(first))))
            if not parts:
                continue
            word, shape, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            for back in (1, 2):
                if len(word) <= back:
                    continue
                near = doc[back:] == doc[:-back]
                for a, c in ((slice(back, None), slice(None, -back)), (slice(None, -back), slice(back, None))):
                    for slot in (word, shape):
                        row, other = slot[a][near] * DIMS, word[c][near]
                        for j in range(0, NONZERO, 1 if slot is word else 2):
                            total += np.bincount(row + place[other, j], weights=sign[other, j], minlength=slots * DIMS)
            seen = True
        return total if seen else None

    return run


def word_vectors(docs: DataFrame, n_words: int = WORDS) -> np.ndarray:
    """(n_words + SHAPES) x DIMS: the direction of each slot's context plus its own index vector."""
    slots = n_words + SHAPES
    sums = dense_reduce(docs.select("text"), _contexts(n_words), slots * DIMS, "int64").reshape(slots, DIMS)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(norm, 1e-9) + index_vectors(slots)[2] / 2).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and log size of each text."""
    word, shape, first = tokens(data, offs, len(vectors) - SHAPES)
    counts = np.diff(first)
    out = np.zeros((len(counts), 2 * DIMS + 1), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        for k, slot in enumerate((word, shape)):
            for lo in range(0, len(full), 256):  # bounds the gathered rows
                part = full[lo : lo + 256]
                a, z = first[part[0]], first[part[-1] + 1]
                out[part, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(vectors[slot[a:z]], first[part] - a, axis=0)
        out[full] /= counts[full, None]
        out[full, -1] = np.log1p(counts[full])
    return out


class Network:
    """Two layers (ReLU, logistic), standardised inputs, a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, epochs: int = 40, seed: int = 11) -> Network:
        both = np.concatenate([y, cy])
        self.temperature, self.share = 1.0, (both.sum() + 1) / (len(both) + 2)
        self.constant = len(x) == 0 or y.min() == y.max()
        if self.constant:
            return self
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.std
        p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                xb, yb = x[order[lo : lo + 256]], y[order[lo : lo + 256]]
                h = np.maximum(0, xb @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(xb)
                dh = np.outer(d, p[2]) * (h > 0)
                grads = [xb.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        if len(cx):
            z = self.logit(cx)
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, z / s) - cy * z / s) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x - self.mean) / self.std @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, y) that may be learnt from, the first by a hash of doc_id."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, n_words: int = WORDS) -> tuple[np.ndarray, Network]:
    tune(spark)
    vectors = word_vectors(docs, n_words)
    shared = spark.sparkContext.broadcast(vectors)  # (n_words + SHAPES) x DIMS floats, about 4 MB as it is

    def features(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text"), LEAN_BYTES):
                x = pooled(data, offs, shared.value)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "h", "x"])

    sample = labelled_sample(labels, label, max_train)  # at most max_train rows of 16 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("h"))
    rows = rows.mapInArrow(lean(features), "doc_id long, y double, h long, x binary").groupBy("doc_id", "y").agg(F.min(F.struct("h", "x")).alias("one"))  # one row for each id
    got = rows.select("doc_id", "y", "one.x", (F.crc32(F.col("doc_id").cast("string")) % 5 == 4).alias("cal")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy())  # the order of arrival doesn't matter
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIMS + 1).astype(np.float64)[order]
    y = (got.column("y").to_numpy()[order] > 0).astype(float)
    cal = np.array(got.column("cal").to_pylist(), bool)[order]
    return vectors, Network().fit(x[~cal], y[~cal], x[cal], y[cal])


def score_quality(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """docs with ``quality_score`` (0 to 1); a column of that name is replaced."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "quality_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def score(batches):
        vectors, net = shared.value
        for b in batches:
            x = [pooled(data, offs, vectors) for _, _, data, offs in chunks(b.column(at), LEAN_BYTES)]
            if x:
                s = net.score(np.concatenate(x).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "quality_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])
    return docs.mapInArrow(lean(score), schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(spark, docs, table(spark, sf_dir, "labels"))
    out = score_quality(spark, docs, model)
    score = F.col("quality_score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))

"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word's bag holds its byte n-grams (boundaries marked, lengths GRAMS) and the word
itself, hashed into BUCKETS embeddings; a word is the mean of its bag. A document is cut
into overlapping windows of WINDOW words (another begins every half window), a window is the
mean of its words, and that mean goes through a linear softmax; the document has the probability of its most toxic window, so
that a long text doesn't hide a short passage. (One mean over a whole document does, and wider
windows find less: see README for figures by width.) Embeddings and softmax are trained jointly (numpy, fixed seed);
in training the windows of a document share its slope, the higher ones ever more. So a
misspelling nobody has seen scores by the n-grams that it shares.

It is fitted on at most max_train labelled documents, up to half of them toxic, of at
most max_bytes bytes together: documents are taken whole, in the order of a hash of their
ids, up to the first that would exceed the bytes. The prior is then corrected to
that of all usable labels. Scoring reads every whole text. What is broadcast is one float
for each bucket (embedding times softmax, 512 KB).

Labels are learnt only from rows with crc32(doc_id as text) mod 5 <> 0; label, lang,
source and doc_id are no inputs of a score.

Edge cases: a null or empty text has no words and gets score 0; equal texts get equal
scores; null labels teach nothing; rows that repeat a doc_id are scored each, and the
smallest of their texts is the one that is learnt from; with labels of one class only
(or none) the score is that class's smoothed share; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import held_out, table, tune
from riskloom.llm.textops import IS_SPACE, LOWER, chunks, prefix_hash, ranges, span_hash, word_spans

BUCKETS = 1 << 17
DIMS = 16
GRAMS = (3, 4, 5, 6, 8)
WINDOW = 2
#: Bounds on the labelled documents that the model is fitted on: their number and their bytes together.
MAX_TRAIN = 6_000
MAX_BYTES = 32_000_000
EPOCHS = 120
#: In training a document's slope is shared among its windows by a softmax whose temperature falls from the first to the last.
TEMPERATURES = (1.0, 0.1)
SHRINK = 1e-6
#: Gradients well below this move an embedding little, so what a single text holds is not learnt by heart.
RARE = 1e-5

#: Words whose subwords are worked on at once.
SLICE = 30_000
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each word): runs without white space, their outer punctuation cut off."""
    starts, ends, first = word_spans(data, offs, IS_SPACE)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    alnum = _ALNUM[data]
    place = np.arange(len(data))
    after = np.minimum.accumulate(np.where(alnum, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(alnum, place, -1))
    s, e = after[starts], before[ends - 1] + 1
    good = (s < ends) & (e > s)
    return s[good], e[good], doc[good]


def sequences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends and hashes of the distinct words, then of every word in order its document and number among these)."""
    s, e, doc = words(data, offs)
    h, one, word = np.unique(span_hash(prefix_hash(LOWER[data]), s, e), return_index=True, return_inverse=True)
    return s[one], e[one], h, doc, word


def bags(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, first subword of each word and the end)."""
    size = e - s
    padded = np.zeros(int((size + 2).sum()), np.uint8)  # byte 0 marks both ends
    at = np.concatenate([[0], np.cumsum(size + 2)])
    inner = np.repeat(at[:-1] + 1, size) + ranges(size)
    padded[inner] = LOWER[data[np.repeat(s, size) + ranges(size)]]
    p = prefix_hash(padded)
    out, owner = [span_hash(p, at[:-1], at[1:])], [np.arange(len(s))]
    for n in GRAMS:
        count = np.maximum(0, size + 2 - n + 1) * (size + 2 > n)
        begin = np.repeat(at[:-1], count) + ranges(count)
        out.append(span_hash(p, begin, begin + n))
        owner.append(np.repeat(np.arange(len(s)), count))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return bucket, np.searchsorted(owner[order], np.arange(len(s) + 1))


def word_logits(weights: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean over each word's bag."""
    parts = [np.add.reduceat(weights[bucket[first[a] : first[min(a + SLICE, len(first) - 1)]]], first[a : min(a + SLICE, len(first) - 1)] - first[a]) for a in range(0, len(first) - 1, SLICE)]
    return np.concatenate(parts) / np.diff(first) if parts else np.zeros(0)


@dataclass
class Windows:
    """Windows of ``size`` words, each beginning half a window after the one before; a text of half a window or less is one.

    They are pairs of neighbouring blocks of half a window: ``edge`` has the first word of each
    block and the end, ``left`` and ``right`` the blocks of each window (one block twice if it
    is alone), ``owner`` its document.
    """

    edge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    owner: np.ndarray
    alone: np.ndarray  # windows of one block
    length: np.ndarray  # words of each window

    @staticmethod
    def of(doc: np.ndarray, size: int) -> Windows:
        """The windows of words in document order."""
        if not len(doc):
            none = np.zeros(0, np.int32)
            return Windows(np.zeros(1, np.int32), none, none, none, none, none)
        step = max(1, size // 2)
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        at = np.arange(len(doc), dtype=np.int32)
        begin = at[new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % step == 0)]
        own = doc[begin]
        follows = np.append(own[1:] == own[:-1], False)  # the next block is of the same document
        single = ~follows & np.append(True, own[1:] != own[:-1])
        left = np.flatnonzero(follows | single).astype(np.int32)
        right = left + follows[left].astype(np.int32)
        edge = np.append(begin, np.int32(len(doc)))
        alone = np.flatnonzero(left == right)
        out = Windows(edge, left, right, own[left], alone, left)
        out.length = out._paired(np.diff(edge))
        return out

    def _paired(self, blocks: np.ndarray) -> np.ndarray:
        """The sums of each window's blocks."""
        out = blocks[self.right]
        out[self.alone] = 0
        out += blocks[self.left]
        return out

    def means(self, logit: np.ndarray) -> np.ndarray:
        return self._paired(np.add.reduceat(logit, self.edge[:-1])) / self.length if len(self.owner) else np.zeros(0)

    def to_words(self, slope: np.ndarray) -> np.ndarray:
        """What each word gets of slopes on the windows' means; slope is used up."""
        each, n = slope, len(self.edge) - 1
        each /= self.length
        block = np.bincount(self.left, each, n)
        each[self.alone] = 0
        block += np.bincount(self.right, each, n)
        return np.repeat(block, np.diff(self.edge))


def top_windows(mean: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have words, the highest of each's window means)."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
    return owner[begin], np.maximum.reduceat(mean, begin) if len(begin) else np.zeros(0)


class Model:
    """``weights``: each bucket's embedding times the softmax difference; ``bias``; constant shares when there is nothing to learn."""

    constant: float | None = None

    def fit(self, texts: pa.Array, y: np.ndarray, prior: float, seed: int = 7, window: int = WINDOW) -> Model:
        self.window = window
        if len(y) == 0 or y.min() == y.max():
            self.constant, self.weights, self.bias = prior, np.zeros(BUCKETS), 0.0
            return self
        rng = np.random.default_rng(seed)
        buckets, sizes, docs, wordids = [], [], [], []
        known, ids, base = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0  # sorted hashes of the words so far, their numbers
        for lo, _, data, offs in chunks(texts):
            s, e, h, doc, word = sequences(data, offs)
            new = ~np.isin(h, known)
            starts, ends = s[new], e[new]
            for a in range(0, len(starts), SLICE):
                bucket, first = bags(data, starts[a : a + SLICE], ends[a : a + SLICE])
                buckets.append(bucket.astype(np.int32))
                sizes.append(np.diff(first))
            known, ids = np.concatenate([known, h[new]]), np.concatenate([ids, base + np.arange(int(new.sum()))])
            base += int(new.sum())
            order = np.argsort(known)
            known, ids = known[order], ids[order]
            docs.append((doc + lo).astype(np.int32))
            wordids.append(ids[np.searchsorted(known, h)][word].astype(np.int32))
        bucket, size = np.concatenate(buckets), np.concatenate(sizes)
        del buckets
        doc, word = np.concatenate(docs), np.concatenate(wordids)
        first = np.concatenate([[0], np.cumsum(size)])
        cut = Windows.of(doc, window)
        owner = cut.owner
        emb = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
        soft = rng.normal(0, 0.5, (DIMS, 2))
        bias = np.full(1, -1.0)
        params = [emb, soft, bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, EPOCHS + 1):
            side = soft[:, 1] - soft[:, 0]
            mean = cut.means(word_logits((emb @ side).astype(np.float32), bucket, first)[word])
            full, highest = top_windows(mean, owner)
            top = np.zeros(len(y))
            top[full] = highest
            heat = TEMPERATURES[0] * (TEMPERATURES[1] / TEMPERATURES[0]) ** ((t - 1) / max(EPOCHS - 1, 1))
            part = top[owner]  # one array for each window, worked on in place
            np.subtract(mean, part, out=part)
            part /= heat
            np.exp(part, out=part)
            part /= np.bincount(owner, part, len(y))[owner]
            mean *= part
            pooled = np.bincount(owner, mean, len(y))
            del mean
            d = (1 / (1 + np.exp(-np.clip(pooled + bias, -30, 30))) - y) / len(y)
            part *= d[owner]
            dword = np.bincount(word, cut.to_words(part), len(size))
            del part
            ds = np.zeros(BUCKETS)
            for a in range(0, len(size), SLICE):
                z = min(a + SLICE, len(size))
                ds += np.bincount(bucket[first[a] : first[z]], np.repeat(dword[a:z] / size[a:z], size[a:z]), BUCKETS)
            dside = emb.T @ ds
            grads = [np.outer(ds, side) + SHRINK * emb, np.stack([-dside, dside], 1), np.array([d.sum()])]
            for i, (g, rate) in enumerate(zip(grads, (0.1, 0.03, 0.1), strict=True)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + (RARE if i == 0 else 1e-9))
        self.weights = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        share = y.mean()
        self.bias = float(bias[0]) + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
        return self

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        s, e, _, doc, word = sequences(data, offs)
        cut = Windows.of(doc, self.window)
        full, top = top_windows(cut.means(word_logits(self.weights, *bags(data, s, e))[word]), cut.owner)
        out = np.zeros(n)
        out[full] = 1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30)))
        return out


def fitting(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which of some documents, in order, are taken whole: those before the budget is exceeded, whatever their sizes."""
    return np.cumsum(sizes) <= budget


def train_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    tune(spark)
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = count.get(1, 0), count.get(0, 0)
    take = min(pos, max_train // 2)
    draw = F.xxhash64("doc_id")
    sample = rows.where("y = 1").orderBy(draw, "doc_id").limit(take).union(rows.where("y = 0").orderBy(draw, "doc_id").limit(max_train - take))
    # one text for each id, so what is collected has max_train rows at most: first the sizes, then what fits
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    size = picked.groupBy("doc_id", "y").agg(F.min(F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("one"))
    size = size.orderBy(draw, "doc_id").select("doc_id", "y", "one.n", "one.h").toPandas()
    chosen = np.zeros(len(size), bool)
    for k in (0, 1):
        own = (size.y == k).to_numpy()
        chosen[own] = fitting(size.n.to_numpy()[own], max_bytes // 2)
    keys = spark.createDataFrame(pa.table({"doc_id": size.doc_id.to_numpy(np.int64)[chosen], "h": size.h.to_numpy(np.int64)[chosen]}))
    got = picked.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "h"]).groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow()
    order = np.lexsort((got.column("doc_id").to_numpy(), got.column("y").to_numpy()))  # the order of arrival doesn't matter
    texts = got.column("text").combine_chunks().take(pa.array(order)) if got.num_rows else pa.array([], pa.string())
    y = got.column("y").to_numpy()[order].astype(float) if got.num_rows else np.zeros(0)
    return Model().fit(texts, y, (pos + 1) / (pos + neg + 2))


def score_toxicity(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``toxicity_score`` (0 to 1); a column of that name is replaced."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "toxicity_score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def score(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(data, offs), pa.float64())], [*part.schema.names, "toxicity_score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    score = F.col("toxicity_score")
    return score_toxicity(spark, docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))

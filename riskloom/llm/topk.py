"""Exact top-k inner products by a three-phase uniform threshold.

The score of a pair is the sum of ``lists`` partial scores, one for each block of
dimensions; the partial scores of one block over the candidates of one task are a
local score list.

1. Every local list gives its k best entries; the whole scores of those alone are
   added up, and each task returns the k best of them for every query.
2. The k-th best over all tasks is a safe cutoff for the query. It is broadcast, and a
   local list gives up the entries of at least cutoff / lists: a pair all of whose
   partial scores are lower can't reach the cutoff.
3. Only pairs with such an entry have their other partial scores added, exactly; what
   reaches the cutoff (or the task's own k-th best, once that is higher) is ranked.

Candidates stay where they are read. Queries are written once, dealt into batches by
a hash of their rows, and each batch is broadcast: its bytes are bounded by
QUERY_BYTES, so are the cutoffs; a batch is two passes over the candidates. A task
keeps k entries a query and list.

Edge cases: vectors that are null or hold a null or a non-finite component (or
one that scale makes so) take no part; an empty vector scores 0 with everything; rows that repeat vec_id and vector count once; unlike vectors under one
vec_id are rows of their own: each is a candidate, and as queries their results are
ranked together; a row never meets one of its own vec_id; vectors of unlike length are
padded with zeros; ties go to the smaller vec_id; with fewer than k candidates all are
returned; no queries or an empty table give no rows. Products beyond 2**53 are
computed with unbounded integers; a score outside the range of a long is cut to that range before it is ranked.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, release, shared_dir, table, tune

#: Bytes of one broadcast batch of queries (8 a component).
QUERY_BYTES = 8 << 20
#: Queries whose partial scores a task holds at once.
QUERY_ROWS = 1024
_LONG = 2**63 - 1


def matrix(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) as float64, one row a vector, padded to dims."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    size = np.asarray(pc.list_value_length(vectors).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * flat)
    return out


def partial_scores(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """The exact partial scores of all pairs for each block of dimensions."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    if kind is object:
        q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    else:
        q, c = q.astype(kind), c.astype(kind)
    return [q[:, d] @ c[:, d].T for d in np.array_split(np.arange(q.shape[1]), max(1, min(lists, q.shape[1])))]


def _whole(parts: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, kind) -> np.ndarray:
    """The whole scores of some pairs, cut to the range of a long."""
    out = sum(p[rows, cols].astype(kind) for p in parts)
    return np.array([max(-_LONG - 1, min(_LONG, x)) for x in out], object) if kind is object else out


def best_first(k: int, rows: np.ndarray, score: np.ndarray, vec: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The k entries of each row with the highest scores, ties to the smaller vec."""
    order = np.lexsort((vec, -score, rows))
    cols = [x[order] for x in (rows, score, vec, *more)]
    keep = np.arange(len(order)) - np.searchsorted(cols[0], cols[0]) < k
    return [x[keep] for x in cols]


def _floor_of(k: int, rows: np.ndarray, score: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each row the k-th best score so far, or low where there are fewer; rows is sorted, best first."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    at = place == k - 1
    out = low.copy()
    out[rows[at]] = np.maximum(out[rows[at]], score[at])
    return out


class Block:
    """What one task keeps for some queries of a batch.

    cutoff is None in phase 1. After ``add`` has seen all candidates, ``found`` has the
    (row, score, vec_id) of the best entries; ``resolved`` counts the pairs whose whole
    scores were added up.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, lists: int, cutoff: np.ndarray | None):
        self.ids, self.q, self.k, self.lists, self.cutoff = ids, q, k, lists, cutoff
        self.resolved, self.seen = 0, 0
        self.heads: dict[int, list[np.ndarray]] = {}
        self.floor: dict[int, np.ndarray] = {}

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        parts = partial_scores(self.q, c, self.lists)
        exact = parts[0].dtype == object
        kind = object if exact else np.float64
        if self.cutoff is None:
            for j, p in enumerate(parts):
                low, at = self._low(j, kind).astype(p.dtype), p.shape[1] - self.k - 1
                if j not in self.floor and at > 0 and not exact:  # one more than k, as a row's own vector goes
                    low = np.partition(p, at, axis=1)[:, at]
                self._keep(j, parts, p, p >= low[:, None], ids, kind)
        else:
            low = self._low(0, kind)
            low = np.maximum(low, np.array([int(x) if exact and np.isfinite(x) else x for x in self.cutoff], kind))
            share = np.array([-(-x // len(parts)) if x > -np.inf else x for x in low], kind).astype(parts[0].dtype)
            enough = np.zeros(parts[0].shape, bool)
            for p in parts:
                enough |= p >= share[:, None]
            self._keep(0, parts, None, enough, ids, kind, low)
        self.seen += len(ids)

    def _low(self, j: int, kind) -> np.ndarray:
        return self.floor.get(j, np.full(len(self.ids), -np.inf, kind)).astype(kind)

    def _keep(self, j, parts, by, mask, ids, kind, low=None):
        rows, cols = np.nonzero(mask)
        other = ids[cols] != self.ids[rows]
        rows, cols = rows[other], cols[other]
        self.resolved += len(rows) if by is None else 0
        if by is None:
            score = _whole(parts, rows, cols, kind)
            good = score >= low[rows]
            rows, cols, score = rows[good], cols[good], score[good]
            new = [rows, score, ids[cols]]
        else:
            new = best_first(self.k, rows, by[rows, cols].astype(kind), ids[cols], cols)
            rows, cols = new[0], new.pop()
            self.resolved += len(rows)
            new += [self.seen + cols, _whole(parts, rows, cols, kind)]
        old = self.heads.get(j)
        both = [np.concatenate(x) for x in zip(old, new, strict=True)] if old is not None else new  # object stays object
        self.heads[j] = best_first(self.k, *both)
        low = np.full(len(self.ids), -np.inf, kind)
        self.floor[j] = _floor_of(self.k, self.heads[j][0], self.heads[j][1], low)

    def found(self) -> list[np.ndarray]:
        if self.cutoff is not None:
            return self.heads.get(0, [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)])
        if not self.heads:
            return [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        rows, vec, place, whole = (np.concatenate([h[i] for h in self.heads.values()]) for i in (0, 2, 3, 4))
        # a candidate at the head of several lists counts once
        _, one = np.unique(np.stack([rows, place]), axis=1, return_index=True)
        return best_first(self.k, rows[one], whole[one], vec[one])


def _long(score: np.ndarray) -> pa.Array:
    return pa.array([max(-_LONG - 1, min(_LONG, int(x))) for x in score], pa.int64()) if score.dtype == object else pa.array(score.astype(np.int64))


def _meet(shared, cutoffs, k: int, lists: int, scale: float):
    """Candidates (vec_id, embedding) -> (q, vec_id, score): of each query of the batch the best in this task."""

    def run(batches):
        qids, q = shared.value
        tau = cutoffs.value if cutoffs is not None else None
        blocks = [Block(qids[a : a + QUERY_ROWS], q[a : a + QUERY_ROWS], k, lists, None if tau is None else tau[a : a + QUERY_ROWS]) for a in range(0, len(qids), QUERY_ROWS)]
        for b in batches:
            if b.num_rows:
                ids, c = b.column("vec_id").to_numpy(), matrix(b.column("embedding"), q.shape[1], scale)
                for block in blocks:
                    block.add(ids, c)
        for n, block in enumerate(blocks):
            rows, score, vec = block.found()[:3]
            yield pa.RecordBatch.from_arrays([pa.array((rows + n * QUERY_ROWS).astype(np.int64)), pa.array(vec.astype(np.int64)), _long(score)], ["q", "vec_id", "score"])

    return run


def valid_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """The distinct (vec_id, embedding) that take part."""

    def bad(x):
        y = x.cast("double") * F.lit(float(scale))
        return y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))

    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(good & ~F.exists("embedding", bad)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, lists: int = 4, scale: float = 64.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row with ``is_query`` against all other rows of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    tune(spark)
    rows = materialize(spark, valid_vectors(vectors, scale), "topk-rows")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    queries = rows.where(is_query)
    n = queries.count()
    per = max(1, query_bytes // (8 * dims))
    found = f"{shared_dir(spark)}/topk-found-{uuid.uuid4().hex}"
    n_batches = -(-n // max(1, per * 3 // 4)) if n > per else 1  # a hash fills no batch much above its mean
    queries = materialize(spark, queries.withColumn("__batch", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_batches))).repartition(n_batches, "__batch").sortWithinPartitions("__batch"), "topk-queries")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    schema = "q long, vec_id long, score long"
    for batch in range(n_batches):
        got = queries.where(F.col("__batch") == batch).select("vec_id", "embedding").toArrow()  # about query_bytes at most
        qids = got.column("vec_id").combine_chunks().to_numpy() if got.num_rows else np.zeros(0, np.int64)
        q = matrix(got.column("embedding"), dims, scale) if got.num_rows else np.zeros((0, dims))
        shared = spark.sparkContext.broadcast((qids, q))
        heads = rows.mapInArrow(_meet(shared, None, k, lists, scale), schema)
        heads = heads.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        tau = np.full(len(qids), -np.inf)
        for r in heads.select("q", "score").collect():  # one number a query of the batch
            tau[r["q"]] = r["score"] if abs(r["score"]) < 2**53 else np.nextafter(float(r["score"]), -np.inf)
        cutoffs = spark.sparkContext.broadcast(tau)
        out = rows.mapInArrow(_meet(shared, cutoffs, k, lists, scale), schema)
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(qids)), "query_id": qids}))
        out.join(F.broadcast(names), "q").select("query_id", "vec_id", "score").write.mode("append").parquet(found)
        shared.destroy()
        cutoffs.destroy()
    release(spark, queries, rows)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(found)
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), f AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 OR len(c.e) = 0 THEN 0 ELSE CAST(list_dot_product(q.e, c.e) AS BIGINT) END AS score
  FROM f q JOIN f c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Ranked lexical search over document-sharded postings with integer impacts.

``index_documents`` makes shards of about SHARD_DOCS documents or SHARD_POSTINGS postings. A shard has its documents'
ids and its postings in compressed rows: for each term, the documents that hold it and the
impact of each, an integer worked out from counts over all documents (see impacts).
``search`` goes through a query's terms one after the other, adds each term's impacts to one
dense array of the shard's scores, and takes the best k of it with a partition that keeps all
documents tied with the k-th until the smaller doc_ids among them are chosen. The shards'
lists are merged in two steps, first some shards together, then all.

Only the terms that queries ask for are indexed. Queries are read in blocks of MAX_TERMS
terms and MAX_QUERIES queries; a block's vocabulary is the only thing that goes to every
task, and its document frequencies, one number each, the only thing that comes back.
Terms are told apart by 64-bit hash and length.

The first pass over the documents writes shards of term counts, from which the totals are
added up; the texts are read once for a block of queries. No shuffle but the last one, of k
entries for a query and shard.

Edge cases: a null or empty text, or one without a term, is no document of the collection;
queries without terms, or that nothing matches, have no results; rows that repeat an item_id
are queries of their own, rows that repeat a doc_id documents of their own (tied ones by n,
the number of terms, then arbitrarily, as they give equal rows); a null doc_id comes after
all others at a tie; other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import dense_reduce, materialize, table, tune
from riskloom.llm.textops import LOWER, chunks, prefix_hash, span_hash, word_spans

SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
MAX_TERMS, MAX_QUERIES = 1 << 18, 4096
#: Shards whose lists are merged before all are.
MERGE = 64
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = BREAKS[128:] = False
LAST = np.iinfo(np.int64).max

SHARD = "shard long, docs int, words long, ids binary, lengths binary, terms binary, edges binary, postings binary, counts binary"


@dataclass
class Queries:
    """A block of queries: hashes and lengths of their terms, sorted, and the terms of each query."""

    items: list
    hashes: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray
    terms: np.ndarray


def spans(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes, lengths, first term of each text and the end) for groups of texts."""
    for lo, _, data, offs in chunks(texts):
        data = LOWER[data]
        starts, ends, first = word_spans(data, offs, BREAKS)
        yield lo, span_hash(prefix_hash(data), starts, ends), ends - starts, first


def query_block(rows: list[tuple]) -> Queries:
    items, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.string())
    hashes, sizes, counts = [], [], []
    for _, h, n, first in spans(texts):
        hashes.append(h)
        sizes.append(n)
        counts.append(np.diff(first))
    h, n, counts = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(counts)
    unique, at, term = np.unique(h, return_index=True, return_inverse=True)
    # each term of a query once
    pairs = np.unique(np.repeat(np.arange(len(items)), counts) * max(1, len(unique)) + term)
    query, term = pairs // max(1, len(unique)), pairs % max(1, len(unique))
    return Queries(items, unique, n[at], np.searchsorted(query, np.arange(len(items) + 1)), term)


def query_blocks(queries: DataFrame, max_terms: int, max_queries: int) -> Iterator[Queries]:
    """Blocks of whole queries, read one after the other; a block's texts are at most twice its terms' bytes or one query."""
    rows, size = [], 0
    for r in queries.select("item_id", "text").toLocalIterator():
        n = len(r["text"] or "") // 2 + 1  # no text has more terms
        if rows and (size + n > max_terms or len(rows) >= max_queries):
            yield query_block(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield query_block(rows)


def count_shards(docs: DataFrame, queries: Queries, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards (SHARD) of how often each document holds each term of the queries."""
    hashes, sizes = queries.hashes, queries.sizes

    def shard(ids, lengths, docs, terms, counts) -> pa.RecordBatch:
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        docs, terms, counts = np.concatenate(docs), np.concatenate(terms), np.concatenate(counts)
        order = np.lexsort((docs, terms))
        present, first = np.unique(terms[order], return_index=True)
        edges = np.append(first, len(order))
        parts = [ids, lengths, present.astype(np.int32), edges.astype(np.int64), docs[order].astype(np.int32), counts[order].astype(np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
            ["shard", "docs", "words", "ids", "lengths", "terms", "edges", "postings", "counts"],
        )

    def run(batches):
        held, n, postings = ([], [], [], [], []), 0, 0
        for b in batches:
            own = b.column(0).cast(pa.int64())
            own = np.where(own.is_null().to_numpy(zero_copy_only=False), LAST, own.fill_null(0).to_numpy(zero_copy_only=False))
            for lo, h, size, first in spans(b.column(1)):
                rows = len(first) - 1
                at = np.searchsorted(hashes, h) if len(hashes) else np.zeros(len(h), np.int64)
                at = np.minimum(at, max(0, len(hashes) - 1))
                hit = np.flatnonzero((hashes[at] == h) & (sizes[at] == size)) if len(hashes) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, hit, "right") - 1
                pair, count = np.unique(doc * max(1, len(hashes)) + at[hit], return_counts=True)
                for kept, new in zip(held, (own[lo : lo + rows], np.diff(first), pair // max(1, len(hashes)) + n, pair % max(1, len(hashes)), count), strict=True):
                    kept.append(new)
                n, postings = n + rows, postings + len(pair)
                if n >= shard_docs or postings >= SHARD_POSTINGS:
                    yield shard(*held)
                    held, n, postings = ([], [], [], [], []), 0, 0
        if n:
            yield shard(*held)

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SHARD).withColumn("shard", F.monotonically_increasing_id())


def term_weights(frequency: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """The impact of each posting: its term's weight, damped by the document's length, as 64-bit integers."""
    spread = 50 + (50 * lengths * n_docs) // n_words
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * spread))


def index_documents(shards: DataFrame, n_terms: int) -> DataFrame:
    """The shards of count_shards with impacts in place of counts."""
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()
    n_docs, n_words = int(total["n"]), int(total["w"])

    def frequencies(batches):
        out = None
        for b in batches:
            out = np.zeros(n_terms, np.int64) if out is None else out
            for terms, edges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(edges, np.int64))
        return out

    weights = term_weights(dense_reduce(shards.select("terms", "edges"), frequencies, n_terms, "int64", chunks=8), n_docs)
    if not n_docs:
        return shards.withColumnRenamed("counts", "impacts")

    def run(batches):
        for b in batches:
            out = []
            for lengths, terms, edges, postings, counts in zip(*[b.column(i).to_pylist() for i in range(4, 9)], strict=True):
                each = np.repeat(weights[np.frombuffer(terms, np.int32)], np.diff(np.frombuffer(edges, np.int64)))
                own = np.frombuffer(lengths, np.int64)[np.frombuffer(postings, np.int32)]
                out.append(impacts(each, np.frombuffer(counts, np.int64), own, n_docs, n_words).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(out, pa.binary())], [*b.schema.names[:8], "impacts"])

    return shards.mapInArrow(run, SHARD.replace("counts", "impacts"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores above 0 are, highest first, ties by smaller id."""
    held = np.flatnonzero(scores > 0)
    if len(held) > k:
        least = np.partition(scores[held], len(held) - k)[len(held) - k]
        held = held[scores[held] >= least]  # all that tie with the k-th
    return held[np.lexsort((ids[held], -scores[held]))][:k]


def search(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, shard, doc_id, score): of every shard each query's k best documents; query counts the block's queries."""
    edges, wanted = queries.edges, queries.terms

    def run(batches):
        for b in batches:
            for shard, ids, lengths, terms, bounds, postings, impact in zip(*[b.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7, 8)], strict=True):
                ids, n = np.frombuffer(ids, np.int64), len(lengths) // 8
                terms, bounds = np.frombuffer(terms, np.int32), np.frombuffer(bounds, np.int64)
                postings, impact = np.frombuffer(postings, np.int32), np.frombuffer(impact, np.int64)
                at = np.searchsorted(terms, wanted)
                held = at < len(terms)
                held[held] = terms[at[held]] == wanted[held]
                score = np.zeros(n, np.int64)
                found = []
                for q in range(len(edges) - 1):
                    own = at[edges[q] : edges[q + 1]][held[edges[q] : edges[q + 1]]]
                    if len(own):
                        score[:] = 0
                        for t in own.tolist():
                            lo, hi = bounds[t], bounds[t + 1]
                            score[postings[lo:hi]] += impact[lo:hi]
                        top = best(score, ids, k)
                        found.append((np.full(len(top), q), ids[top], score[top]))
                if found:
                    query, doc, value = (np.concatenate(x) for x in zip(*found, strict=True))
                    columns = [pa.array(query, pa.int32()), pa.array(np.full(len(query), shard), pa.int64()), pa.array(doc, mask=doc == LAST), pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "shard", "doc_id", "score"])

    return index.mapInArrow(run, "query int, shard long, doc_id long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, shard_docs: int = SHARD_DOCS, max_terms: int = MAX_TERMS, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents."""
    spark = docs.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = []
    for block in query_blocks(queries, max_terms, max_queries):
        shards = materialize(spark, count_shards(docs, block, shard_docs), "lexical-shards")
        lists = search(index_documents(shards, len(block.hashes)), block, k)
        some = Window.partitionBy("query", F.pmod(F.xxhash64("shard"), F.lit(MERGE))).orderBy(*order)
        lists = lists.withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        items = spark.createDataFrame([(i, item) for i, item in enumerate(block.items)], f"query int, item_id {queries.schema['item_id'].dataType.simpleString()}")
        parts.append(lists.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), len AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), total AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), hit AS (
  SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * big_n) // big_l)))) AS impact
  FROM tf JOIN w ON w.term = tf.term JOIN len ON len.doc_id = tf.doc_id, total
), s AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN hit ON hit.term = q.term GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

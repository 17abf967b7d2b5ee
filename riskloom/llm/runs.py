"""Periodic runs of words, found with a suffix tree.

A run is a maximal stretch of words with a smallest period q, at least MIN_WORDS words and
MIN_EXPONENT periods long. ``periodic_runs`` adds to each row its runs and its text with
each run reduced to its first period.

Method (Stoye and Gusfield): the suffix tree of a group of texts is held as sorted suffixes
with their common prefixes; its inner nodes are the intervals between smaller prefixes. Of
each inner node of depth D all children but the largest are traversed: a leaf i whose
partner i + D or i - D lies under another child of the node begins (or ends) a branching
tandem repeat of period D. Each is rotated to the left as far as the words agree, which
gives the maximal stretch with period D; of stretches with equal ends the smallest period
stays. Words of unlike texts never count as equal, so a group of texts is one tree whose
top branches are whole texts.

Suffixes are sorted by prefix doubling, of which the ranks of every step are kept: two
stretches of 2**j words agree exactly where their ranks of step j do, which answers both
common prefixes and rotations in a logarithmic number of steps however periodic a text is.

Every row is worked on by itself: no shuffle. Memory is that of one group of GROUP_WORDS
words, or of one longer text.

Edge cases: a null or empty text, or one of white space alone, has no runs and an empty
collapsed text; repeated rows get equal results; a null doc_id passes (the query doesn't
rearrange such a text); columns named runs or collapsed are replaced, all others pass
through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import table, tune
from riskloom.llm.textops import ranges

MIN_EXPONENT = 4
MIN_WORDS = 6
GROUP_WORDS = 150_000
#: Leaves traversed at a time.
SLICE = 1_000_000
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


class SuffixTree:
    """Sorted suffixes, common prefixes and ranks of all doubling steps of a sequence of words.

    ``codes`` tells words apart (across texts too); ``ends`` has for each word the end of its text.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        n = self.n = len(codes)
        self.steps: list[np.ndarray] = []
        sa = np.argsort(codes, kind="stable")
        key = codes[sa]
        level = np.zeros(n + 1, np.int8)  # the step that tells a suffix from the one sorted before it
        rank, slots, k = np.empty(n, np.int32), np.arange(n), 1
        while len(slots):
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            head = np.where(new, slots, 0)
            np.maximum.accumulate(head, out=head)
            if self.steps:
                rank = rank.copy()
                fresh = new & (level[slots] < 0)
                level[slots[fresh]] = len(self.steps)
            rank[sa[slots]] = head
            self.steps.append(rank)
            last = np.ones(len(slots), bool)
            last[:-1] = new[1:]
            level[slots[~new]] = -1
            slots = slots[~(new & last)]
            at = sa[slots]
            after = at + k
            inside = after < ends[at]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, sa[slots] = key[order], at[order]
            k *= 2
        self.sa, self.rank = sa, rank
        self.lcp = np.zeros(n + 1, np.int32)
        told = np.flatnonzero(level[:n] > 0)
        level = level[told]
        length = (1 << (level.astype(np.int64) - 1))
        a, b = sa[told - 1] + length, sa[told] + length
        for j in range(len(self.steps) - 3, -1, -1):
            step = self.steps[j]
            on = np.flatnonzero((level - 1 > j) & (np.maximum(a, b) < n))
            same = on[step[a[on]] == step[b[on]]]
            a[same] += 1 << j
            b[same] += 1 << j
            length[same] += 1 << j
        self.lcp[told] = length

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a agree with those before b (a < b)."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for j in range(len(self.steps) - 1, -1, -1):
            w, step = 1 << j, self.steps[j]
            on = np.flatnonzero(a >= w)
            same = on[step[a[on] - w] == step[b[on] - w]]
            a[same] -= w
            b[same] -= w
        return begun - a

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(boundary, first suffix, last suffix) for every boundary between two children of an inner node."""
        lcp = self.lcp
        at = np.flatnonzero(lcp)
        left, right = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        # a node of depth 1 has all places of one word
        word = self.steps[0][self.sa] if self.n else np.zeros(0, np.int32)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        size = np.diff(np.append(first, self.n))
        flat = lcp[at] == 1
        head = word[at[flat]].astype(np.int64)
        left[flat] = head
        right[flat] = head + size[np.searchsorted(first, head)] - 1
        deep = np.flatnonzero(~flat)
        p, depth = at[deep], lcp[at[deep]]
        # minima over stretches of 2**j, as long as a word's places go
        tables = [lcp]
        while len(deep) and 1 << len(tables) <= int(size.max()):
            t, w = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.minimum(t[: len(t) - w], t[w:]))
        lo, hi = p.copy(), p + 1  # lcp[lo:hi] >= depth
        for j in range(len(tables) - 1, -1, -1):
            t, w = tables[j], 1 << j
            ok = lo >= w
            ok[ok] = t[lo[ok] - w] >= depth[ok]
            lo[ok] -= w
            ok = hi + w <= self.n + 1
            ok[ok] = t[hi[ok]] >= depth[ok]
            hi[ok] += w
        left[deep], right[deep] = lo - 1, hi - 1
        return at, left, right

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of every branching tandem repeat, some of them more than once."""
        at, left, right = self.intervals()
        if not len(at):
            return at, at
        order = np.argsort(left * (self.n + 1) + right, kind="stable")
        at, left, right = at[order], left[order], right[order]
        new = np.ones(len(at), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        node = np.cumsum(new) - 1  # of each boundary
        nodes = int(node[-1]) + 1
        # children: before each node's first boundary, and after each boundary
        where = np.arange(len(at)) + node + 1
        child_from, child_to = np.empty(len(at) + nodes, np.int64), np.empty(len(at) + nodes, np.int64)
        owner = np.empty(len(at) + nodes, np.int64)
        heads = np.flatnonzero(new)
        child_from[where], owner[where] = at, node
        child_from[heads + np.arange(nodes)], owner[heads + np.arange(nodes)] = left[heads], np.arange(nodes)
        child_to[:-1] = child_from[1:] - 1
        child_to[np.append(heads[1:] + np.arange(1, nodes), len(owner)) - 1] = right[heads]
        size = child_to - child_from + 1
        # all but the largest child of each node
        begins = heads + np.arange(nodes)
        largest = np.maximum.reduceat(size, begins)
        is_max = np.flatnonzero(size == largest[owner])
        keep = np.ones(len(size), bool)
        keep[is_max[np.unique(owner[is_max], return_index=True)[1]]] = False
        small = np.flatnonzero(keep)
        depth, node_from, node_to = self.lcp[at[heads]].astype(np.int64), left[heads], right[heads]
        starts, periods = [], []
        edge = np.cumsum(size[small])
        lo = 0
        while lo < len(small):
            hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + SLICE, "right")))
            some = small[lo:hi]
            of = np.repeat(some, size[some])
            i = self.sa[np.repeat(child_from[some], size[some]) + ranges(size[some])]
            d, f, t = depth[owner[of]], node_from[owner[of]], node_to[owner[of]]
            for j, ok in ((i + d, i + d < self.n), (i - d, i >= d)):
                j, on = j[ok], np.flatnonzero(ok)
                r = self.rank[j]
                met = (r >= f[on]) & (r <= t[on]) & ((r < child_from[of[on]]) | (r > child_to[of[on]]))
                starts.append(np.minimum(i[on[met]], j[met]))
                periods.append(d[on[met]])
            lo = hi
        return np.concatenate(starts), np.concatenate(periods)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all maximal runs of two periods at least, by start, then period."""
        i, q = self.branching_repeats()
        back = self.backwards(i, i + q)
        start, end = i - back, i + 2 * q
        order = np.lexsort((q, end, start))
        start, end, q = start[order], end[order], q[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, q = start[first], end[first], q[first]
        order = np.lexsort((q, start))
        return start[order], (end - start)[order], q[order]


def runs_of(texts: list[list[bytes]], min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """Of each text (a list of words) its runs, as rows of (start, length, period)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    if not edge[-1]:
        return [np.zeros((0, 3), np.int64)] * len(texts)
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(texts)), sizes) * len(words.dictionary)
    start, length, period = SuffixTree(codes, np.repeat(edge[1:], sizes)).runs()
    enough = (length >= min_exponent * period) & (length >= min_words)
    start, length, period = start[enough], length[enough], period[enough]
    cut = np.searchsorted(start, edge)
    rows = np.stack([start, length, period], 1)
    out = []
    for k in range(len(texts)):
        own = rows[cut[k] : cut[k + 1]].copy()
        own[:, 0] -= edge[k]
        out.append(own)
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that any run has after its first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with runs (start, length, period in words, by start, then period) and collapsed (the text with each run once)."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    source = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def run(batches):
        for b in batches:
            done: list[pa.RecordBatch] = []
            texts = [t.encode().split() if t else [] for t in b.column(at).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= GROUP_WORDS):
                    n += len(texts[hi])
                    hi += 1
                found = runs_of(texts[lo:hi], min_exponent, min_words)
                spans = np.concatenate(found)
                struct = pa.StructArray.from_arrays([pa.array(spans[:, k]) for k in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), struct)
                short = pa.array([collapse(t, f).decode() for t, f in zip(texts[lo:hi], found, strict=True)], pa.string())
                part = b.slice(lo, hi - lo)
                done.append(pa.RecordBatch.from_arrays([*part.columns, lists, short], [*(f"c{i}" for i in range(len(names))), "runs", "collapsed"]))
                lo = hi
            yield from done

    # columns go by position, as names may clash but for their case
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(source.schema.fields)]
    schema = T.StructType([*fields, *T.StructType.fromDDL(f"runs {RUN}, collapsed string").fields])
    out = source.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "runs", "collapsed")


def rearranged(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where every tenth text by its crc32 repeats a stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    n = F.size("__w").cast("long")
    a = F.col("__g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("__g") % 8))
    repeat = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__w", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))), " ")
    chosen = F.coalesce((h % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    out = docs.select("doc_id", "text", g.alias("__g"), F.when(chosen, words).alias("__w"))
    out = out.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
    return out.select("doc_id", F.when(F.col("__a").isNotNull(), repeat).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its runs: how many, the one of most periods, digests of all and of the collapsed text."""
    out = periodic_runs(rearranged(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr(
        f"aggregate(runs, CAST(NULL AS {RUN[6:-1]}), (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)"
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    ratio = F.floor(F.col("m.length") * 1000 / F.col("m.period"))
    exact = F.expr("m.length * 1000 div m.period")
    return out.select("doc_id", "n_runs", "m.start", "m.length", "m.period", F.when(ratio.isNotNull(), exact).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""N-gram Jaccard join by rare-first prefix filtering, down to link components.

A document is the set of its distinct word shingles (64-bit hashes). Two documents
link when 100 * |intersection| >= threshold * |union|. Steps:

1. A sketch of fixed size counts in how many documents each shingle bucket occurs;
   shingles are ordered rare-first by it (any one order gives exact results).
2. Equal sets are one class at once (128-bit set fingerprint), and only the first of a
   class in each task goes on: groups of copies are pre-aggregated.
3. Of each set the prefix n - ceil(t n) + 1 is emitted. Similar sets share a prefix
   shingle, so one sorted, streaming pass (hot shingles are salted) forms the buckets.
   A bucket of at most SMALL members gives its pairs; a larger one gives each member's
   pair with its pivot, the most central member (smallest prefix position), and its
   records are kept for step 5. Length and positional filters come first.
4. Each set meets the partner that most of its buckets name. Pairs pass a suffix filter
   and are verified once, exactly. Members that are connected already need not meet;
   the other pairs are verified after that if they still join different components.
5. What large buckets have left, pairs in different components, goes through further
   rounds with other pivots, and is enumerated in full as soon as it is small or a round
   found no new link. So no link between different components is missed, and the pairs
   within a group are never all formed.

Components are minima spread along links (``connected_components``); nothing that grows
with the documents is collected or broadcast, apart from the two fixed-size sketches.

Edge cases: null or word-less texts have empty sets and link with nothing; texts of fewer
words than a shingle are one shingle; rows that repeat a doc_id are one vertex with all
their texts and each get a row; rows with a null doc_id link with nothing and keep a null
component; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import compact, connected_components, counted, dense_reduce, few, lean, light, materialize, release, rows_of, table, tune
from riskloom.llm.textops import LEAN_BYTES, LOWER, chunks, mix, prefix_hash, span_hash, word_spans

WORDS = 5
THRESHOLD = 75
SKETCH = 1 << 20
FILTER = 1 << 21
SALTS = 32
#: Largest bucket whose pairs are all formed; longest run of records held in one piece.
SMALL = 6
HOLD = 20_000
#: A shingle is hot, and salted, where its sketch count is above so many means and so many rows.
HOT_MEANS, HOT_ROWS = 4, 1000
#: Fingerprints of sets that a task remembers in order to send equal ones once; later ones are sent each.
KNOWN = 1 << 20
#: Frames of at most so many rows are broadcast: the joins are many, and each broadcast is built in the driver's heap.
LIGHT = 1 << 16
_U = np.uint64
_STEP = [_U(int(x) | 1) for x in np.random.default_rng(31).integers(1, 2**62, 16)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = LOWER[data]
    s, e, first = word_spans(low, offs)
    h = span_hash(prefix_hash(low), s, e)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(h) - words + 1), _U)
        for j in range(words):
            runs += mix(h[j : j + len(runs)] + _STEP[j]) * _STEP[j]
        runs = mix(runs)
        out = []
        for d, n in enumerate(counts):
            a = first[d]
            if n >= words:
                g = np.sort(runs[a : a + n - words + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            elif n:
                out.append(mix((mix(h[a : a + n] + np.array(_STEP[:n])) * np.array(_STEP[:n])).sum(keepdims=True) + _U(n) * _STEP[15]))
            else:
                out.append(np.zeros(0, _U))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(44)).astype(np.int64)


def _prefix(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def _sketch(words: int):
    def run(batches):
        total, seen = np.zeros(SKETCH, np.int64), False
        for b in batches:
            sets = [g for _, _, data, offs in chunks(b.column("text"), LEAN_BYTES) for g in shingle_sets(data, offs, words)]
            if sets:
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=SKETCH)
                seen = True
        return total if seen else None

    return run


def _fingerprint(g: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(g + _STEP[13]).sum(dtype=_U).view(np.int64)), int(mix(g ^ _STEP[14]).sum(dtype=_U).view(np.int64))


def _classes(words: int):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs in chunks(b.column("text"), LEAN_BYTES):
                sets = shingle_sets(data, offs, words)
                prints = [_fingerprint(g) for g in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array([len(g) for g in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())],
                    ["doc_id", "n", "f1", "f2"],
                )

    return run


def _records(shared, hot: int, words: int, threshold: int):
    """(h, salt, doc, n, pos) of every prefix shingle; of equal sets in a task only the first."""

    def run(batches):
        count, known = shared.value, set()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offs in chunks(b.column("text"), LEAN_BYTES):
                parts, docs, sizes, lens = [], [], [], []
                for d, g in enumerate(shingle_sets(data, offs, words), lo):
                    if not len(g) or (key := (len(g), *_fingerprint(g))) in known:
                        continue
                    if len(known) < KNOWN:
                        known.add(key)
                    p = _prefix(len(g), threshold)
                    c = count[_bucket(g)]
                    parts.append(g[np.lexsort((g, c))[:p]])
                    docs.append(ids[d])
                    sizes.append(len(g))
                    lens.append(p)
                if not parts:
                    continue
                h, lens = np.concatenate(parts), np.array(lens)
                doc = np.repeat(np.array(docs, np.int64), lens)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
                salt = np.where(count[_bucket(h)] > hot, 1 + (mix(doc.view(_U)) % _U(SALTS)).astype(np.int32), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(pos.astype(np.int32))],
                    ["h", "salt", "doc", "n", "pos"],
                )

    return run


def _shared_only(batches):
    """Of rows sorted by h: those whose neighbour has the same h, or that are salted."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        h, salt = b.column("h").to_numpy(), b.column("salt").to_numpy()
        same = h[1:] == h[:-1]
        keep = salt > 0
        keep[1:] |= same
        keep[:-1] |= same
        # the last row waits for its successor; if it is known to be shared it is passed on now and again only as a neighbour
        last = b.slice(b.num_rows - 1)
        if held is not None and held_kept:
            keep[0] = False
        held_kept = bool(keep[-1]) or (b.num_rows == 1 and held is not None and held_kept)
        yield b.filter(pa.array(keep))
        held = last


def _buckets(threshold: int):
    """Rows sorted by (h, salt, pos, doc) -> pairs (kind 0: a meets b in n buckets) and the records of large buckets (kind 1)."""
    names = ["h", "salt", "doc", "n", "pos"]

    def emit(cols, head):
        """All runs in cols; head is the pivot of the first one if that has begun before."""
        h, salt, doc, n, pos = cols
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(h)]]))
        run = np.cumsum(new) - 1
        large = (size > SMALL) | (salt[first] > 0)
        if head is not None:
            large[0] = True
        a, b = [], []

        def meet(i, j, d2=None, n2=None, p2=None):
            d2, n2, p2 = (doc[j], n[j], pos[j]) if d2 is None else (d2, n2, p2)
            ok = (100 * np.minimum(n[i], n2) >= threshold * np.maximum(n[i], n2)) & (doc[i] != d2)
            ok &= (100 + threshold) * np.minimum(n[i] - pos[i], n2 - p2) >= threshold * (n[i] + n2)
            a.append(doc[i][ok])
            b.append(np.broadcast_to(d2, ok.shape)[ok])

        rows = np.arange(len(h))
        small = ~large[run]
        for d in range(1, SMALL):
            i = rows[d:][(run[d:] == run[:-d]) & small[d:]]
            meet(i, i - d)
        i = rows[large[run] & (rows != first[run])]
        meet(i, first[run[i]])
        if head is not None:  # against the pivot of before
            i = rows[: size[0]]
            meet(i, None, *head)
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        votes = np.diff(np.concatenate([at, [len(a)]]))
        keep = large[run]
        k, m = len(at), int(keep.sum())
        zero = np.zeros(k, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1], np.int8), [k, m])),
                pa.array(np.concatenate([zero, h[keep]])),
                pa.array(np.concatenate([a[at], doc[keep]])),
                pa.array(np.concatenate([b[at], np.zeros(m, np.int64)])),
                pa.array(np.concatenate([votes, n[keep]]).astype(np.int32)),
                pa.array(np.concatenate([zero, pos[keep]]).astype(np.int32)),
            ],
            ["kind", "h", "a", "b", "n", "pos"],
        )

    def run(batches):
        held, head, key = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(x).to_numpy() for x in names]
            cols = [c.astype(np.int64) for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if head is not None and (cols[0][0], cols[1][0]) != key:
                head = None
            tail = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum() + 1) if (cols[0][0], cols[1][0]) != (cols[0][-1], cols[1][-1]) else 0
            if tail:
                yield emit([c[:tail] for c in cols], head)
                head = None
            held = [c[tail:] for c in cols]
            if len(held[0]) > HOLD:
                key = (held[0][0], held[1][0])
                yield emit(held, head if head is not None else (held[2][0], held[3][0], held[4][0]))
                head = head if head is not None else (held[2][0], held[3][0], held[4][0])
                held = None
        if held is not None:
            yield emit(held, head)

    return run


def _wanted(column: str):
    def run(batches):
        total, seen = np.zeros(FILTER, np.int32), False
        for b in batches:
            ids = b.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
            total[(mix(ids.view(_U)) % _U(FILTER)).astype(np.int64)] = 1
            seen = True
        return total if seen else None

    return run


def _sets(shared, words: int):
    """(doc, g) for the documents that the filter, if there is one, lets pass."""

    def run(batches):
        for b in batches:
            if shared is not None:
                ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                b = b.filter(pa.array(shared.value[(mix(ids.view(_U)) % _U(FILTER)).astype(np.int64)]))
            for lo, hi, data, offs in chunks(b.column("text"), LEAN_BYTES):
                sets = shingle_sets(data, offs, words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([g.tobytes() for g in sets], pa.binary())], ["doc", "g"])

    return run


def _apart(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the symmetric difference of two sorted sets (the suffix filter's)."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    return _apart(x[:i], y[:j], depth - 1) + _apart(x[i:], y[j:], depth - 1)


def _verify(threshold: int):
    def run(batches):
        for b in batches:
            good = []
            for gx, gy in zip(b.column("gx"), b.column("gy"), strict=True):
                x, y = np.frombuffer(gx.as_buffer(), _U), np.frombuffer(gy.as_buffer(), _U)
                need = -(-threshold * (len(x) + len(y)) // (100 + threshold))
                if len(x) + len(y) - 2 * need < _apart(x, y, 2):
                    good.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(good, pa.bool_())], ["x", "y", "linked"])

    return run


def _may_link(n1, p1, n2, p2, t: int):
    """Length and positional filters for a shared prefix shingle at p1 of n1 and p2 of n2."""
    need = t * (n1 + n2)
    return (100 * F.least(n1, n2) >= t * F.greatest(n1, n2)) & ((100 + t) * F.least(n1 - p1, n2 - p2) >= need)


def link_components(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    counts = dense_reduce(known.select("text"), _sketch(words), SKETCH, "int64")
    hot = int(HOT_MEANS * counts.mean() + HOT_ROWS)
    shared = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # 4 MB

    rows = materialize(spark, docs.mapInArrow(lean(_classes(words)), "doc_id long, n long, f1 long, f2 long"), "jaccard-docs")
    full = rows.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("comp"), F.max("doc_id").alias("__top")).where("comp <> __top").drop("__top")
    # written first: only classes of several documents are joined, by broadcast or so that a hot class can be split
    classes, seen = counted(spark, classes, "jaccard-classes")
    # a doc_id that has several sets joins their classes
    comp = full.join(light(classes, seen["rows"], LIGHT), ["n", "f1", "f2"], "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    comp = comp.groupBy("doc_id").agg(F.min("comp").alias("comp"), F.max("comp").alias("other"))
    comp, seen = counted(spark, comp, "jaccard-comp", merged=F.count(F.when(F.col("comp") != F.col("other"), 1)), moved=F.count(F.when(F.col("comp") != F.col("doc_id"), 1)))
    n_docs, n_moved = seen["rows"], seen["moved"]
    merged = comp.where("comp <> other").select(F.col("comp").alias("a"), F.col("other").alias("b"))

    records = known.mapInArrow(lean(_records(shared, hot, words, threshold)), "h long, salt int, doc long, n int, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = records.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "pos", "doc")
    buckets = records.mapInArrow(lean(_buckets(threshold)), "kind byte, h long, a long, b long, n int, pos int")
    buckets, seen_buckets = counted(spark, buckets, "jaccard-buckets", large=F.count(F.when(F.col("kind") == 1, 1)))
    # documents whose component is another's id; all others are their own
    edges, moved = merged, comp.select("doc_id", "comp").where("comp <> doc_id")
    if seen["merged"]:
        moved, n_moved = _relabel(spark, comp, edges, n_docs)

    def apart(df: DataFrame, one: str, two: str) -> DataFrame:
        """Pairs whose ends lie in different components."""
        df = _named(_named(df, moved, n_moved, one, "__c1"), moved, n_moved, two, "__c2")
        return df.where("__c1 <> __c2").drop("__c1", "__c2")

    pairs = buckets.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("v"))
    pairs = materialize(spark, apart(pairs, "a", "b"), "jaccard-pairs")
    best = pairs.groupBy("a").agg(F.max(F.struct("v", "b")).alias("best")).select("a", "best.b")
    large = buckets.where("kind = 1").select("h", F.col("a").alias("doc"), "n", "pos")
    open_buckets = bool(seen_buckets["large"])
    tried, n_tried = None, 0
    turn, spread, last = 0, 1, False
    while True:
        if turn == 0:
            todo = best
        else:
            todo = apart(pairs.select("a", "b"), "a", "b") if turn == 1 else None
            if open_buckets:
                met, last = _bucket_pairs(spark, large, moved, n_moved, spread, threshold, last)
                open_buckets = met is not None
                todo = met if todo is None else todo if met is None else todo.union(met)
        if todo is None:
            break
        # each pair once; b is the more central of the two, named by many pairs
        todo = todo.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("b").alias("b"))
        if tried is not None:
            todo = todo.join(light(tried, n_tried, LIGHT), ["x", "y"], "left_anti")
        todo, seen = counted(spark, todo, "jaccard-todo")
        count, found = seen["rows"], 0
        if count:
            checked, found = _check(spark, known, todo, count, threshold, words)
            if found:
                new = checked.where("linked").select("x", "y").distinct()
                new = _named(_named(new, moved, n_moved, "x", "a"), moved, n_moved, "y", "b").select("a", "b")
                edges = materialize(spark, edges.union(new), "jaccard-edges")
                moved, n_moved = _relabel(spark, comp, edges, n_docs)
            pairs_now = todo.select("x", "y")
            tried, n_tried = pairs_now if tried is None else tried.union(pairs_now), n_tried + count
        if turn and (last or not open_buckets):
            break
        last = turn > 0 and not found
        spread += turn > 0
        turn += 1
    release(spark, buckets, pairs, classes)
    out = rows.join(light(moved.withColumnRenamed("comp", "__c"), n_moved, LIGHT), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("__c", "doc_id").alias("component_id"))


def _named(df: DataFrame, moved: DataFrame, n_moved: int, one: str, name: str) -> DataFrame:
    """df with the component of its document ``one`` as ``name``."""
    m = light(moved.select(F.col("doc_id").alias("__d"), F.col("comp").alias("__c")), n_moved, LIGHT)
    return df.join(m, F.col(one) == F.col("__d"), "left").withColumn(name, F.coalesce("__c", one)).drop("__d", "__c")


def _bucket_pairs(spark: SparkSession, large: DataFrame, moved: DataFrame, n_moved: int, spread: int, threshold: int, last: bool) -> tuple[DataFrame | None, bool]:
    """Pairs (a, b) of one large bucket in different components, and whether these are all of them; None if there are none."""
    now = _named(large, moved, n_moved, "doc", "comp")
    size = now.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("k > 1")
    size, seen = counted(spark, size, "jaccard-mixed", left=F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), members=F.sum("s"))
    n = seen["rows"]
    if not n:
        return None, True
    now = materialize(spark, now.join(light(size.select("h"), n, LIGHT), "h"), "jaccard-now")
    if last or seen["left"] <= 4 * seen["members"] + 20_000:
        y = now.select("h", *[F.col(c).alias(f"{c}2") for c in ("doc", "n", "pos", "comp")])
        met = now.join(y, "h").where((F.col("comp") < F.col("comp2")) & _may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), threshold))
        return met.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct(), True
    order = F.struct(F.floor(F.col("pos") / (1 + 3 * spread)).alias("o"), F.xxhash64(F.lit(spread), "doc").alias("r"), "doc", "n", "pos", "comp")
    pivot = now.groupBy("h").agg(F.min(order).alias("p"))
    met = now.join(light(pivot, n, LIGHT), "h").where((F.col("comp") != F.col("p.comp")) & _may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), threshold))
    votes = met.groupBy("doc", F.col("p.doc").alias("pd")).agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy(F.col("doc").alias("a")).agg(F.max(F.struct("v", "pd")).alias("m")).select("a", F.col("m.pd").alias("b")), False


def _check(spark: SparkSession, known: DataFrame, todo: DataFrame, count: int, threshold: int, words: int) -> tuple[DataFrame, int]:
    """(x, y, linked) for todo(x, y), from the whole texts, and the number of links."""
    ids = todo.select(F.explode(F.array("x", "y")).alias("__id"))
    if few(2 * count, LIGHT):
        near = known.join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi").mapInArrow(lean(_sets(None, words)), "doc long, g binary")
    else:
        wanted = dense_reduce(ids, _wanted("__id"), FILTER, "int32")
        near = known.mapInArrow(lean(_sets(spark.sparkContext.broadcast(wanted > 0), words)), "doc long, g binary")  # FILTER bytes, 2 MB
    sets = materialize(spark, near, "jaccard-sets")
    pairs = todo.select("x", "y", "b", F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"))
    # the sets of members are sent once, and of all others only those of their partners
    partners = sets.join(light(todo.select(F.col("b").alias("doc")).distinct(), count, LIGHT), "doc", "left_semi")
    both = light(pairs, count, LIGHT).join(sets.select(F.col("doc").alias("a"), F.col("g").alias("gx")), "a").join(partners.select(F.col("doc").alias("b"), F.col("g").alias("gy")), "b")
    checked = both.select("x", "y", "gx", "gy").mapInArrow(lean(_verify(threshold)), "x long, y long, linked boolean")
    checked, seen = counted(spark, checked, "jaccard-checked", linked=F.count(F.when(F.col("linked"), 1)))
    release(spark, sets)
    return checked, seen["linked"]


def _relabel(spark: SparkSession, comp: DataFrame, edges: DataFrame, n_docs: int) -> tuple[DataFrame, int]:
    """(doc_id, comp) of the documents whose component is another's id, and their number."""
    found = connected_components(spark, edges, "jaccard-cc", LIGHT)
    new = comp.join(light(found.select(F.col("id").alias("comp"), "component"), rows_of(found), LIGHT), "comp", "left")
    new = new.select("doc_id", F.coalesce("component", "comp").alias("comp")).where("comp <> doc_id")
    out, seen = counted(spark, compact(new, n_docs), "jaccard-labels")
    return out, seen["rows"]


def keep_one_each(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """docs without those that link, directly or not, to one with a smaller doc_id.

    Only ids are joined to the rows, so texts aren't shuffled while the ids that go are few.
    Rows that repeat a doc_id stay or go together; rows without a doc_id stay.
    """
    gone = link_components(spark, docs, threshold, words).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone, seen = counted(spark, gone, "jaccard-gone")
    return docs.join(light(gone, seen["rows"], LIGHT), F.col("doc_id") == F.col("__gone"), "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
           THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)
), u AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       coalesce((SELECT min(other) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

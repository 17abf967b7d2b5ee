"""Suffix-array dedup by bucket-pointer refinement: repeated 200-byte strings go.

A byte is removed when a string of LENGTH bytes that covers it also starts anywhere
else, in any document, judged on the input. Suffixes are never sorted in full: only
the question whether two starts share LENGTH bytes matters, so buckets are refined to
that depth and no further.

1. Initial q-gram buckets. Of the q-grams in every LENGTH-byte string the one with the
   smallest hash is its anchor, so equal strings have their anchor at the same offset.
   An anchor's bucket is its q-gram, its class
   the bytes of all strings that it anchors. Buckets with
   one member are final at once (nothing there repeats).
2. A class of two or more repeats as a whole. Only where a bucket holds several classes
   is it refined, on one member of each: the starts of their strings get bucket
   identifiers of their first q bytes, and buckets are refined by sorting on the pair
   (identifier here, identifier at a later offset), the new identifiers being used again
   for twice the depth, until LENGTH bytes are told apart. Buckets of one drop out.
3. Buckets with more than HOT classes are refined by offset ranges instead, as grouped
   counts with map-side sums, so no task holds such a bucket.
4. Copies of whole texts are one class from the start (their bytes all repeat).

Rows are numbered once, with their texts, in the shared folder. Only texts with repeats are
shuffled, once to refine and once to cut. What is broadcast are two sketches of fixed size
and, up to SMALL_ROWS rows, lists of keys. Buckets and classes are told by 64-bit hashes, both of
which must agree before bytes go.

Edge cases: a null text counts as empty; texts shorter than LENGTH keep everything;
repeated rows are copies of each other; matches inside one text count, overlapping ones
too; a very long text is one row; rows that repeat a doc_id are rows of their own;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import dense_reduce, light, materialize, release, table, tune
from riskloom.llm.jaccard import FILTER, SALTS, _shared_only, _wanted
from riskloom.llm.textops import chunks, mix, powers, prefix_hash, ranges, span_hash

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
SKETCH = 1 << 20
HOT = 256
RANGES = 8
STEP = -(-(REACH + 1) // RANGES)
SUB = 4
#: Bits of a place in a group of texts (a text has less than 2**31 bytes).
PLACE_BITS = 32
#: A q-gram is hot, and salted, where its sketch count is above so many means and so many rows.
HOT_MEANS, HOT_ROWS = 4, 1000
#: Texts that a task remembers in order to send equal ones once; later ones are sent each.
KNOWN = 1 << 20
_U = np.uint64
_ODD = _U(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, their text, first start, last start): the leftmost smallest q-gram of every LENGTH-byte string.

    The strings whose anchor is at one position start next to each other, and each has one anchor only.
    """
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < REACH + 1:
        return none, none, none, none
    # hash above, place below: the widths are fixed, so copies of a string choose alike whatever stands around them
    bits = _U(PLACE_BITS)
    at = np.arange(n, dtype=_U)
    with np.errstate(over="ignore"):
        g = (prefix[GRAM:] - prefix[:n]) * powers("down", n)
        g *= _ODD
        g ^= g >> _U(29)
        g *= _U(0x9E3779B97F4A7C15)
    g = (g >> bits << bits) | at
    low = g
    width = 1
    while width * 2 <= REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    # strings that lie in one text
    ok = np.zeros(len(low) + 1, np.int8)
    size = np.diff(offs)
    long = size >= LENGTH
    np.add.at(ok, offs[:-1][long], 1)
    np.add.at(ok, offs[:-1][long] + size[long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    low = low[start] & _U((1 << int(bits)) - 1)
    if not len(low):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    pos = low[new].astype(np.int64)
    return pos, np.searchsorted(offs, pos, "right") - 1, start[new], start[np.concatenate([new[1:], [len(low)]]) - 1]


def _bucket(k: np.ndarray) -> np.ndarray:
    return (k >> _U(44)).astype(np.int64)


def _new_texts(b: pa.RecordBatch, known: set) -> pa.RecordBatch:
    keep = []
    for key in b.column("sha").to_pylist():
        keep.append(key not in known)
        if len(known) < KNOWN:
            known.add(key)
    return b.filter(pa.array(keep, pa.bool_()))


def _sketch(batches):
    total, known, seen = np.zeros(SKETCH, np.int64), set(), False
    for b in batches:
        for _, _, data, offs in chunks(_new_texts(b, known).column("text")):
            p = prefix_hash(data)
            pos = anchors(data, offs, p)[0]
            total += np.bincount(_bucket(span_hash(p, pos, pos + GRAM)), minlength=SKETCH)
            seen = True
    return total if seen else None


def _anchor_rows(shared, hot: int):
    """(h, salt, c, rid, pos, left, right): bucket, class, place and the reach of its strings for each anchor; of equal texts in a task the first's only."""

    def run(batches):
        count, known = shared.value, set()
        for b in batches:
            b = _new_texts(b, known)
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for r0, _, data, offs in chunks(b.column("text")):
                p = prefix_hash(data)
                pos, doc, lo, hi = anchors(data, offs, p)
                hi = hi + LENGTH
                k = span_hash(p, pos, pos + GRAM)
                with np.errstate(over="ignore"):
                    c = mix(span_hash(p, lo, hi) + (pos - lo).astype(_U) * _ODD)
                own = rid[r0 + doc]
                salt = np.where(count[_bucket(k)] > hot, 1 + (mix(own.view(_U) + pos.astype(_U)) % _U(SALTS)).astype(np.int32), 0)
                base = offs[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(c.view(np.int64)), pa.array(own), pa.array(pos - base), pa.array((pos - lo).astype(np.int16)), pa.array((hi - pos).astype(np.int16))],
                    ["h", "salt", "c", "rid", "pos", "left", "right"],
                )

    return run


def _only(shared):
    """Rows whose rid the filter lets pass."""

    def run(batches):
        for b in batches:
            ids = b.column("rid").to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(shared.value[(mix(ids.view(_U)) % _U(FILTER)).astype(np.int64)]))

    return run


def _contexts(batches):
    """(h, hot, rid, from, left, bytes) for the places listed with each text."""
    for b in batches:
        h, hot, rid, start, left, ctx = [], [], [], [], [], []
        for r, text, places in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
            raw = text.encode()
            for p in places:
                lo = p["pos"] - p["left"]
                h.append(p["h"])
                hot.append(p["hot"])
                rid.append(r)
                start.append(lo)
                left.append(p["left"])
                ctx.append(raw[lo : p["pos"] + p["right"]])
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(hot, pa.bool_()), pa.array(rid, pa.int64()), pa.array(start, pa.int64()), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())], ["h", "hot", "rid", "start", "left", "ctx"])


def refine(group: np.ndarray, text: np.ndarray, offs: np.ndarray, step: int = GRAM // 2 + 8) -> np.ndarray:
    """Bucket-pointer refinement of many small texts at once.

    text/offs: the contexts one after the other; group: their buckets. Returns the
    positions of all starts whose LENGTH bytes (inside their context) occur again in the
    same group. ``step`` divides LENGTH.
    """
    size = np.diff(offs)
    n = len(text)
    p = prefix_hash(text)
    whole = np.maximum(0, size - step + 1)
    at = np.repeat(offs[:-1], whole) + ranges(whole)
    owner = np.repeat(np.arange(len(size)), whole)
    with np.errstate(over="ignore"):
        key = mix(span_hash(p, at, at + step) + group[owner].view(_U) * _ODD)
    bucket = np.zeros(n + 1, np.int64)  # 0: no such string or nothing equal to it
    _, first, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    bucket[at] = np.where(times[inverse] > 1, first[inverse] + 1, 0)
    starts = np.maximum(0, size - LENGTH + 1)
    live = np.repeat(offs[:-1], starts) + ranges(starts)
    base = bucket.copy()
    depth = step
    while depth < LENGTH and len(live):
        more = min(depth, LENGTH - depth)
        # the identifiers of twice the depth; the last step needs step bytes at a later offset only
        where = np.flatnonzero(bucket[:-1]) if more == depth else live
        later = (bucket if more == depth else base)[np.minimum(where + depth if more == depth else where + LENGTH - step, n)]
        pair = bucket[where] * np.int64(n + 2) + later
        good = (bucket[where] > 0) & (later > 0)
        where, pair = where[good], pair[good]
        _, first, inverse, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        nxt = np.zeros(n + 1, np.int64)
        nxt[where[again]] = first[inverse[again]] + 1
        bucket = nxt
        live = live[bucket[live] > 0]
        depth += more if more == depth else LENGTH - depth
    return live


def _refine_groups(batches):
    """Rows sorted by h -> (rid, lo, hi): stretches whose strings repeat."""
    held: list[pa.RecordBatch] = []

    def work(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        rid, start = t.column("rid").to_numpy(), t.column("start").to_numpy()
        ctx = t.column("ctx").combine_chunks().cast(pa.large_binary())
        _, offs, data = ctx.buffers()
        offs = np.frombuffer(offs, np.int64)[ctx.offset : ctx.offset + len(ctx) + 1]
        data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        live = refine(t.column("h").to_numpy().astype(np.int64), data, offs)
        if not len(live):
            return None
        own = np.searchsorted(offs, live, "right") - 1
        new = np.concatenate([[True], (np.diff(live) != 1) | (np.diff(own) != 0)])
        a = np.flatnonzero(new)
        z = np.concatenate([a[1:], [len(live)]]) - 1
        place = start[own] - offs[own]
        return pa.RecordBatch.from_arrays([pa.array(rid[own[a]]), pa.array((live + place)[a]), pa.array((live + place)[z] + LENGTH)], ["rid", "lo", "hi"])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column("h").to_numpy()
        held.append(b)
        rows += b.num_rows
        if rows > 4000 and h[0] != h[-1]:
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
            held[-1] = b.slice(0, cut)
            if out := work(held):
                yield out
            held, rows = [b.slice(cut)], b.num_rows - cut
    if held and (out := work(held)):
        yield out


def _offset_ranges(batches):
    """Hot buckets: one row for each range of offsets.

    k is the hash of the bytes that all strings of the range share, cores those of its
    parts of SUB strings; c is its class; hs holds the hash of each string, in order
    from lo on, null where a string is not this anchor's.
    """
    for b in batches:
        rid, start, left = b.column("rid").to_numpy(), b.column("start").to_numpy(), b.column("left").to_numpy()
        cols = [[] for _ in range(6)]
        for i, raw in enumerate(b.column("ctx").to_pylist()):
            p = prefix_hash(np.frombuffer(raw, np.uint8))
            at, last = int(left[i]), len(raw) - LENGTH

            def core(r0, r1, salt, p=p, at=at):
                h = span_hash(p, np.array([at - r0]), np.array([at - r1 + LENGTH]))
                with np.errstate(over="ignore"):
                    return int(mix(h + _U(salt) * _ODD).view(np.int64)[0])

            for r in range(RANGES):
                # strings that start r0..r1 bytes before the anchor
                r0, r1 = r * STEP, min(REACH, (r + 1) * STEP - 1)
                s = np.arange(at - r1, at - r0 + 1)
                own = (s >= 0) & (s <= last)
                if not own.any():
                    continue
                hs = [None] * len(s)
                for j, h in zip(np.flatnonzero(own).tolist(), span_hash(p, s[own], s[own] + LENGTH).view(np.int64).tolist(), strict=True):
                    hs[j] = h
                cores = [core(max(r0, r1 - u - SUB + 1), r1 - u, 1000 * r + u + 1) if own[u : u + SUB].any() else None for u in range(0, len(s), SUB)]
                for c, v in zip(cols, (core(r0, r1, r + 1), hash(tuple(hs)), int(rid[i]), int(start[i] + s[0]), cores, hs), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "c", "rid", "lo", "cores", "hs"])


def _spans_of(df: DataFrame, hs: str, lo) -> DataFrame:
    """(rid, lo, hi) from the first to the last string that is there."""
    there = F.filter(F.transform(F.col(hs), lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull())
    return df.select("rid", (lo + F.array_min(there)).alias("lo"), (lo + F.array_max(there) + LENGTH).alias("hi"))


def _refine_hot(spark: SparkSession, contexts: DataFrame) -> DataFrame:
    """(rid, lo, hi) for hot buckets: ranges of offsets, parts of them, then single strings; what is one class repeats whole, what is alone drops out."""
    ranged = contexts.mapInArrow(_offset_ranges, "k long, c long, rid long, lo long, cores array<long>, hs array<long>")
    ranged = materialize(spark, ranged, "suffix-ranges")

    written = [ranged]

    def split(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        # what repeats as a whole, and one member of each class where a bucket holds several; frames are
        # written before they are joined, so that each join is a broadcast or one that can split a hot class
        kinds = df.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "lo")).alias("one"))
        kinds = materialize(spark, kinds, "suffix-kinds")
        several = materialize(spark, kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds"), "suffix-mixed")
        ones = kinds.join(light(several, several.count()), keys).select("one.*", *keys)
        ones = materialize(spark, ones, "suffix-ones")
        first = df.join(light(ones, ones.count()), ["rid", "lo", *keys])
        again = materialize(spark, kinds.where("times > 1").drop("times", "one"), "suffix-again")
        written.extend((kinds, several, ones, again))
        return df.join(light(again, again.count()), [*keys, "c"], "left_semi"), first

    whole, mixed = split(ranged, ["k"])
    parts = mixed.select("rid", "lo", "hs", F.posexplode("cores").alias("u", "core")).where("core is not null")
    parts = parts.select("rid", "core", (F.col("lo") + F.col("u") * SUB).alias("lo"), F.slice("hs", F.col("u") * SUB + 1, SUB).alias("hs"))
    parts = materialize(spark, parts.withColumn("c", F.xxhash64("hs")), "suffix-parts")
    written.append(parts)
    whole2, mixed2 = split(parts, ["core"])
    one = mixed2.select("rid", "lo", F.posexplode("hs").alias("i", "w")).where("w is not null").select("rid", (F.col("lo") + F.col("i")).alias("lo"), "w")
    place = F.struct("rid", "lo")
    again = materialize(spark, one.groupBy("w").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("w"), "suffix-single")
    written.append(again)
    single = one.join(light(again, again.count()), "w", "left_semi").select("rid", "lo", (F.col("lo") + LENGTH).alias("hi"))
    out = _spans_of(whole, "hs", F.col("lo")).unionByName(_spans_of(whole2, "hs", F.col("lo"))).unionByName(single)
    out = materialize(spark, out, "suffix-hot")
    release(spark, *written)
    return out


def _cut(batches):
    """(rid, n_removed, n_spans, kept) from texts with their stretches."""
    for b in batches:
        out = [[], [], [], []]
        for rid, text, spans in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            at, removed, runs, kept, end = 0, 0, 0, [], -1
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                if lo > end:
                    if runs:
                        removed += end - at
                        at = end
                    kept.append(raw[at:lo])
                    at, end = lo, hi
                    runs += 1
                end = max(end, hi)
            removed += end - at if runs else 0
            kept.append(raw[end if runs else 0 :])
            for c, v in zip(out, (rid, removed, runs, b"".join(kept)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array([hashlib.sha256(k).hexdigest() for k in out[3]]), pa.array(out[3], pa.binary())], ["rid", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, rid, sha, n_bytes, text), written once: rid numbers the rows, sha tells equal texts."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return materialize(spark, keyed, "suffix-docs")


def _wanted_texts(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rid, text) of at least all documents in ids(rid)."""
    wanted = dense_reduce(ids, _wanted("rid"), FILTER, "int32")
    shared = spark.sparkContext.broadcast(wanted > 0)  # FILTER bytes, 2 MB
    return docs.select("rid", "text").mapInArrow(_only(shared), "rid long, text string")


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(rid, lo, hi): stretches (may overlap) made of repeated strings, for keyed docs; whole copies are left out."""
    texts = docs.where(F.col("n_bytes") >= LENGTH).select("rid", "sha", "text")
    counts = dense_reduce(texts, _sketch, SKETCH, "int64")
    hot = int(HOT_MEANS * counts.mean() + HOT_ROWS)
    shared = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # 4 MB
    found = texts.mapInArrow(_anchor_rows(shared, hot), "h long, salt int, c long, rid long, pos long, left short, right short")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt")
    found = materialize(spark, found.mapInArrow(_shared_only, found.schema).drop("salt"), "suffix-anchors")

    place = F.struct("rid", "pos", "left", "right")
    classes = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    classes = materialize(spark, classes, "suffix-classes")
    several = materialize(spark, classes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-several")
    repeated = materialize(spark, classes.where("n > 1").select("h", "c"), "suffix-repeated")
    full = found.join(light(repeated, repeated.count()), ["h", "c"], "left_semi")  # while they are few the hot ones stay where they are
    full = full.select("rid", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right")).alias("hi"))

    todo = classes.join(light(several, several.count()), "h").select("h", (F.col("kinds") > HOT).alias("hot"), "one.*")
    todo = materialize(spark, todo, "suffix-todo")
    listed = todo.groupBy("rid").agg(F.collect_list(F.struct("h", "hot", "pos", F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"))).alias("places"))
    wanted = _wanted_texts(spark, docs, todo.select("rid"))
    schema = "h long, hot boolean, rid long, start long, left int, ctx binary"
    contexts = materialize(spark, listed.join(wanted, "rid").select("rid", "text", "places").mapInArrow(_contexts, schema), "suffix-contexts")

    cool = contexts.where("not hot").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_refine_groups, "rid long, lo long, hi long")
    out = materialize(spark, full.unionByName(cool).unionByName(_refine_hot(spark, contexts.where("hot"))), "suffix-spans")
    release(spark, found, classes, several, repeated, todo, contexts)
    return out


def cut_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs(doc_id, text); kept is null where the whole text stays."""
    tune(spark)
    keyed = _keyed(spark, docs)
    rows = keyed.select("doc_id", "rid", "sha", "n_bytes")
    copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", F.lit(True).alias("copy"))
    copies = materialize(spark, copies, "suffix-copies")
    rows = materialize(spark, rows.join(light(copies, 2 * copies.count()), "sha", "left"), "suffix-rows")
    spans = repeated_spans(spark, keyed)
    # whole copies need no cutting
    copied = rows.where("copy").select("rid")
    partial = materialize(spark, spans.join(light(copied, copied.count()), "rid", "left_anti").distinct(), "suffix-partial")
    release(spark, spans, copies)
    listed = partial.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    texts = _wanted_texts(spark, keyed, partial.select("rid"))
    cut = listed.join(texts, "rid").select("rid", "text", "spans").mapInArrow(_cut, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.coalesce("copy", F.lit(False))
    return rows.join(cut, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")

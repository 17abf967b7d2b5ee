"""Context-triggered piecewise hashing: fingerprints that stay alike where texts do.

``fingerprint_texts`` cuts the UTF-8 bytes of a text where a rolling hash of the last WINDOW
bytes ends in at least ``level`` zero bits, so that an edit moves the cuts near it only, and
writes one character of 64 for each chunk's hash. The level is the smallest, from LOWEST on,
that gives at most SIGNATURE chunks; a fingerprint is ``level:signature:signature of the
next level``. Boundaries of a level are boundaries of all levels below, so nothing is cut
off and no chunk is left out, however long a text is.

``likeness`` compares two fingerprints of equal or neighbouring levels at the levels they
share: 1 - edits / (sum of both lengths), where an edit inserts or deletes a chunk and the
signatures must have a run of chunks in common (RUN of them, fewer for short signatures);
otherwise 0. Equal fingerprints have 1. The edit distance is worked out for many pairs at
a time, a pair's row of the table being one 64-bit number.

The query also needs each document's successor by doc_id: documents are dealt to ranges of
doc_id, sorted there, and each range is lent the first document of the next. Every text is
shuffled once; what reaches the driver is one doc_id for each range (RANGES for a shuffle partition).

Edge cases: a null text counts as empty; empty texts have empty signatures and equal each
other; equal texts have equal fingerprints; rows that repeat a doc_id follow each other by
their texts; a null doc_id comes after all others; one document alone is its own successor;
other input columns aren't read by the query and pass through fingerprint_texts, whose own
column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import table, tune
from riskloom.llm.textops import chunks, prefix_hash, span_hash

WINDOW = 7
SIGNATURE = 64
LOWEST, HIGHEST = 2, 48
RUN = 5
#: Ranges of doc_id for each shuffle partition, so that tasks are of like size.
RANGES = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_U = np.uint64


def _zero_bits(h: np.ndarray) -> np.ndarray:
    """How many of the last bits of each hash are zero, HIGHEST + 1 at most."""
    low = h & (~h + _U(1))
    out = np.frexp(low.astype(np.float64))[1] - 1
    return np.where(h == 0, HIGHEST + 1, np.minimum(out, HIGHEST + 1)).astype(np.int64)


def _group(data: np.ndarray, offs: np.ndarray) -> list[str]:
    n = len(offs) - 1
    prefix = prefix_hash(data)
    end = np.arange(1, len(data) + 1)
    # a window never reaches into the text before
    first = np.repeat(offs[:-1], np.diff(offs))
    rolling = span_hash(prefix, np.maximum(end - WINDOW, first), end)
    cut = np.flatnonzero((rolling & _U((1 << LOWEST) - 1)) == 0)
    zeros = _zero_bits(rolling[cut])
    end = cut + 1
    of = np.searchsorted(offs, cut, "right") - 1
    inner = end < offs[of + 1]  # the end of a text ends its last chunk at every level
    end, zeros, of = end[inner], zeros[inner], of[inner]
    width = HIGHEST + 2
    counts = np.bincount(of * width + zeros, minlength=n * width).reshape(n, width)
    at_least = counts[:, ::-1].cumsum(1)[:, ::-1] + (np.diff(offs) > 0)[:, None]  # chunks by level
    level = LOWEST + np.argmax(at_least[:, LOWEST:] <= SIGNATURE, axis=1)
    level = np.where((at_least[:, LOWEST:] <= SIGNATURE).any(1), level, HIGHEST + 2)
    signatures = []
    for up in (0, 1):
        here = zeros >= (level + up)[of]
        ends, owner = end[here], of[here]
        full = np.flatnonzero(np.diff(offs))
        ends, owner = np.concatenate([ends, offs[1:][full]]), np.concatenate([owner, full])
        order = np.argsort(ends, kind="stable")
        ends, owner = ends[order], owner[order]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        letters = _LETTERS[(span_hash(prefix, starts, ends) >> _U(58)).astype(np.int64)].tobytes().decode()
        edge = np.searchsorted(owner, np.arange(n + 1))
        signatures.append([letters[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
    return [f"{k}:{a}:{b}" for k, a, b in zip(level.tolist(), *signatures, strict=True)]


def fingerprints(texts: list[str | None]) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = []
    for _, _, data, offs in chunks(pa.array(texts, pa.string())):
        out += _group(data, offs)
    return out


def _rows(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in signatures], np.int64)
    out = np.full((len(signatures), SIGNATURE), 255, np.uint8)
    flat = np.frombuffer("".join(signatures).encode(), np.uint8)
    out[np.arange(SIGNATURE) < size[:, None]] = flat
    return out, size


def signature_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of each pair of signatures, SIGNATURE characters at most."""
    x, nx = _rows(a)
    y, ny = _rows(b)
    pairs = np.arange(len(a))
    where = np.zeros((256, len(a)), _U)  # bit i of [c, p]: character i of a's p-th signature is c
    for i in range(SIGNATURE):
        where[x[:, i], pairs] |= _U(1 << i)
    where[255] = 0
    state = np.full(len(a), 2**64 - 1, _U)
    runs = [np.zeros(len(a), _U) for _ in range(RUN)]
    longest = np.zeros(len(a), np.int64)
    with np.errstate(over="ignore"):
        for j in range(int(ny.max(initial=0))):
            met = where[y[:, j], pairs]
            kept = state & met
            state = (state + kept) | (state - kept)
            before = None
            for r in range(RUN):
                old = runs[r]
                runs[r] = met if before is None else met & (before << _U(1))
                before = old
                longest = np.maximum(longest, np.where(runs[r] != 0, r + 1, 0))
    common = np.bitwise_count(~state).astype(np.int64)
    total = nx + ny
    need = np.clip(-(-np.maximum(nx, ny) // 4), 1, RUN)
    out = np.where((total > 0) & (longest >= need), 2 * common / np.maximum(total, 1), 0.0)
    return np.where([s == t for s, t in zip(a, b, strict=True)], 1.0, out)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    left, right = [f.split(":") for f in a], [f.split(":") for f in b]
    out = np.zeros(len(a))
    for i, j in ((1, 1), (1, 2), (2, 1)):  # the signatures of the lowest level that both have
        on = [k for k, (f, g) in enumerate(zip(left, right, strict=True)) if int(f[0]) + i == int(g[0]) + j]
        if on:
            out[on] = signature_likeness([left[k][i] for k in on], [right[k][j] for k in on])
    return np.where([f == g for f, g in zip(a, b, strict=True)], 1.0, out)


def fingerprint_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with fingerprint, of the text in column."""
    tune(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        return pd.Series(fingerprints(texts.tolist()), dtype=object)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"], of(F.col(f"`{column}`")).alias("fingerprint"))


def edited(text: str, after: str) -> str:
    """text, its second half replaced by as many characters from the start of after (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, lent, doc_id, text): documents in ranges of doc_id, each sorted and followed by the first rows of the next range (lent).

    The last range is lent the first rows of all. Rows of one doc_id are in one range.
    """
    spark = docs.sparkSession
    parts = parts or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})

    # how many cuts are not above doc_id, by halving
    known = F.expr(f"array({', '.join(f'CAST({c} AS BIGINT)' for c in cuts)})" if cuts else "CAST(array() AS array<bigint>)")
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length() or 1))])
    below = F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w <= len(cuts)) & (F.get(known, at + w - 1) <= F.col("doc_id")), at + w).otherwise(at))
    part = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(below)

    placed = docs.withColumn("part", part)
    # one row for each range: its first doc_id, nulls last
    firsts = docs.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    if not firsts:
        return placed.select("part", F.lit(False).alias("lent"), "doc_id", "text")
    borrower = {firsts[k]["part"]: firsts[k - 1]["part"] for k in range(len(firsts))}  # of each range's first rows
    loans = spark.createDataFrame([(r["part"], r["first"], borrower[r["part"]]) for r in firsts], "p int, first long, to int")
    lent = placed.join(F.broadcast(loans), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first")))
    lent = lent.select(F.col("to").alias("part"), F.lit(True).alias("lent"), "doc_id", "text")
    out = placed.select("part", F.lit(False).alias("lent"), "doc_id", "text").union(lent)
    return out.repartition(len(firsts), "part").sortWithinPartitions("part", "lent", F.col("doc_id").asc_nulls_last(), "text")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, near_edited, near_next) of every document."""
    tune(docs.sparkSession)

    def judged(part: int, rows: list[tuple], after: tuple) -> pa.RecordBatch:
        """rows (doc_id, text), the last followed by after."""
        texts = [t for _, t in rows]
        follow = [*texts[1:], after[1]]
        changed = [edited(t, u) for t, u in zip(texts, follow, strict=True)]
        own = fingerprints([*texts, after[1]])
        new = fingerprints(changed)
        near = likeness([*own[:-1], *own[:-1]], [*new, *own[1:]])
        n = len(rows)
        columns = [pa.array([d for d, _ in rows], pa.int64()), pa.array(texts, pa.string()), pa.array(own[:-1]), pa.array(changed, pa.string()), pa.array(new), pa.array(near[:n]), pa.array(near[n:])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "fingerprint", "edited", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        now, rows, done = None, [], True  # done: the range's loan has been met
        for b in batches:
            for part, lent, doc_id, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part != now:
                    now, rows, done = part, [], False
                if not lent:
                    rows.append((doc_id, text))
                elif not done:
                    yield judged(part, rows, (doc_id, text))
                    rows, done = [], True
            if len(rows) > 1:  # the last row waits for the next batch
                yield judged(now, rows[:-1], rows[-1])
                rows = rows[-1:]

    schema = "doc_id long, text string, fingerprint string, edited string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs).mapInArrow(run, T.StructType.fromDDL(schema))


def op12_fuzzy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are, and how like the next document."""
    out = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")

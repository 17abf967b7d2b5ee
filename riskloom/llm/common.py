"""Session helpers shared by the training-data operators.

Everything that several tasks must see goes to the folder named by
``spark.checkpoint.dir``; a folder of our own is used only where that setting is
absent (tests on one machine).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: keeps a batch of ordinary documents near a few MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Lower the Arrow batch size of the session where it is above BATCH_ROWS."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow; when a task ends, its worker, which stays, gives back the memory that Arrow holds in reserve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where all run in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not given and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return given or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    return out


def counted(spark: SparkSession, df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """materialize, with what was observed as the rows were written: ``rows``, their number, and the given aggregates. No job of its own."""
    seen = Observation()
    out = materialize(spark, df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in sums.items()]), label)
    out._riskloom_rows = seen.get["rows"]
    return out, seen.get


def rows_of(df: DataFrame) -> int:
    """The row count: as observed when the frame was written, or by a job."""
    n = getattr(df, "_riskloom_rows", None)
    return df.count() if n is None else n


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_riskloom_path", None)
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def dense_reduce(
    df: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None],
    size: int,
    dtype: str = "float64",
    chunks: int = 64,
) -> np.ndarray:
    """Element-wise sum of one fixed-size array per task, returned to the driver.

    ``size`` is a constant of the caller, so what reaches the driver is bounded
    whatever the input: the partial arrays are cut into ``chunks`` pieces, every
    piece is summed by one task that streams over its parts, and only the
    ``size`` totals are collected.
    """
    step = -(-size // chunks)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is None:
            return
        total = np.ascontiguousarray(total.reshape(-1).astype(dtype, copy=False))
        parts = [(k, total[k * step : (k + 1) * step]) for k in range(chunks)]
        parts = [(k, p.tobytes()) for k, p in parts if p.size and p.any()]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["k", "part"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, dtype)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "part"]
            )

    rows = df.mapInArrow(lean(emit), "k int, part binary").repartition(chunks, "k").mapInArrow(lean(merge), "k int, part binary")
    out = np.zeros(size, dtype)
    for row in rows.collect():  # size items in all
        out[row["k"] * step : row["k"] * step + len(row["part"]) // out.itemsize] += np.frombuffer(row["part"], dtype)
    return out


def held_out(doc_id):
    """The column that marks the rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


#: Frames of at most so many rows are broadcast: 16 MB of two numbers, and no more than 100 MB with the widest keys used (64 characters). Larger ones are joined by shuffle.
SMALL_ROWS = 1 << 20


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than a known row count is worth."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, min(parts, -(-rows // 20_000))))


def few(rows: int, most: int | None = None) -> bool:
    """Whether so many rows may be broadcast; a caller that sends many frames sets a smaller bound."""
    return rows <= (SMALL_ROWS if most is None else min(most, SMALL_ROWS))


def light(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """df marked for broadcast if its row count is small."""
    return F.broadcast(df) if few(rows, most) else df


def connected_components(spark: SparkSession, edges: DataFrame, label: str = "cc", most: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges(a, b).

    Rounds of contraction: every vertex hooks on to its smallest neighbour if that is
    smaller, pointers are followed to their roots (each pass covers four times the
    distance), and the edges between different roots go on. Both loops take a number of
    passes that grows with the logarithm of the graph. Only counts reach the driver, and
    those are observed as frames are written. Minima are partially aggregated, so a vertex
    with very many links is no hot task. Frames are broadcast up to ``most`` rows.
    """

    def between(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges, seen = counted(spark, between(edges), f"{label}-edges")
    n, known, size = seen["rows"], None, 0
    while n:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks, seen = counted(spark, compact(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a"), n), f"{label}-hooks")
        k = seen["rows"]
        while True:
            far = hooks
            for _ in range(3):
                step = light(hooks.select(F.col("a").alias("p"), F.col("p").alias("q")), k, most)
                far = far.join(step, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
            # whoever didn't move in the last step stands at a root
            far, seen = counted(spark, compact(far, k), f"{label}-hooks", moved=F.count(F.when(F.col("moved"), 1)))
            release(spark, hooks)
            hooks = far.select("a", "p")
            hooks._riskloom_path = far._riskloom_path
            if not seen["moved"]:
                break
        root = light(hooks.select(F.col("a").alias("v"), F.col("p").alias("r")), k, most)
        old = known if known is not None else both.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
        old = old.join(root, F.col("component") == F.col("v"), "left").select("id", F.coalesce("r", "component").alias("component"))
        known, seen = counted(spark, compact(old, 2 * (size or n)), f"{label}-known")
        size = seen["rows"]
        ends = edges.join(root, F.col("a") == F.col("v"), "left").select(F.coalesce("r", "a").alias("a"), "b")
        ends = ends.join(root, F.col("b") == F.col("v"), "left").select("a", F.coalesce("r", "b").alias("b"))
        left, seen = counted(spark, compact(between(ends), n), f"{label}-edges")
        release(spark, edges, hooks)
        edges, n = left, seen["rows"]
    return known if known is not None else spark.createDataFrame([], "id long, component long")

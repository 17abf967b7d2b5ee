"""Taint as a relation: which names of which scope external input reaches, to be looked at and joined.

``edges`` is a table of what Python files' assignments and loops say: in a scope of a file an
atom (a name's key, or an input) leads to keys. ``tainted`` closes over it in rounds: what was new in
the last round is joined with the edges on (file, scope, atom), and what that adds is the
next round's. A round reaches names that are one assignment further away, so there are at
most as many rounds as the longest chain of assignments in one scope, and one more; scopes
never meet, so all files are closed over together. Each round is written to the shared folder, and only its
count reaches the driver.

The rule A-1 closes over one file at a time (operators.taint.closure); both give the same names.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import taint
from riskloom.plans.file_pass import shared_folder
from riskloom.sources.corpus import Corpus

EDGE = "array<struct<scope: int, atom: string, targets: array<string>>>"
KEYS = ["file_path", "scope", "atom"]


def edges(c: Corpus) -> DataFrame:
    """(file_path, scope, atom, targets): scope 0 is the module, functions are 1, 2, ... in the order of the visit."""

    @F.arrow_udf(EDGE)
    def of(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("scope", pa.int32()), ("atom", pa.string()), ("targets", pa.list_(pa.string()))]))
        return pa.array([[{"scope": s, "atom": a, "targets": sorted(t)} for s, a, t in taint.key_edges(x)] for x in text.to_pylist()], kind)

    files = c.files.where(F.col("name").endswith(".py") & F.col("text").isNotNull())
    rows = files.select(F.col("path").alias("file_path"), F.explode(of("text")).alias("e")).select("file_path", "e.*")
    return rows.groupBy(*KEYS).agg(F.array_distinct(F.flatten(F.collect_set("targets"))).alias("targets"))


def tainted(c: Corpus) -> DataFrame:
    """(file_path, scope, name, round): the names that input reaches and how many assignments away it is, at least."""
    spark = c.spark
    folder = f"{shared_folder(spark)}/taint-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def targets(df: DataFrame, number: int) -> DataFrame:
        return df.select("file_path", "scope", F.explode("targets").alias("atom")).distinct().withColumn("round", F.lit(number))

    known = written(edges(c), "edges")
    number = 1
    new = written(targets(known.where(F.col("atom").startswith("input:")), number), "round=1")
    reached = new
    while new.limit(1).count():
        number += 1
        further = targets(new.select(*KEYS).join(known, KEYS), number)
        new = written(further.join(reached.select(*KEYS), KEYS, "left_anti").select("file_path", "scope", "atom", "round"), f"round={number}")
        reached = reached.union(new)
    return reached.select("file_path", "scope", F.expr("substr(atom, 5)").alias("name"), "round")

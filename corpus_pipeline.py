"""The corpus pipeline: documents in, packed token sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.

In every stage a null text is no text: it is scored, keeps its row and is packed as the end
id alone. Rows that repeat a doc_id are rows of their own in scoring, line dedup, mixing and
packing; the Jaccard stage keeps or drops them together. Rows without a doc_id link with
nothing. Extra columns pass through all stages but the last, whatever their names
(set aside where an operator uses the name). An empty table gives an empty table. Ties: see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import jaccard, linededup, mixing, packing, quality
from riskloom.llm.common import materialize, release, table, tune

#: No SQL: a trained classifier, a keyed permutation and a tokenizer can't be expressed in it.
ORACLE_SQL = None


def _columns(out: DataFrame, like: DataFrame) -> DataFrame:
    """out with the columns of like; n_chars follows the text."""
    if "n_chars" in like.columns:
        out = out.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in like.columns])


#: A document goes when its score is below this; the score's two ends are far apart, so clean documents stay.
MIN_QUALITY = 0.3
#: Token pieces that a worker of the packing stage keeps.
PIECES = 300_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the model learns from the labels of sf_dir."""
    model = quality.train_quality(spark, docs, table(spark, sf_dir, "labels"))
    # an input column named quality_score is set aside, as the scores take that name
    names = {c: f"__own_{i}" if c == "quality_score" else c for i, c in enumerate(docs.columns)}
    scored = quality.score_quality(spark, docs.withColumnsRenamed(names), model)
    kept = scored.where(F.col("quality_score") >= MIN_QUALITY)
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document left empty keeps its row."""
    names = {c: f"__own_{i}" if c in ("n_lines", "n_removed") else c for i, c in enumerate(docs.columns)}
    out = linededup.dedup_lines(docs.withColumnsRenamed(names))
    return _columns(out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()]), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id; a document left empty by the line stage links with nothing and stays."""
    return jaccard.keep_one_each(spark, docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, scarce sources up to twice; one row for each use."""
    names = {c: f"own_{i}_{c}" if c.startswith(("mix_", "__mix_")) else c for i, c in enumerate(docs.columns)}
    out = mixing.mix_sources(spark, docs.withColumnsRenamed(names), max_repeat=2.0)
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence."""
    tune(spark)
    # workers and heap still hold what earlier stages needed: a smaller cache of token pieces
    return packing.pack_documents(docs, max_pieces=PIECES)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            release(spark, before)  # nothing reads a stage's output once the next one's is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed; a window that occurs more than
once anywhere is kept at its first place (smallest doc_id, then line) and every
later occurrence removes the lines it covers; overlapping removals merge.

Built of DataFrame operators: windows are pre-aggregated map-side before the
shuffle, the repeated ones are written and joined back by an equi-join that adaptive
execution may split, and no line list leaves its document's row.

Edge cases: a null text stays null, an empty text empty; a text of fewer than
three lines has no window and stays whole; a text all of whose lines go becomes
empty (its row stays); rows that repeat doc_id and text count as one document and
get the same result; a null doc_id sorts first; blank lines are lines like others. Input columns named n_lines or n_removed are replaced, all
others pass through. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, table

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(id, rk, at, h1, h2) for every window; at counts lines from 0."""
    lines = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rk"), F.split("text", "\n").alias("l"))
    lines = lines.where(F.size("l") >= WINDOW)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("l", i + 1, WINDOW), "\n").alias("w"))))
    spans = lines.select("id", "rk", at.alias("x"))
    return spans.select("id", "rk", "x.at", F.xxhash64("x.w").alias("h1"), F.hash("x.w").alias("h2"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text reduced to the lines kept, plus n_lines (before) and n_removed."""
    spark = docs.sparkSession
    windows = _windows(docs)
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rk", "at")).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    # written first: a merge join of two plain inputs is one that can split a hot window
    repeated = materialize(spark, repeated, "lines-repeated")
    later = windows.join(repeated.hint("merge"), ["h1", "h2"]).where(~F.struct("id", "rk", "at").eqNullSafe(F.col("first")))
    cover = (
        later.groupBy("id", "rk")
        .agg(F.collect_set("at").alias("at"))
        .select(F.col("id").alias("__id"), F.col("rk").alias("__rk"), F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (WINDOW - 1))))).alias("__gone"))
    )
    cover = materialize(spark, cover, "lines-cover")  # as above, for a row that is repeated very often
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*[docs[f"`{c}`"] for c in names]).withColumn("__key", F.xxhash64("doc_id", "text"))
    joined = base.join(cover.hint("merge"), (F.col("__key") == F.col("__rk")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        *[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5) of every document."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, pos,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS w
  FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k
  FROM w WHERE w IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM r, (VALUES (0), (1), (2)) t(d) WHERE k > 1
), k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       md5(CASE WHEN d.text IS NOT NULL THEN k.kept END) AS kept_md5
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""

"""A corpus of files as relations: files, lines, manifests.

``files`` must hold path and either content (BINARY) or text (STRING); mode is
optional. Everything else is derived lazily, without a shuffle: lines are generated
from the file row, contexts are slices of the file's own line array.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.advisories import Lookup

#: Line ends as text files have them, after universal newlines.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: The same where no two characters make one line end.
SINGLE_END = "[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: White space as text processing strips it from lines.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: (preceding, following) lines of each context column of raw lines
CONTEXTS = {"ctx33": (3, 3), "ctx46": (4, 6), "ctx24": (2, 4), "ctx34": (3, 4)}


def suffix_of(name):
    """The last dot segment, lower case; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def with_text(files: DataFrame) -> DataFrame:
    """files(path, content, mode) with text (NULL unless UTF-8) and text_lossy (bad bytes dropped)."""
    raw = F.col("content").cast("string")
    out = files.withColumn("text", F.try_validate_utf8(raw)).withColumn("text_lossy", F.coalesce("text", F.replace(F.make_valid_utf8(raw), F.lit("�"))))
    return out.drop("content")


def split_lines(column: str):
    """The lines of a text; a line end at the very end ends the last line."""
    text = F.col(column)
    parts = F.split(F.when(text.contains("\r"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text), SINGLE_END)
    # the parts are named once, so that they aren't made again for each use
    lines = F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.get(lines, F.lit(0)))


def strip_lines(lines: str):
    return F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))


def line_struct(contexts: dict[str, str]):
    """Function of (line, index) giving a struct (line, raw, s, contexts) from the columns ls and ss.

    contexts names the contexts wanted and says of which files (a condition): null elsewhere.
    """

    def line(raw, i):
        ctx = {n: F.array_join(F.slice("ls", F.greatest(F.lit(1), i + 1 - a), F.least(i + 1, F.lit(a + 1)) + b), "\n") for n, (a, b) in CONTEXTS.items() if n in contexts}
        if "ctx11" in contexts:
            ctx["ctx11"] = F.concat_ws(" ", *[F.coalesce(F.get("ss", i + k), F.lit("")) for k in (-1, 0, 1)])
        return F.struct((i + 1).cast("long").alias("line"), raw.alias("raw"), F.get("ss", i).alias("s"), *[F.when(F.expr(contexts[n]), c).alias(n) for n, c in ctx.items()])

    return line


class Corpus:
    def __init__(self, spark: SparkSession, files: DataFrame, repo_meta: DataFrame | None = None, advisories: DataFrame | None = None, lookup: Lookup = Lookup()):
        self.spark = spark
        if "content" in files.columns:
            files = with_text(files)
        if "text_lossy" not in files.columns:
            files = files.withColumn("text_lossy", F.col("text"))
        if "mode" not in files.columns:
            files = files.withColumn("mode", F.lit(None).cast("int"))
        name = F.substring_index("path", "/", -1)
        fold = lambda c: F.when(c.contains("\r"), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)
        self.files = files.select("path", name.alias("name"), "mode", fold(F.col("text")).alias("text"), fold(F.col("text_lossy")).alias("text_lossy")).select(
            "path", F.lower("path").alias("lpath"), "name", F.lower("name").alias("lname"), suffix_of(F.col("name")).alias("suffix"), "mode", "text", "text_lossy"
        )
        self.repo_meta = repo_meta
        self.advisories, self.lookup = advisories, lookup

    @cached_property
    def lines(self) -> DataFrame:
        """One row for each line of the files that are valid UTF-8."""
        return self._lines("text")

    @cached_property
    def lossy_lines(self) -> DataFrame:
        return self._lines("text_lossy")

    def bare_lines(self, where, lossy: bool = False) -> DataFrame:
        """(path, name, line, raw, s) of the files where a condition holds, without contexts."""
        column = "text_lossy" if lossy else "text"
        files = self.files.where(F.col(column).isNotNull()).where(where).select("path", "name", split_lines(column).alias("ls"))
        return files.select("path", "name", F.posexplode("ls").alias("i", "raw")).select("path", "name", (F.col("i") + 1).cast("long").alias("line"), "raw", F.btrim("raw", F.lit(SPACE)).alias("s"))

    def _lines(self, column: str) -> DataFrame:
        base = self.files.where(F.col(column).isNotNull()).withColumn("ls", split_lines(column)).withColumn("ss", strip_lines("ls"))
        files = ["path", "lpath", "name", "lname", "suffix", "text", "text_lossy"]
        # each line is a struct with its contexts before lines are told apart, so no row carries the file's array of lines
        rows = base.withColumn("x", F.transform("ls", line_struct(dict.fromkeys((*CONTEXTS, "ctx11"), "true")))).select(*files, F.explode_outer("x").alias("x")).where("x is not null")
        return rows.select(*files, "x.*")

"""Aggregates, sorts and top-k over findings, and the Markdown and table sinks.

Ties are broken by the key, ascending.
"""

from __future__ import annotations

import glob
import os
import shutil
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
SUMMARY_ROWS = 10
PRIORITY_ROWS = 20
NO_PLACE = "(no place)"


def rank(severity="severity"):
    out = F.when(F.lit(False), 0)
    for i, s in enumerate(SEVERITIES):
        out = out.when(F.col(severity) == s, i)
    return out.otherwise(99)


def ordering():
    return [rank(), F.col("rule_id"), F.coalesce("file_path", F.lit("")), F.coalesce("line", F.lit(0))]


def bucket():
    """The first two segments of the path."""
    return F.when(F.coalesce("file_path", F.lit("")) == "", NO_PLACE).otherwise(F.substring_index(F.replace("file_path", F.lit("\\"), F.lit("/")), "/", 2))


def totals(f: DataFrame) -> DataFrame:
    return f.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("Critical", "High")).alias("n_priority"))


def by_severity(f: DataFrame) -> DataFrame:
    """All five severities, zero counts kept."""
    dim = f.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    return F.broadcast(dim).join(f.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank")


def by_category(f: DataFrame) -> DataFrame:
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(SUMMARY_ROWS)


def by_rule(f: DataFrame) -> DataFrame:
    return f.groupBy("rule_id", "title", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id", "title", "severity").limit(SUMMARY_ROWS)


def by_directory(f: DataFrame) -> DataFrame:
    return f.groupBy(bucket().alias("directory")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "directory").limit(SUMMARY_ROWS)


def priority(f: DataFrame) -> DataFrame:
    """The first Critical and High findings in report order."""
    return f.where(F.col("severity").isin("Critical", "High")).orderBy(*ordering()).limit(PRIORITY_ROWS).select("rule_id", "severity", "file_path", "line")


def groups(f: DataFrame) -> DataFrame:
    """Severity, then rule: the size of each group and its first place."""
    return f.groupBy("severity", "rule_id", "title", "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("file_path", F.lit(""))).alias("first_path"))


_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Info' THEN 4 ELSE 99 END"
SQL = {
    "report_totals": "SELECT count(*) AS n, count(*) FILTER (WHERE severity IN ('Critical', 'High')) AS n_priority FROM findings",
    "report_by_severity": "SELECT d.severity, CAST(d.rank AS INTEGER) AS rank, count(f.severity) AS n FROM (VALUES ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3), ('Info', 4)) d(severity, rank) LEFT JOIN findings f ON f.severity = d.severity GROUP BY 1, 2 ORDER BY 2",
    "report_by_category": "SELECT category, count(*) AS n FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "report_by_rule": "SELECT rule_id, title, severity, count(*) AS n FROM findings GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10",
    "report_by_directory": f"SELECT CASE WHEN coalesce(file_path, '') = '' THEN '{NO_PLACE}' ELSE array_to_string(string_split(file_path, '/')[1:2], '/') END AS directory, count(*) AS n FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "report_priority": f"SELECT rule_id, severity, file_path, line FROM findings WHERE severity IN ('Critical', 'High') ORDER BY {_RANK}, rule_id, coalesce(file_path, ''), coalesce(line, 0) LIMIT 20",
    "report_groups": "SELECT severity, rule_id, title, category, count(*) AS n, min(coalesce(file_path, '')) AS first_path FROM findings GROUP BY 1, 2, 3, 4",
}


def _cell(v) -> str:
    text = "" if v is None else str(v)
    return text.replace("\r\n", "\n").replace("\n", "<br>").replace("|", "\\|") or "-"


def _table(head: list[str], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(_cell(v) for v in r) + " |" for r in rows), ""]


def head(f: DataFrame, errors: list[tuple[str, str]], target: str, now: datetime) -> list[str]:
    """The report's lines before the details: aggregates and the first of the priority list, all of bounded size."""
    n, n_priority = totals(f).first()
    out = ["# Security risk report", "", "## 1. Run", "", f"- **Target:** `{target}`", f"- **Generated (UTC):** {now:%Y-%m-%d %H:%M:%S}", f"- **Findings:** {n}", f"- **Rule errors:** {len(errors)}", f"- **Critical and High:** {n_priority}", "", "## 2. Summary", ""]
    out += _table(["Severity", "Findings"], [(r["severity"], r["n"]) for r in by_severity(f).collect() if r["n"]])
    out += _table(["Category", "Findings"], [tuple(r) for r in by_category(f).collect()])
    out += _table(["Rule", "Title", "Severity", "Findings"], [tuple(r) for r in by_rule(f).collect()])
    out += _table(["Directory", "Findings"], [tuple(r) for r in by_directory(f).collect()])
    out += ["## 3. Priority", ""]
    first = priority(f).collect()
    out += _table(["Rule", "Severity", "Path", "Line"], [tuple(r) for r in first])
    if n_priority > len(first):
        out += [f"{n_priority - len(first)} more Critical and High findings follow below.", ""]
    return [*out, "## 4. Details", ""]


def tail(errors: list[tuple[str, str]]) -> list[str]:
    return ["", "## 5. Errors", "", *(f"- {k}: {e.splitlines()[0] if e else ''}" for k, e in errors)]


def details(f: DataFrame) -> DataFrame:
    """(value): the lines of the details in report order, each group (severity, rule) after its heading. A range sort, so no task has a whole group."""
    keys = ordering()
    line = F.concat(F.lit("- `"), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("-")), F.lit("`"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(" "), F.coalesce("message", F.lit("")))
    rows = f.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.lit(1).alias("body"), F.rtrim(line).alias("value"))
    title = F.concat(F.lit("### "), F.col("severity"), F.lit(": "), F.col("rule_id"), F.lit(" "), F.min_by("title", F.struct("title", "category")), F.lit(" ("), F.min_by("category", F.struct("title", "category")), F.lit(")\n"))
    heads = f.groupBy("severity", "rule_id").agg(title.alias("value"))
    heads = heads.select(rank().alias("k0"), F.col("rule_id").alias("k1"), F.lit("").alias("k2"), F.lit(0).cast(rows.schema["k3"].dataType).alias("k3"), F.lit(0).alias("body"), "value")
    return rows.union(heads).orderBy("k0", "k1", "body", "k2", "k3", "value").select("value")


def lines(f: DataFrame, errors: list[tuple[str, str]], target: str, now: datetime) -> Iterator[str]:
    """The report line by line; details come a partition at a time."""
    yield from head(f, errors, target, now)
    yield from (r["value"] for r in details(f).toLocalIterator())
    yield from tail(errors)


def markdown(f: DataFrame, errors: list[tuple[str, str]], target: str, now: datetime) -> str:
    """The report as one text."""
    return "\n".join(lines(f, errors, target, now)) + "\n"


def write_markdown(f: DataFrame, errors: list[tuple[str, str]], target: str, now: datetime, folder: str) -> None:
    """The report as text parts in a folder that executors can write to; put together by name they are the report.

    Executors sort and write the details; the driver writes what comes before and after, and holds no findings.
    """
    spark = f.sparkSession
    for name, part in (("1-head", head(f, errors, target, now)), ("3-errors", tail(errors))):
        spark.createDataFrame([("\n".join(part),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    details(f).write.text(f"{folder}/2-details")


def join_parts(folder: str, to: str) -> None:
    """Copy a report's parts, which lie in a local folder, into one file."""
    with open(to, "wb") as out:
        for part in sorted(glob.glob(os.path.join(glob.escape(folder), "*", "part-*"))):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)

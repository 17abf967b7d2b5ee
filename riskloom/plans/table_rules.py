"""Rules over the tables that the pass over the files leaves: facts, dependencies, licences, imports, metadata.

Each function gives a DataFrame (rule_id, severity, file_path, line, message) of some rules;
a message may be null. Rules over one table are judged in one select.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dialect import SPARK
from riskloom.operators import relational_rules as R
from riskloom.operators import rule_values as V
from riskloom.operators.file_rules import CORPUS_RULES, PENDING, known
from riskloom.plans.file_pass import Facts

COLUMNS = ("rule_id", "severity", "file_path", "line", "message")


def _shaped(df: DataFrame, rule: str | None = None) -> DataFrame:
    have = set(df.columns)
    message = F.col("message") if "message" in have else F.lit(None).cast("string")
    return df.select(F.lit(rule).alias("rule_id") if rule else "rule_id", "severity", F.col("file_path").cast("string").alias("file_path"), F.col("line").cast("long").alias("line"), message.alias("message"))


def _several(df: DataFrame, items: list[str]) -> DataFrame:
    """The structs that items give for each row, nulls left out."""
    return df.select(F.explode(F.expr(f"filter(array({', '.join(items)}), v -> v.severity IS NOT NULL)")).alias("v")).select("v.*")


def files(f: Facts) -> DataFrame:
    """What the pass itself has found; a pending severity is settled by the corpus' facts."""
    severity = F.col("severity")
    if "G-7" in f.rules:
        boxed = f.bits.select(F.expr(known("sandbox"))).scalar()
        severity = F.when(severity == PENDING, F.when(boxed, "Medium").otherwise("High")).otherwise(severity)
    return _shaped(f.found.withColumn("severity", severity))


def corpus(f: Facts, rules: frozenset[str]) -> DataFrame:
    row = f.bits
    tagged = f.repo_meta.agg(F.coalesce(F.bool_or(F.col("last_tag_ts") > 0), F.lit(False))).scalar() if "J-5" in rules else F.lit(False)
    licences = f.project_licenses.agg(F.count(F.lit(1))).scalar() if "K-1" in rules else F.lit(0)
    row = row.select("bits", tagged.alias("tagged"), licences.alias("licences"))
    return _shaped(_several(row, [x for k, x in CORPUS_RULES if k in rules]))


def metadata(f: Facts, rules: frozenset[str]) -> DataFrame:
    def row(rule: str, severity: str, path: str, line: str) -> str:
        return f"named_struct('rule_id', '{rule}', 'severity', {severity}, 'file_path', CAST({path} AS STRING), 'line', CAST({line} AS BIGINT))"

    def aged(column: str) -> str:
        age = f"floor((now_ts - {column}) / 86400)"
        return f"CASE WHEN {age} >= 365 THEN 'High' WHEN {age} >= 180 THEN 'Medium' END"

    items = {
        "J-1": row("J-1", aged("last_commit_ts"), "'.git'", "1"),
        "J-4": row("J-4", "CASE author_count WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' END", "'.git'", "1"),
        "J-5": row("J-5", f"CASE WHEN last_tag_ts > 0 THEN {aged('last_tag_ts')} END", "'.git/tags'", "1"),
        "J-6": row("J-6", "CASE WHEN archived THEN 'High' END", "NULL", "NULL"),
    }
    return _shaped(_several(f.repo_meta, [x for k, x in items.items() if k in rules]))


def dependencies(f: Facts, rules: frozenset[str]) -> DataFrame:
    """Rules that a dependency is judged by alone."""

    def row(rule: str, severity: str) -> str:
        return f"named_struct('rule_id', '{rule}', 'severity', {severity}, 'file_path', file_path, 'line', line, 'message', {R.MESSAGES[rule]})"

    items = {
        "B-1": row("B-1", f"CASE WHEN NOT {R.pinned(SPARK)} THEN 'Medium' END"),
        "B-2": row("B-2", f"CASE WHEN {R.loose(SPARK)} THEN 'Medium' END"),
        "B-3": row("B-3", f"CASE WHEN {R.suspicious(SPARK)} THEN 'Medium' END"),
        "B-4": row("B-4", R.deprecation(SPARK)),
    }
    return _shaped(_several(f.deps, [x for k, x in items.items() if k in rules]))


def advised(f: Facts) -> DataFrame:
    known_ones = f.advisories.select(F.col("ecosystem").alias("e"), F.col("name").alias("n"), F.col("version").alias("v"), "severity_score", "source", "vuln_id", "summary", "refs")
    pinned = f.deps.where(R.pinned(SPARK)).withColumn("own", F.expr(R.advisory_version(SPARK)))
    met = pinned.join(known_ones, (F.col("e") == F.col("ecosystem")) & (F.col("n") == F.col("name")) & (F.col("v") == F.col("own")))
    return _shaped(met.select(F.expr(R.SCORE).alias("severity"), "file_path", "line", F.expr(R.advisory_message(SPARK, "array_join")).alias("message")), "B-1")


def unused(f: Facts) -> DataFrame:
    used = f.imports.select(F.col("ecosystem").alias("e"), F.col("name").alias("n"))
    deps = f.deps.withColumn("expected", F.expr(R.import_name(SPARK)))
    left = deps.join(used, (F.col("e") == F.col("ecosystem")) & (F.col("n") == F.col("expected")), "left_anti")
    return _shaped(left.select(F.lit("Low").alias("severity"), "file_path", "line", F.expr(R.MESSAGES["B-6"]).alias("message")), "B-6")


def unlicensed(f: Facts) -> DataFrame:
    first = f.dep_licenses.groupBy("package").agg(F.min_by("license_expr", "ord").alias("lic"))
    joined = f.deps.join(first, F.col("package") == F.col("name"), "left").where(SPARK.among("coalesce(lower(trim(lic)), '')", V.UNKNOWN_LICENSES))
    return _shaped(joined.select(F.lit("Medium").alias("severity"), "file_path", "line", F.expr(R.MESSAGES["K-4"]).alias("message")), "K-4")


def noncommercial(f: Facts) -> DataFrame:
    rows = f.dep_licenses.where(SPARK.has("lower(license_expr)", *V.NONCOMMERCIAL))
    return _shaped(rows.select(F.lit("High").alias("severity"), "file_path", "line", F.expr(R.MESSAGES["K-5"]).alias("message")), "K-5")


def vague(f: Facts) -> DataFrame:
    rows = f.project_licenses.where(SPARK.has("lower(license_expr)", *V.VAGUE_LICENSES))
    return _shaped(rows.select(F.lit("Low").alias("severity"), "file_path", F.lit(None).cast("long").alias("line")), "K-1")


def _tokens() -> str:
    return f"transform({SPARK.all('license_expr', V.LICENSE_TOKEN)}, t -> upper(t))"


def conflicts(f: Facts) -> DataFrame:
    """One row of whether each licence is among the dependencies', put together map-side."""
    one = f.dep_licenses.select(F.expr(_tokens()).alias("tokens"))
    have = one.agg(*[F.coalesce(F.bool_or(F.array_contains("tokens", n)), F.lit(False)).alias(c) for c, n in (("gpl", "GPL-2.0"), ("only", "GPL-2.0-ONLY"), ("apache", "APACHE-2.0"))])
    items = [f"named_struct('rule_id', 'K-2', 'severity', CASE WHEN {c} AND apache THEN 'Medium' END, 'file_path', CAST(NULL AS STRING), 'line', CAST(NULL AS BIGINT))" for c in ("gpl", "only")]
    return _shaped(_several(have, items))


def copyleft(f: Facts) -> DataFrame:
    """K-3 with its first examples: each task keeps no more of them than the message has."""
    strong = F.expr(f"array_sort(array_intersect({_tokens()}, array({', '.join(SPARK.lit(x) for x in V.STRONG_COPYLEFT)})))")
    first = f.dep_licenses.withColumn("strong", strong).where(F.size("strong") > 0).orderBy("ord", "package").limit(R.EXAMPLES)
    example = F.struct("ord", "package", F.concat("package", F.lit(": "), F.array_join("strong", ", ")).alias("text"))
    row = first.agg(F.array_sort(F.collect_list(example)).alias("x")).where(F.size("x") > 0)
    closed = f.bits.select(F.expr(known("closed"))).scalar()
    text = F.concat(F.lit("strong copyleft among the dependencies ("), F.array_join(F.transform("x", lambda e: e["text"]), "; "), F.lit(")"))
    nowhere = F.lit(None)
    return _shaped(row.select(F.when(closed, "High").otherwise("Medium").alias("severity"), nowhere.alias("file_path"), nowhere.alias("line"), text.alias("message")), "K-3")


_CORPUS = frozenset(k for k, _ in CORPUS_RULES)
_METADATA = frozenset({"J-1", "J-4", "J-5", "J-6"})
_DEPENDENCIES = frozenset({"B-1", "B-2", "B-3", "B-4"})
_OTHERS: list[tuple[str, Callable[[Facts], DataFrame]]] = [
    ("B-1", advised), ("B-6", unused), ("K-1", vague), ("K-2", conflicts), ("K-3", copyleft), ("K-4", unlicensed), ("K-5", noncommercial),
]


def tables(f: Facts, rules: frozenset[str]) -> Iterator[DataFrame]:
    """What the rules find that need more than one file."""
    for group, build in ((_CORPUS, corpus), (_METADATA, metadata), (_DEPENDENCIES, dependencies)):
        if rules & group:
            yield build(f, rules & group)
    yield from (build(f) for k, build in _OTHERS if k in rules)

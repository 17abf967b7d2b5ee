"""The registered queries over the derived tree, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.dialect import DUCK
from riskloom.operators import report, taint
from riskloom.operators.line_rules import LINE_RULES, line_sql
from riskloom.operators.relational_rules import RELATIONAL_RULES
from riskloom.plans import engine, taint_relation
from riskloom.sources.derived import derived_corpus, duck_prefix

KEY = ["rule_id", "category", "title", "severity", "file_path", "line"]
#: Rules whose messages are part of their query.
TOLD = ("B-1", "B-2", "B-3", "B-4", "B-6", "K-3", "K-4", "K-5")


def _name(rule_id: str) -> str:
    return "rule_" + rule_id.replace("-", "").lower()


def _rule(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine.rule_findings(derived_corpus(spark, sf_dir), rule_id).select(*KEY, *(["message"] if rule_id in TOLD else []))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.line_findings(derived_corpus(spark, sf_dir)).select(*KEY)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.all_findings(derived_corpus(spark, sf_dir)).select(*KEY)


def _report(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_all(spark, sf_dir))


REPORTS = {
    "report_totals": report.totals,
    "report_by_severity": report.by_severity,
    "report_by_category": report.by_category,
    "report_by_rule": report.by_rule,
    "report_by_directory": report.by_directory,
    "report_priority": report.priority,
    "report_groups": report.groups,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {_name(k): _rule(k) for k in engine.RULES}
    out["line_rules_fused"] = _fused
    out["all_findings"] = _all
    out["taint_relation"] = lambda spark, sf_dir: taint_relation.tainted(derived_corpus(spark, sf_dir))
    return out | {k: _report(f) for k, f in REPORTS.items()}


def _labelled(rule_id: str, sql: str, message: bool = False) -> str:
    category, title = engine.RULES[rule_id]
    return f"SELECT '{rule_id}' AS rule_id, '{category}' AS category, '{title}' AS title, severity, file_path, CAST(line AS BIGINT) AS line{', message' if message else ''} FROM ({sql}) r"


def _parts(rule_id: str, message: bool = False) -> list[str]:
    out = [_labelled(rule_id, line_sql(LINE_RULES[rule_id], DUCK, "lines"))] if rule_id in LINE_RULES else []
    if rule_id in taint.RULES:
        out.append(_labelled(rule_id, f"SELECT severity, file_path, line FROM expected WHERE rule_id = '{rule_id}'"))
    return out + [_labelled(rule_id, r.sql(DUCK).replace("AS STRING)", "AS VARCHAR)"), message) for r in RELATIONAL_RULES.values() if r.rule_id == rule_id]


def oracle_sql() -> dict[str, str]:
    """SQL of every query; rules that need syntax trees are held against what their snippets must give (derived.EXPECTED)."""
    prefix = duck_prefix()
    out = {_name(k): prefix + " UNION ALL ".join(_parts(k, k in TOLD)) for k in engine.RULES}

    def over(rows: list[str]) -> str:
        return prefix.rstrip() + ", findings AS (" + " UNION ALL ".join(rows) + ")\n"

    out["line_rules_fused"] = over([_labelled(k, line_sql(r, DUCK, "lines")) for k, r in LINE_RULES.items()]) + "SELECT * FROM findings"
    out["taint_relation"] = prefix + "SELECT file_path, scope, name, round FROM reached"
    whole = over([p for k in engine.RULES for p in _parts(k)])
    return out | {"all_findings": whole + "SELECT * FROM findings"} | {k: whole + report.SQL[k] for k in REPORTS}

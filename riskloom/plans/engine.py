"""The rule registry and the plans that run it.

``all_findings`` reads every file once (file_pass.scan) and writes what the pass leaves, which
the rules over tables select from. ``rule_findings`` is the same pass for one rule, and asks
of the files only what that rule needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import taint
from riskloom.operators.line_rules import LINE_RULES
from riskloom.operators.relational_rules import RELATIONAL_RULES
from riskloom.plans import table_rules
from riskloom.plans.file_pass import Facts, scan
from riskloom.sources.corpus import Corpus

COLUMNS = ["rule_id", "category", "title", "severity", "file_path", "line", "message"]
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")

#: rule id -> (category, title), in the order rules run
RULES: dict[str, tuple[str, str]] = dict(
    sorted(({**{k: (r.category, r.title) for k, r in LINE_RULES.items()}, **{r.rule_id: (r.category, r.title) for r in RELATIONAL_RULES.values()}, **taint.RULES}).items())
)
#: Rules added by users: rule id -> function of a corpus giving (severity, file_path, line[, message]).
EXTRA: dict[str, tuple[str, str, Callable[[Corpus], DataFrame]]] = {}


def register(rule_id: str, category: str, title: str, build: Callable[[Corpus], DataFrame]) -> None:
    """Add a rule; a rule id that exists already is replaced."""
    EXTRA[rule_id] = (category, title, build)


def _message(title) -> F:
    return F.concat(title, F.lit(" may need attention"))


def _finish(df: DataFrame, rule_id: str) -> DataFrame:
    category, title = EXTRA[rule_id][:2]
    message = F.col("message") if "message" in df.columns else _message(F.lit(title))
    return df.select(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), F.lit(title).alias("title"), "severity", F.col("file_path").cast("string"), F.col("line").cast("long"), message.alias("message"))


def _titled(df: DataFrame) -> DataFrame:
    """Findings of built-in rules with category, title and, where they have none, a message."""
    category, title = (F.create_map(*[F.lit(v) for k in RULES for v in (k, RULES[k][i])])[F.col("rule_id")] for i in (0, 1))
    return df.select("rule_id", category.alias("category"), title.alias("title"), "severity", "file_path", "line", F.coalesce("message", _message(title)).alias("message"))


def findings(f: Facts) -> DataFrame:
    """What the rules of f find."""
    parts = [table_rules.files(f), *table_rules.tables(f, f.rules)]
    return _titled(reduce(DataFrame.unionByName, parts))


def rule_findings(c: Corpus, rule_id: str) -> DataFrame:
    """All findings of one rule, with COLUMNS."""
    if rule_id in EXTRA:
        return _finish(EXTRA[rule_id][2](c), rule_id)
    return findings(Facts(c, frozenset([rule_id])))


def line_findings(c: Corpus) -> DataFrame:
    """Findings of all line rules in one pass over the lines."""
    return _titled(scan(c, frozenset(LINE_RULES), lines_only=True).drop("fact"))


def all_findings(c: Corpus, facts: Facts | None = None) -> DataFrame:
    """Findings of every rule; the pass over the files is run at once. What it writes goes with ``facts.release()`` of the Facts given (see ``facts_of``)."""
    facts = facts or facts_of(c)
    return reduce(DataFrame.unionByName, [findings(facts), *(rule_findings(c, k) for k in EXTRA)])


def facts_of(c: Corpus) -> Facts:
    return Facts(c, frozenset(RULES), keep=True)


def run_rules(c: Corpus, rule_ids: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(findings, errors): all rules run together, once; if that fails each runs by itself, and a failing one becomes an error row (rule_id, error)."""
    if rule_ids is None:
        facts = None
        try:
            facts = facts_of(c)
            together = all_findings(c, facts).persist()
            together.count()  # a lazy plan fails only when it runs
            return together, []
        except Exception:  # noqa: BLE001, S110 - which rule it was is found out below
            if facts is not None:
                facts.release()
    done, errors = [], []
    for k in rule_ids or [*RULES, *EXTRA]:
        try:
            df = rule_findings(c, k).persist()
            df.count()
            done.append(df)
        except Exception as e:  # noqa: BLE001
            errors.append((k, f"{type(e).__name__}: {e}"))
    empty = c.spark.createDataFrame([], "rule_id string, category string, title string, severity string, file_path string, line long, message string")
    return reduce(DataFrame.unionByName, done, empty), errors


def spark_session(name: str = "riskloom", cores: str = "*") -> SparkSession:
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()

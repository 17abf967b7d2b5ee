"""One pass over the files, from which every rule takes what it needs.

``scan`` reads each file once. Its row is turned into (1) findings of the line rules, the
file rules and the taint rules, and (2) at most one row of facts: a bit set for the rules
about the corpus, the names it imports, and the text of a manifest. Lines are generated from
the file's row, so nothing is shuffled. What comes out holds no text but that of manifests and is
small beside the files; ``Facts`` writes it, where several rules are run, to the shared folder
for the tables that are derived from it (see table_rules).
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.dialect import GATED, SPARK, Known
from riskloom.functions.literals import needed
from riskloom.operators import taint
from riskloom.operators.file_rules import FACTS_OF, FILE_RULES, LINE_PARTS, SOUGHT, FileRule, fact_bits
from riskloom.operators.line_rules import LINE_RULES, SKIPS, LineRule
from riskloom.sources import advisories, manifests
from riskloom.sources.corpus import CONTEXTS, LINE_END, Corpus, line_struct, split_lines, strip_lines

CONTEXT_NAMES = (*CONTEXTS, "ctx11")
#: rules that are judged by dependencies, licences or imports
MANIFEST_RULES = frozenset({"B-1", "B-2", "B-3", "B-4", "B-6", "K-1", "K-2", "K-3", "K-4", "K-5"})
FIND = "struct<severity: string, line: bigint, message: string>"
HIT = "struct<rule_id: string, severity: string, line: bigint, message: string>"
FACT = "struct<bits: bigint, imports: array<string>, text: string, text_lossy: string>"
META = "last_commit_ts long, author_count int, last_tag_ts long, archived boolean, now_ts long"
#: So many rules' literals are looked for one by one; those of more rules are looked for together, outside the JVM.
FEW_RULES = 8
#: What an analyst of manifests asks of code: python module or node package, with the ecosystem before it.
SEPARATOR = ":"


def may_find(rule: LineRule) -> str:
    """Whether a line rule may find anything in a file: its name fits and its text holds a literal that the rule's test needs."""
    literals = rule.literals()
    held = f" AND {SPARK.has('ltext', *sorted(literals))}" if literals else ""
    return f"({rule.files(SPARK)}){held}"


def held(literals: list[frozenset[str]]):
    """Function of (lower-case text, asked) columns: of the sets of literals asked (a bit each) those of which the text holds one.

    A set is one RE2 pattern, so its literals are looked for in one pass over the text, however many they are.
    """
    patterns = [(1 << i, "|".join(re.escape(x) for x in sorted(one))) for i, one in enumerate(literals)]

    @F.arrow_udf("bigint")
    def run(text: pa.Array, asked: pa.Array) -> pa.Array:
        wanted = asked.to_numpy(zero_copy_only=False)
        out = np.zeros(len(text), np.int64)
        for bit, pattern in patterns:
            at = np.flatnonzero(wanted & bit)
            if len(at):
                found = pc.match_substring_regex(text.take(pa.array(at)), pattern).to_numpy(zero_copy_only=False)
                out[at[found.astype(bool)]] |= bit
        return pa.array(out)

    return run


def _flag(key: str) -> str:
    return "in_" + key.replace("-", "").replace("/", "_").lower()


def line_rules(rules: frozenset[str]) -> dict[str, LineRule]:
    out = {k: r for k, r in LINE_RULES.items() if k in rules}
    return out | {f"{k}/line": r for k, r in LINE_PARTS.items() if k in rules}


def scan(c: Corpus, rules: frozenset[str], lines_only: bool = False) -> DataFrame:
    """(file_path, rule_id, severity, line, message, fact): findings, and rows with a fact and no rule_id.

    lines_only: of rules that are line rules and more, only what they find in lines.
    """
    if lines_only:
        lines, rules = {k: r for k, r in LINE_RULES.items() if k in rules}, frozenset()
    else:
        lines = line_rules(rules)
    files: list[FileRule] = [r for r in FILE_RULES if r.rule_id in rules]
    hits = sorted(rules & set(taint.RULES))
    facts = tuple(n for k in FACTS_OF if k in rules for n in FACTS_OF[k])
    manifest = manifests.MANIFEST if rules & MANIFEST_RULES else "false"
    imports = "B-6" in rules

    base = c.files
    code = F.lit(None).cast(f"struct<hits: array<{HIT}>, imports: array<string>>")
    if hits or imports:
        wanted = taint.wanted(hits, imports) & F.col("text").isNotNull()
        code = F.when(wanted, taint.judge(hits, imports)("name", "suffix", F.when(wanted, F.col("text"))))
    finds = {k: may_find(r) for k, r in lines.items()}
    base, apart = base.withColumn("ltext", F.lower("text")), {"code": code}
    sets = {k: (r.files, r.literals()) for k, r in lines.items() if r.literals()}
    whole = {p: (f, needed(p)) for k, (f, p) in SOUGHT.items() if k in rules}
    d = SPARK
    if FEW_RULES < len(sets) < 64 - len(whole):
        bit = {k: f"{1 << i}L" for i, k in enumerate([*sets, *whole])}
        asked = " + ".join(f"CASE WHEN {f(SPARK)} THEN {bit[k]} ELSE 0L END" for k, (f, _) in (sets | whole).items())
        base = base.withColumn("asked", F.expr(f"CASE WHEN text IS NULL THEN 0L ELSE {asked} END"))
        apart["held"] = F.coalesce(held([x for _, x in (sets | whole).values()])(F.when(F.col("asked") != 0, F.col("ltext")), F.col("asked")), F.lit(0))
        finds |= {k: f"(held & {bit[k]} <> 0)" for k in sets}
        d = Known({p: f"held & {bit[p]} <> 0" for p in whole})
    base = base.withColumns(apart)

    # what is judged once for each file: an outer explode of one struct, so that it isn't moved into conditions below or above
    tests = {_flag(k): e for k, e in finds.items()}
    flags = {name: f"{finds[k]} AND ({f(SPARK)})" for k, r in lines.items() for name, f in r.flags.items()}
    asked = {_flag(f"{r.rule_id}/file"): r.may(d) for r in files}
    judged = [F.expr(f"coalesce({e}, false)").alias(n) for n, e in (tests | flags | asked | {"manifest": manifest}).items()]
    judged.append(F.expr(fact_bits(facts, d)).alias("bits"))
    names = ["path", "lpath", "name", "lname", "suffix", "mode", "text", "text_lossy", "code"]
    base = base.select(*names, F.explode_outer(F.array(F.struct(*judged))).alias("f")).select(*names, "f.*")

    any_of = lambda cols: " OR ".join(cols) if cols else "false"
    read = any_of([*tests, *(_flag(f"{r.rule_id}/file") for r in files if r.lines)])
    told = any_of(["bits <> 0", "manifest", "code IS NOT NULL", *asked, *(["true"] if imports else [])])
    base = base.where(any_of([*tests, told]))
    none = F.array().cast("array<string>")
    base = base.withColumn("ls", F.when(F.expr(read) & F.col("text").isNotNull(), split_lines("text")).otherwise(none)).withColumn("ss", strip_lines("ls"))

    # the file's own row: findings of file rules and taint rules, and its fact
    found = [f"CASE WHEN {_flag(r.rule_id + '/file')} THEN transform({r.finds(SPARK)}, v -> named_struct('rule_id', '{r.rule_id}', 'severity', v.severity, 'line', v.line, 'message', v.message)) END" for r in files]
    base = base.withColumns({"lossy_end": F.lit(f"(?:{LINE_END})\\z"), "line_end": F.lit(LINE_END)}) if any(r.rule_id == "H-6" for r in files) else base
    empty = F.array().cast(f"array<{HIT}>")
    own = F.concat(*[F.coalesce(F.expr(x), empty) for x in found], F.coalesce("code.hits", empty))
    js = F.transform(manifests.js_imports(), lambda n: F.concat(F.lit(f"node{SEPARATOR}"), n)) if imports else none
    python = F.transform(F.coalesce("code.imports", none), lambda n: F.concat(F.lit(f"python{SEPARATOR}"), n))
    text, lossy = F.when(F.col("manifest"), F.col("text")), F.when(F.col("manifest") & F.col("text").isNull(), F.col("text_lossy"))
    fact = F.struct(F.col("bits").cast("long").alias("bits"), F.concat(js, python).alias("imports"), text.alias("text"), lossy.alias("text_lossy"))
    users = {n: [_flag(k) for k, r in lines.items() if any(n in row for row in r.rows(SPARK))] for n in CONTEXT_NAMES}
    contexts = {n: any_of(u) for n, u in users.items() if u}
    blank = F.lit(None).cast("string")
    nothing = F.lit(None).cast(f"struct<own: array<{HIT}>, fact: {FACT}>")
    one = F.struct(F.lit(0).cast("long").alias("line"), blank.alias("raw"), blank.alias("s"), blank.alias("low"), *[blank.alias(n) for n in contexts], F.struct(own.alias("own"), fact.alias("fact")).alias("whole"))
    items = F.when(F.expr(told), F.array(one)).otherwise(F.array())
    if lines:
        each = line_struct(contexts)
        each = F.when(F.expr(any_of(list(tests))), F.transform("ls", lambda raw, i: each_with(each(raw, i), contexts, nothing)))
        items = F.concat(items, F.coalesce(each, F.array()))
    rows = base.select("path", "lpath", "name", "lname", "suffix", *tests, *flags, F.explode(items).alias("x")).select("path", "lpath", "name", "lname", "suffix", *tests, *flags, "x.*")

    # what each row gives: items of one shape
    kept = f"array(named_struct('rule_id', CAST(NULL AS STRING), 'severity', CAST(NULL AS STRING), 'line', 0L, 'message', CAST(NULL AS STRING), 'fact', whole.fact))"
    given = f"transform(whole.own, h -> named_struct('rule_id', h.rule_id, 'severity', h.severity, 'line', h.line, 'message', h.message, 'fact', CAST(NULL AS {FACT})))"
    holds = "whole.fact.bits <> 0 OR size(whole.fact.imports) > 0 OR whole.fact.text IS NOT NULL OR whole.fact.text_lossy IS NOT NULL"
    result = f"CASE WHEN whole IS NOT NULL THEN concat({given}, CASE WHEN {holds} THEN {kept} ELSE array() END)"
    if lines:
        result += f" ELSE transform({_line_items(lines)}, v -> named_struct('rule_id', v.rule_id, 'severity', v.severity, 'line', line, 'message', CAST(NULL AS STRING), 'fact', CAST(NULL AS {FACT})))"
    return rows.select(F.col("path").alias("file_path"), F.explode(F.expr(result + " END")).alias("v")).select("file_path", "v.*")


def each_with(line, contexts, nothing):
    """A line's struct with its lower-case text, and an empty place for what only the file's own row has."""
    return F.struct(*[line[n].alias(n) for n in ("line", "raw", "s")], F.lower(line["raw"]).alias("low"), *[line[n].alias(n) for n in contexts], nothing.alias("whole"))


def _line_items(lines: dict[str, LineRule]) -> str:
    """The array of (rule_id, severity) that a line gives."""
    groups: dict[str, list[str]] = {}
    for k, r in lines.items():
        for row in r.rows(GATED):
            if r.times:
                item = f"transform({r.times(SPARK)}, x -> named_struct('rule_id', '{r.rule_id}', 'severity', {row.replace('m RLIKE', 'x RLIKE')}))"
            else:
                item = f"array(named_struct('rule_id', '{r.rule_id}', 'severity', {row}))"
            groups.setdefault(r.skip, []).append(f"CASE WHEN {_flag(k)} THEN {item} ELSE array() END")
    arrays = [f"CASE WHEN {SKIPS[skip]} THEN flatten(array({', '.join(items)})) ELSE array() END" for skip, items in groups.items()]
    return f"filter(concat({', '.join(arrays)}), v -> v.severity IS NOT NULL)"


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="riskloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where driver and executors are one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not given and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return given or _own_folder()


class Facts:
    """The scan of a corpus for some rules, and the tables derived from it.

    keep: the scan and the tables are written once to the shared folder (so plans over them are
    short, and lost executors lose nothing), until ``release``; otherwise all is lazy.
    """

    def __init__(self, c: Corpus, rules: frozenset[str], keep: bool = False):
        self.c, self.rules, self.keep = c, rules, keep
        self.kept: list[str] = []
        self.rows = self._held(scan(c, rules))

    def _held(self, df: DataFrame) -> DataFrame:
        if not self.keep:
            return df
        self.kept.append(f"{shared_folder(self.c.spark)}/facts-{uuid.uuid4().hex}")
        df.write.parquet(self.kept[-1])
        return self.c.spark.read.schema(df.schema).parquet(self.kept[-1])

    def release(self) -> None:
        """Delete what has been written; nothing that was derived from it can be read any more."""
        for path in self.kept:
            where = self.c.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.c.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.kept.clear()

    @cached_property
    def found(self) -> DataFrame:
        return self.rows.where("rule_id IS NOT NULL").drop("fact")

    @cached_property
    def bits(self) -> DataFrame:
        """One row: the facts of all files."""
        return self.rows.where("rule_id IS NULL").agg(F.coalesce(F.bit_or("fact.bits"), F.lit(0)).cast("long").alias("bits"))

    @cached_property
    def manifests(self) -> Corpus:
        rows = self.rows.where("rule_id IS NULL AND (fact.text IS NOT NULL OR fact.text_lossy IS NOT NULL)")
        return Corpus(self.c.spark, rows.select(F.col("file_path").alias("path"), "fact.text", F.coalesce("fact.text", "fact.text_lossy").alias("text_lossy")))

    @cached_property
    def deps(self) -> DataFrame:
        return self._held(manifests.deps(self.manifests))

    @cached_property
    def dep_licenses(self) -> DataFrame:
        return self._held(manifests.dep_licenses(self.manifests))

    @cached_property
    def project_licenses(self) -> DataFrame:
        return self._held(manifests.project_licenses(self.manifests))

    @cached_property
    def imports(self) -> DataFrame:
        """(ecosystem, name), distinct."""
        names = self.rows.where("rule_id IS NULL").select(F.explode("fact.imports").alias("n")).distinct()
        return names.select(F.substring_index("n", SEPARATOR, 1).alias("ecosystem"), F.expr(f"substr(n, instr(n, '{SEPARATOR}') + 1)").alias("name"))

    @cached_property
    def repo_meta(self) -> DataFrame:
        return self._held(self.c.repo_meta) if self.c.repo_meta is not None else self.c.spark.createDataFrame([], META)

    @cached_property
    def advisories(self) -> DataFrame:
        given = self.c.advisories if self.c.advisories is not None else self.c.spark.createDataFrame([], advisories.SCHEMA)
        return advisories.ranked(given, self.c.lookup)

"""What keeps the pass over the files cheap gives what the plain way gives."""

import random
import re

from pyspark.sql import functions as F

from riskloom.functions.dialect import DUCK, GATED, SPARK
from riskloom.operators.line_rules import LINE_RULES
from riskloom.plans import engine, file_pass
from riskloom.sources import derived
from riskloom.sources.corpus import LINE_END, Corpus, split_lines

ENDS = ["\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_lines_split_as_by_the_whole_pattern(spark):
    draw = random.Random(5)
    texts = ["", "\n", "\r\n", "\n\n", "a", *("".join(draw.choice([*ENDS, "a", "é b", ""]) for _ in range(draw.randint(1, 9))) for _ in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = {r.i: r.ls for r in df.select("i", split_lines("t").alias("ls")).collect()}
    for i, t in enumerate(texts):
        want = re.split(LINE_END, re.sub(rf"(?:{LINE_END})\Z", "", t)) if t else []
        assert got[i] == want, repr(t)
    assert got[len(texts)] is None


def test_derived_text_is_folded_as_by_the_patterns(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choice([*ENDS, "a", "é", "\U0001f600", "\x7f", "\x80", "中"]) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for r in df.select("text", F.expr(derived._folded()).alias("out")).collect():
        assert r.out == re.sub(r"\r\n?|[\x0b\x0c\x1c-\x1e]", "\n", re.sub(r"[^\x00-\x7F]", "e", r.text or "")), repr(r.text)


def test_literals_of_many_rules_are_looked_for_together(spark):
    """The pass over many rules holds no containment test for each literal; it finds what each rule finds by itself."""
    snippets = [(p.replace("{id}", f"{i}x{j}"), x) for i, (p, xs) in enumerate(derived.TREE) for j, x in enumerate(xs)] + [("src/none.py", None), ("src/empty.py", "")]
    c = Corpus(spark, spark.createDataFrame(snippets, "path string, text string"))
    plan = file_pass.scan(c, frozenset(engine.RULES))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and text.count("Contains(ltext") < 20
    together = sorted(tuple(r) for r in engine.line_findings(c).select("rule_id", "severity", "file_path", "line").collect())
    alone = []
    for k in ("A-2", "C-1", "D-1", "E-4", "G-5", "H-1", "H-3", "L-1", "L-3"):
        one = sorted(tuple(r) for r in file_pass.scan(c, frozenset([k]), lines_only=True).select("rule_id", "severity", "file_path", "line").collect())
        assert one and one == [r for r in together if r[0] == k], k
        alone += one
    assert alone


def test_patterns_of_lines_come_behind_their_literals():
    assert "((contains(low, 'md5')) AND s RLIKE" in LINE_RULES["H-3"].rows(GATED)[0]
    assert "contains(low" not in LINE_RULES["H-3"].rows(SPARK)[0]


def test_distances_are_worked_out_for_names_of_like_length_only(spark):
    names = ["requets", "requests", "request", "requestss", "r", "x" * 5000, None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    test = SPARK.one_edit("name", "requests")
    assert [r[0] for r in df.select(F.expr(test)).collect()] == [True, False, True, True, False, False, None]
    assert "length(name)" in test and DUCK.one_edit("name", "requests") == "levenshtein(name, 'requests') = 1"

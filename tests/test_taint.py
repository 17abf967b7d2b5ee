"""Command injection and the other syntax-tree rules, without Spark."""

import pytest

from riskloom.operators import taint


def hits(name, text, rule="A-1"):
    suffix = "." + name.rsplit(".", 1)[-1]
    return [(s, line) for r, s, line, _ in taint.file_hits(name, suffix, text, set(taint.RULES)) if r == rule]


def test_value_passes_through_helpers():
    src = "import os\ndef a(x):\n    return 'ls ' + x\ndef b(y):\n    return a(y)\ndef main():\n    os.system(b(input()))\n"
    assert hits("x.py", src) == [("High", 7)]


@pytest.mark.parametrize("src", [
    "import subprocess\nd = {}\nd['t'] = input()\nsubprocess.run(d['t'], shell=True)\n",
    "import subprocess\nclass B: pass\nb = B()\nb.cmd = input()\nsubprocess.run(b.cmd, shell=True)\n",
])
def test_items_and_attributes(src):
    assert [s for s, _ in hits("x.py", src)] == ["High"]


@pytest.mark.parametrize("src", [
    "import os\ndef w(c):\n    os.system('ls')\nw(input())\n",
    "import os, re\nx = input()\nif not re.fullmatch('^[a-z]+$', x):\n    raise ValueError\nos.system('ls ' + x)\n",
    "import os\nx = input()\nif x not in {'a', 'b'}:\n    exit()\nos.system(x)\n",
    "import os\nx = input()\nf = lambda x: x\ndef g(x):\n    os.system('ls')\n",
])
def test_safe(src):
    assert hits("x.py", src) == []


def test_check_that_goes_on_does_not_sanitise():
    src = "import os, re\nx = input()\nif not re.fullmatch('^[a-z]+$', x):\n    print(x)\nos.system('ls ' + x)\n"
    assert hits("x.py", src) == [("High", 5)]


def test_wrapper():
    assert hits("x.py", "import os\ndef run(c):\n    os.system(c)\nrun(input())\n") == [("High", 4)]


@pytest.mark.parametrize("src,want", [
    ("const cp = require('child_process');\ncp.exec(req.query.c);", "High"),
    ("const {spawn: s} = require('node:child_process');\ns(req.query.c);", "High"),
    ("import {execFile} from 'child_process';\nexecFile(req.body.f);", "Medium"),
    ("shelljs.exec(req.body.f);", "High"),
    ("execa.command(req.body.f);", "High"),
    ("const {exec} = require('child_process');\nexec(quote(x));", None),
])
def test_javascript(src, want):
    assert [s for s, _ in hits("x.js", src)] == ([want] if want else [])


def test_spawn_with_shell_option():
    assert hits("x.js", "spawn(req.query.c, {shell: true});") == [("High", 1)]
    assert hits("x.js", "spawn(req.query.c, []);") == [("Medium", 1)]
    assert hits("x.js", "const o = {shell: true};\nspawn(req.query.c, o);") == [("High", 2)]


@pytest.mark.parametrize("src,want", [
    ("x=$(ls $1)", 1), ("read v\neval $v", 1), ("source $1/x", 1), (". $1/x", 0), ("v=$1\n$v --help", 1), ("bash <<< $1", 1), ("ls $1", 0), ("# eval $1", 0),
    ('read v\ncase "$v" in a|b) ;; *) exit 1;; esac\neval $v', 0), ("echo `cat $1` $(ls $1)", 2),
])
def test_shell(src, want):
    assert len(hits("x.sh", src)) == want


@pytest.mark.parametrize("rule,src,want", [
    ("A-2", "q = 'SELECT ' + input()\ncur.execute(q)\n", ["High"]),
    ("A-2", "cur.execute('SELECT %s', (input(),))\n", []),
    ("A-2", "cur.execute(input())\n", ["Medium"]),
    ("A-3", "import yaml\nyaml.load(x, Loader=yaml.SafeLoader)\n", []),
    ("A-3", "import yaml\nyaml.load(x, yaml.SafeLoader)\n", ["Medium"]),
    ("A-4", "import os\np = os.path.join('a', input())\nopen(p)\n", ["High"]),
    ("A-5", "import requests\nrequests.request('GET', input())\n", []),
    ("A-6", "from markupsafe import Markup\nMarkup(input())\n", ["High"]),
    ("A-8", "from flask import request\neval(request.args)\n", []),
    ("A-8", "eval(request.args)\n", ["High"]),
    ("A-8", "eval('1')\n", []),
    ("A-8", "﻿eval(input())\n", []),
])
def test_other_rules(rule, src, want):
    assert [s for s, _ in hits("x.py", src, rule)] == want


def test_flask_request_counts_for_commands():
    assert hits("x.py", "import os\nfrom flask import request\nos.system(request.args['c'])\n") == [("High", 3)]


def test_helpers():
    import ast

    assert taint.key_of(ast.parse("a.b['c'][i]", mode="eval").body) == "a.b['c'][]"
    assert hits("x.py", "import subprocess\ns = True\nt = s\nx = input()\nsubprocess.run(x, shell=t)\n") == [("High", 5)]
    assert hits("x.py", "import subprocess\ns = True\ns = False\nx = input()\nsubprocess.run(x, shell=s)\n") == [("Medium", 5)]


# ---------------------------------------------------------------- scripts as trees


def kinds(nodes, *wanted):
    return [(n.kind, n.line, n.name or n.text) for n in nodes if n.kind in wanted]


def test_javascript_nodes():
    from riskloom.operators.script_trees import js_nodes

    text = """// exec(a)
const q = "exec(b)", r = `x ${run(c)} \\`exec(d)\\``
obj.go?.(
  /exec(e)/.test(f),
  function (g) { h(g) /* exec(i) */ },
)
class K { m(j) { return new L(k) } }
t = a
  .b(1)(2).c(3)
if (x) y(z)
"""
    calls = [(line, n) for _, line, n in kinds(js_nodes(text), "call")]
    assert calls == [(2, "run"), (3, "obj.go"), (5, "h"), (8, "a\n  .b(1)(2).c"), (8, "a\n  .b(1)"), (8, "a\n  .b"), (10, "y")]
    assert [(n.name, n.value) for n in js_nodes("let a = 1, b\nc.d = e, f = (g) => { h = i }") if n.kind in ("declarator", "assignment")] == [("a", "1"), ("c.d", "e"), ("f", "(g) => { h = i }"), ("h", "i")]


def test_shell_nodes():
    from riskloom.operators.script_trees import shell_nodes

    text = """# eval $0
a=$1 b="$(x "$(y $2)")" cmd 'it $(isnt)' >out 2>&1
if test -n "$a"; then local z=$a; fi
cat <<E <<'F'
$(inside $3)
E
$(outside $4)
F
diff <(sort $5) `z \\
 $6`
case $a in
  x|y) one ;;
  *) exit ;;
esac
"""
    got = [(n.kind, n.line, n.text) for n in shell_nodes(text) if n.kind in ("substitution", "process", "assignment", "case")]
    assert got == [
        ("assignment", 2, "a=$1"), ("assignment", 2, 'b="$(x "$(y $2)")"'), ("substitution", 2, '$(x "$(y $2)")'), ("substitution", 2, "$(y $2)"), ("assignment", 3, "z=$a"), ("substitution", 5, "$(inside $3)"),
        ("process", 9, "<(sort $5)"), ("substitution", 9, "`z \\\n $6`"), ("case", 11, "case $a in\n  x|y) one ;;\n  *) exit ;;\nesac"),
    ]
    commands = [n.text for n in shell_nodes(text) if n.kind == "command"]
    assert commands[0].startswith("a=$1") and commands[0].endswith("'it $(isnt)'") and "one" in commands and "inside $3" in commands and not any("outside" in c for c in commands)
    assert [n.kind for n in shell_nodes("x > y")] == ["redirected", "command"]


@pytest.mark.parametrize("name,src,want", [
    ("x.js", "let c;\nc = req.query.c;\nexec(c);", [("High", 3)]),
    ("x.js", "let c;\nc = quote(req.query.c);\nexec(c);", []),
    ("x.js", "let c;\nc = 'fixed';\nexec(c);", []),
    ("x.js", "const cp = require('child_process');\nlet a;\na = req.body.f;\ncp\n  .execFile(\n    a\n  );", [("Medium", 4)]),
    ("x.js", "let o\no = {f: req.body.f}\nspawn('ls', [\n  o], {\n shell: true })", [("High", 3)]),
    ("x.js", "const s = `${exec(req.query.c)}`", [("High", 1)]),
    ("x.sh", 'f() {\n  local x=$1\n  eval "$x"\n}', [("High", 3)]),
    ("x.sh", 'f() {\n  local x=$1\n  case "$x" in\n    a|b) ;;\n    *) exit 1 ;;\n  esac\n  eval "$x"\n}', []),
    ("x.sh", "export v=$2\ncat <<E\n$(ls\n$v)\nE", [("High", 3)]),
    ("x.sh", "export v=$2\ncat <<'E'\n$(ls\n$v)\nE", []),
    ("x.sh", "declare v=$1; x=\"$(a \"$(b $v)\")\"", [("High", 1)]),
])
def test_trees_find_more(name, src, want):
    assert hits(name, src) == want


def test_outermost_by_brute_force():
    import random

    from riskloom.operators.script_trees import outermost

    rng = random.Random(6)
    for _ in range(500):
        spans = [(a := rng.randrange(20), a + rng.randrange(8), rng.choice("xy")) for _ in range(rng.randrange(12))]
        want = set()
        for k, (a, z, w) in enumerate(spans):
            holders = [j for j, (b, y, v) in enumerate(spans) if j != k and v == w and b <= a and z <= y and ((b, y) != (a, z) or j < k)]
            if not holders:
                want.add(k)
        got = outermost(spans)
        assert set(got) == want
        assert got == sorted(got, key=lambda k: (spans[k][0], -spans[k][1], k))


def test_readers_never_fail_or_hang():
    import random

    from riskloom.operators.script_trees import js_nodes, shell_nodes

    rng = random.Random(7)
    parts = [*"ab$(){}[]`'\"\\/;=,.?:\n <>&|#!", "const ", "case ", " in ", "esac", "<<E\n", "${", "$(", "=>", "//", "/*"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        for n in [*js_nodes(text), *shell_nodes(text)]:
            assert 0 <= n.start < n.end <= len(text) and n.text == text[n.start : n.end] and n.line == text.count("\n", 0, n.start) + 1
    for text in ("(" * 50_000, "$(" * 50_000, "`" * 50_001, "case x in " * 10_000, "a(b);" * 20_000):
        js_nodes(text), shell_nodes(text)


# ---------------------------------------------------------------- the closure as a relation


def test_relation_equals_closures(spark):
    """All files at once, by rounds, against each scope's own closure; chains, cycles, scopes and loops."""
    import random
    from collections import defaultdict

    from riskloom.operators import taint_values as V
    from riskloom.operators.code_facts import Source
    from riskloom.plans import taint_relation
    from riskloom.sources.corpus import Corpus

    rng = random.Random(3)
    texts = ["", "x = (", "a = b\nb = a\n", "a = input()\n" + "".join(f"a{i + 1} = a{i}\n" for i in range(12)).replace("a0", "a"), "d['k'] = input()\ne = d\nf.g = e\nh = lambda: f.g\n"]
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(1, 14)):
            name, value = (rng.choice("abcdef") for _ in range(2))
            lines.append(rng.choice([f"{name} = {value}", f"{name} += {value}", f"for {name} in {value}: pass", f"{name} = input()", f"def f{len(lines)}({name}):\n    {value} = {name}\n    {name} = input()\n    c = {value}", f"{name}['x'] = {value}.y"]))
        texts.append("\n".join(lines))
    want = set()
    for k, text in enumerate(texts):
        tree = taint.parsed(text)
        if tree is None:
            continue
        scopes = defaultdict(list)
        for f in Source(tree, taint._KNOWN, frozenset(V.SQL_CALLS)).facts:
            if f.kind == "edge" and f.scope is not None:
                scopes[f.scope].append((frozenset(t for t in f.targets if t.startswith("key:")), f.value.atoms))
        want |= {(f"{k}.py", scope, atom[4:]) for scope, es in scopes.items() for atom in taint.closure(es, "input:")}
    c = Corpus(spark, spark.createDataFrame([(f"{k}.py", t) for k, t in enumerate(texts)], "path string, text string"))
    rows = taint_relation.tainted(c).collect()
    assert {(r["file_path"], r["scope"], r["name"]) for r in rows} == want and len(rows) == len(want)
    assert {r["name"]: r["round"] for r in rows if r["file_path"] == "3.py"} == {"a": 1, **{f"a{i}": i + 1 for i in range(1, 13)}}
    empty = Corpus(spark, spark.createDataFrame([], "path string, text string"))
    assert taint_relation.tainted(empty).count() == 0

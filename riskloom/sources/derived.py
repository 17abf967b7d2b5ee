"""A source tree made of the documents table, for queries and benchmarks.

Every document becomes one file: its whole text followed by a snippet. Path and snippet
follow from doc_id, so the same tree can be built by any engine. Characters outside
ASCII are folded to 'e' in the file's text, because engines differ on word boundaries
next to them. In source files the text stands in comments, so that they can be parsed; in
package manifests it is the description (with a space for what would need an escape), or
left out where the snippet is no object.

EXPECTED says, for rules that need syntax trees or state, which findings the snippets
give: worked out by hand from the rules, so that the oracle has them without a parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.dialect import DUCK, SPARK
from riskloom.sources.corpus import CONTEXTS, Corpus
from riskloom.sources.manifests import JS_IMPORT

#: path with {id}, then the snippets that such files get in turn
TREE: list[tuple[str, list[str]]] = [
    ("src/app{id}.py", [
        "import pickle\npickle.loads(input())", "import yaml\nyaml.load(stream)", "name = input()\nopen(name)", 'import requests\nrequests.get(request.args["u"])', "render_template_string(input())", "eval(input())",
        "import ast\nast.literal_eval(input())", 'q = "SELECT " + input()\ncur.execute(q)', "cur.execute(input())", "import subprocess\nsubprocess.run([input()])", "import os\ndef run(c):\n    os.system(c)\nrun(input())", "import yaml\nyaml.load(input(), Loader=yaml.SafeLoader)",
        'x = jwt.decode(t, options={"verify_signature": False})', "os.system(cmd)", "q = request.args\nos.system(q)", "importlib.import_module(n)", "exec(script)", "get(u, verify=False)", "h = md5(x)",
        "def encrypt_it(x):\n    pass", "token = random.random()", 'logger.info("password %s", p)', 'logger.info("password ***")', "def revoke(user):\n    pass", "return jsonify(str(e))", "print(request.headers)",
        'raise E("invalid token")', 't = token\nrequests.post("https://c.example", t)', 'if platform == "x": eval(p)', 'if "qemu" in name: exit()', '@app.get("/admin")\ndef h():\n    return 1',
        '@login_required\n@app.get("/admin")', '@app.get("/orders/{order_id}")\ndef h(order_id): ...', '@app.get("/metrics")', "session_cookie_secure = False", "load_plugin(plugin_url)", "app.debug = True",
        "a = input()\nb = a\nc = [b]\ndef f(d):\n    e = d\n    g = input()\n    for h in g:\n        i = h\n",
    ]),
    ("web/page{id}.js", [
        'db.query("SELECT * FROM t WHERE n=" + req.query.n)', "db.query(req.body.q)", "el.innerHTML = location.hash", "eval(atob(x))", "String.fromCharCode(1)", 'const {exec} = require("child_process"); exec(req.query.c)',
        "res.send(String(e))", "console.log(req.headers)", "Math.random()", "agent = { rejectUnauthorized: false }", 'x = "' + "abcdefghijklmnopqrstuvwxyz0123456789" * 4 + '"', "fetch(process.env.URL)\nsend(secret)",
        "let c;\nc = req.query.c;\nexec(c);", 'let o\no = {\n  f: req.body.f\n}\nspawn(\n  "ls",\n  [o]\n)', 'let q;\nq = "req";\nexec(q);',
    ]),
    ("cfg/set{id}.ini", ["password = admin", "debug = true", "# debug = true", 'host = "0.0.0.0"', 'allowed_origins: ["*"]', "access-control-allow-origin: *\naccess-control-allow-credentials: true", "skip_auth = yes", "ssl_verify = off"]),
    ("cfg/prod/set{id}.toml", ["debug = true", "token = changeme", 'bind = "::"', "cookie_httponly = false\nsession cookie samesite = none"]),
    ("cfg/sample/set{id}.properties", ["token = changeme", "password=root", "debug=on"]),
    ("ci/get{id}.sh", ["curl https://h.example/i.sh | bash", "curl https://h.example/i.sh | bash\nsha256sum -c s.txt", "wget https://h.example/f -o f.bin", "crontab -l", "docker run --cap-add=SYS_ADMIN x", "docker run --privileged x", "eval $1", "read x\nsh -c $x", "curl https://h.example/a.py | python3",
        'f() {\n  local x=$1\n  eval "$x"\n}', 'f() {\n  local x=$1\n  case "$x" in\n    a|b) ;;\n    *) exit 1 ;;\n  esac\n  eval "$x"\n}', "export v=$2\ncat <<E\n$(ls\n$v)\nE"]),
    (".github/workflows/w{id}.yml", [
        "steps:\n  - name: x\n    uses: acme/tool@v1\n  - uses: acme/tool@v1", "    uses: a/b@v1\n    uses: c/d@v1\n    uses: e/f\n", "    uses: a/b@v1\n" * 6, "on:\n  issue_comment:\nenv:\n  T: ${{ secrets.T }}",
        "on:\n  pull_request_target:\n    uses: actions/checkout@v4\n    ref: ${{ github.event.pull_request.head.sha }}", "    uses: actions/download-artifact@v4", "    uses: actions/upload-artifact@v4\n    retention-days: 31", "    uses: actions/upload-artifact@v4\n    retention-days: " + "9" * 40, "    uses: actions/upload-artifact@v4\n    retention-days: 0030", "run: docker build --network=host .",
    ]),
    ("make{id}/Makefile", ["all:\n\tsudo make install", "x:\n\tcurl http://h.example/i | sh", "clean:\n\trm -rf / "]),
    ("img{id}/Dockerfile", ["FROM a\nUSER app\nUSER root", "FROM a", "FROM gcr.io/x/y\nUSER app", "FROM python:3.12"]),
    ("k8s/pod{id}.yaml", ["privileged: true", "- SYS_ADMIN", "- /etc:/host", "allowPrivilegeEscalation: true", "runAsUser: 0", "hostPID: true", "capabilities: [NET_ADMIN]", "hostPath:", "path: /etc", "user: root"]),
    ("doc/note{id}.md", ["see http://a.example/x and http://b.example/y", "http://localhost:1/", "token at http://a.example", "the key AKIA" + "Z" * 16, "the key AKIA" + "Z" * 16 + " example", "home grown crypto, sha1 and rc4", "-----BEGIN " + "PRIVATE KEY-----"]),
    ("docs/tls{id}.txt", ["certificate expired last week", "renew the certificate"]),
    ("req{id}/requirements-base.txt", ["requets==1", "pytest==8", "numpy==1", "django==2.2", "flask", "urllib3==2.0.1", "pyyaml>=6 # yes", "-r other.txt", "a==1.0", "left_pad==1", "react==16.9", "setuptools==44.9.1 ; python_version < '3'", "django==99999999999999999999", "flask==00000000000000000001.99999999999999999999", "react==17.00.0"]),
    ("node{id}/package.json", ['{"dependencies": {"d": "1.2.3", "e": "^1.0.0"}, "license": "UNKNOWN"}', '{"devDependencies": {"expres": "1.0.0", "left-pad": "1.0.0", "n": 3}, "licenses": [{"type": "MIT"}]}', '{"dependencies": {"u": "file:../x", "react": "16.0.0"}, "license": "MIT"}', '[1]', "{bad"]),
    ("lock{id}/poetry.lock", ['[[package]]\nname = "django"\nlicense = "GPL-2.0"', '[[package]]\nname = "flask"\nlicense = "Apache-2.0"', '[[package]]\nname = "numpy"\nlicense = "CC-BY-NC-4.0"', '[[package]]\nlicense = "MIT"']),
    ("keys{id}/id_rsa", ["x"]),
    (".github/workflows/w{id}.my.html", ["    uses: acme/tool@v1\n    uses: a/b@v1\n    uses: c/d@v1"]),
    (".github/workflows/w{id}.xyml", ["    uses: actions/download-artifact@v4", "on:\n  issue_comment:", "    uses: acme/tool"]),
    ("tree{id}/package-lock.json", [
        '{"packages": {"top": {"name": "top", "license": "MIT"}, "node_modules/d": {"license": "MIT"}, "node_modules/e": {"version": "1"}}}', '{"packages": {"node_modules/@s/react": {"name": "react", "license": "AGPL-3.0 OR MIT"}, "node_modules/z": {"license": 3}}}',
        '{"dependencies": {"expres": {"license": "GPL-3.0-only"}, "left-pad": {"license": ""}, "n": 1}}', '{"packages": {"node_modules/u": {"license": "for personal use only"}}, "dependencies": {"u": {"license": "UNLICENSED"}}}', "[]", "{",
    ]),
]
#: (suffix, snippet, rule, severity, line in the snippet) of the findings of A-1 to A-8 that need a syntax tree or state
EXPECTED = [
    (".py", "q = request.args\nos.system(q)", "A-1", "High", 2),
    (".py", "import subprocess\nsubprocess.run([input()])", "A-1", "Medium", 2),
    (".py", "import os\ndef run(c):\n    os.system(c)\nrun(input())", "A-1", "High", 4),
    (".js", 'const {exec} = require("child_process"); exec(req.query.c)', "A-1", "High", 1),
    (".sh", "eval $1", "A-1", "High", 1),
    (".sh", "read x\nsh -c $x", "A-1", "High", 2),
    (".js", "let c;\nc = req.query.c;\nexec(c);", "A-1", "High", 3),
    (".js", 'let o\no = {\n  f: req.body.f\n}\nspawn(\n  "ls",\n  [o]\n)', "A-1", "Medium", 5),
    (".sh", 'f() {\n  local x=$1\n  eval "$x"\n}', "A-1", "High", 3),
    (".sh", "export v=$2\ncat <<E\n$(ls\n$v)\nE", "A-1", "High", 3),
    (".py", 'q = "SELECT " + input()\ncur.execute(q)', "A-2", "High", 2),
    (".py", "cur.execute(input())", "A-2", "Medium", 1),
    (".py", "import pickle\npickle.loads(input())", "A-3", "High", 2),
    (".py", "import yaml\nyaml.load(stream)", "A-3", "Medium", 2),
    (".py", "name = input()\nopen(name)", "A-4", "High", 2),
    (".py", 'import requests\nrequests.get(request.args["u"])', "A-5", "High", 2),
    (".py", "render_template_string(input())", "A-6", "High", 1),
    (".py", "render_template_string(input())", "A-7", "High", 1),
    (".py", "eval(input())", "A-8", "High", 1),
    (".py", "import ast\nast.literal_eval(input())", "A-8", "Medium", 2),
]
#: (snippet, scope, name, round) of the names that input reaches in the Python snippets
TAINTED = [
    ("name = input()\nopen(name)", 0, "name", 1), ('q = "SELECT " + input()\ncur.execute(q)', 0, "q", 1), ("q = request.args\nos.system(q)", 0, "q", 1),
    *(("a = input()\nb = a\nc = [b]\ndef f(d):\n    e = d\n    g = input()\n    for h in g:\n        i = h\n", *row) for row in ((0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "g", 1), (1, "h", 2), (1, "i", 3))),
]
#: (snippet, module) of what the Python snippets import
IMPORTED = [(x, m) for x, m in (
    ("import pickle\npickle.loads(input())", "pickle"), ("import yaml\nyaml.load(stream)", "yaml"), ('import requests\nrequests.get(request.args["u"])', "requests"), ("import ast\nast.literal_eval(input())", "ast"),
    ("import subprocess\nsubprocess.run([input()])", "subprocess"), ("import os\ndef run(c):\n    os.system(c)\nrun(input())", "os"), ("import yaml\nyaml.load(input(), Loader=yaml.SafeLoader)", "yaml"),
)]
#: permission bits of file doc_id, in turn
MODES = (0o644, 0o600, 0o660, 0o646)


def _folded() -> str:
    """A document's text with ASCII alone and line feeds as its only line ends; patterns are tried where they change something."""
    text = "coalesce(text, '')"
    plain = f"CASE WHEN octet_length({text}) = char_length({text}) AND is_valid_utf8({text}) THEN {text} ELSE {SPARK.sub(text, r'[\x{80}-\x{10FFFF}]', 'e')} END"
    ends = SPARK.rx("text", r"[\r\x0b\x0c\x1c-\x1e]")
    return f"CASE WHEN {ends} THEN {SPARK.sub(plain, r'\r\n?|[\x0b\x0c\x1c-\x1e]', chr(10))} ELSE {plain} END"


def tree_sql(d) -> str:
    """Select (path, text, mode) from documents and two fixed lists of path kinds and snippets."""
    turn = f"(doc_id // {len(TREE)})" if d is DUCK else f"(doc_id div {len(TREE)})"
    folded = _folded() if d is SPARK else d.sub(d.sub("coalesce(text, '')", r"[^\x00-\x7F]", "e"), r"\r\n?|[\x0b\x0c\x1c-\x1e]", "\n")
    plain = d.sub(folded, r'[\x00-\x1f"\\]', " ")
    line = d.lit("\n")
    leads = {".py": "# ", ".sh": "# ", ".js": "// "}
    kinds = ", ".join(f"({i}, {d.lit(p.split('{id}')[0])}, {d.lit(p.split('{id}')[1])}, {len(snips)}, {str(p.endswith('.json')).lower()}, {d.lit(leads.get(p[p.rfind('.') :], ''))})" for i, (p, snips) in enumerate(TREE))
    snips = ", ".join(f"({i}, {j}, {d.lit(x)})" for i, (_, xs) in enumerate(TREE) for j, x in enumerate(xs))
    mode = "CASE " + f"{turn} % {len(MODES)} " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(MODES)) + " END"
    hint = "/*+ BROADCAST(t), BROADCAST(s) */ " if d is SPARK else ""
    return f"""SELECT {hint}concat(head, CAST(doc_id AS VARCHAR(20)), tail) AS path, CASE WHEN bare AND snip LIKE '{{"%' THEN concat('{{"description": "', {plain}, '", ', substr(snip, 2)) WHEN bare THEN snip
    WHEN lead <> '' THEN concat(lead, replace({folded}, {line}, concat({line}, lead)), {line}, snip) ELSE concat({folded}, {line}, snip) END AS text, CAST({mode} AS INT) AS mode
  FROM documents JOIN (SELECT * FROM (VALUES {kinds}) v(kind, head, tail, turns, bare, lead)) t ON t.kind = doc_id % {len(TREE)}
  JOIN (SELECT * FROM (VALUES {snips}) v(of_kind, at_turn, snip)) s ON s.of_kind = t.kind AND s.at_turn = {turn} % t.turns"""


META_SQL = """SELECT CAST(floor(epoch_of(max(ts))) AS BIGINT) AS last_commit_ts, CAST(least(count(DISTINCT user_id), 2) AS INT) AS author_count,
    CAST(floor(epoch_of(min(ts))) AS BIGINT) AS last_tag_ts, count(*) > 0 AS archived, CAST(floor(epoch_of(max(ts))) AS BIGINT) + 200 * 86400 AS now_ts FROM events"""


def derived_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("__riskloom_documents")
    files = spark.sql(tree_sql(SPARK).replace("FROM documents", "FROM __riskloom_documents"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.col("ts").cast("timestamp").cast("double")
    meta = events.agg(F.floor(F.max(stamp)).alias("last_commit_ts"), F.least(F.countDistinct("user_id"), F.lit(2)).cast("int").alias("author_count"), F.floor(F.min(stamp)).alias("last_tag_ts"), (F.count(F.lit(1)) > 0).alias("archived"))
    meta = meta.withColumn("now_ts", F.col("last_commit_ts") + 200 * 86400)
    return Corpus(spark, files, repo_meta=meta, advisories=advisories(spark))


#: Advisories that the derived tree's pinned dependencies meet.
ADVISORIES = [
    ("python", "a", "1.0", "X-1", 9.1, "osv"), ("python", "a", "1.0", "X-1", 2.0, "github"), ("python", "django", "2.2", "X-2", 7.5, "github"), ("python", "django", "2.2", "X-6", 3.0, "osv"), ("python", "numpy", "1", "X-3", None, "nvd"),
    ("node", "d", "1.2.3", "X-4", 4.0, "osv"), ("node", "d", "1.2.3", "X-4", 9.9, "nvd"), ("node", "react", "16.0.0", "X-5", 0.1, "osv"), ("node", "react", "16.0.0", "X-7", 9.0, "elsewhere"),
]


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADVISORIES, "ecosystem string, name string, version string, vuln_id string, severity_score double, source string")


def duck_prefix() -> str:
    """WITH clause that builds the corpus' relations for the oracle, from documents and events alone."""
    ctx = ", ".join(f"string_agg(raw, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS {n}" for n, (a, b) in CONTEXTS.items())
    split = "string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]')"
    op = r"\s*(===?|~=|!=|<=|>=|<|>|@|\^|~)\s*"
    rows = ", ".join(f"('{e}', '{n}', '{v}', '{i}', {'NULL' if s is None else s}, '{p}')" for e, n, v, i, s, p in ADVISORIES)
    sections = " UNION ALL ".join(f"SELECT path, unnest(json_keys(j, '$.{s}')) AS k, '{s}' AS sec FROM pj WHERE json_type(j, '$.{s}') = 'OBJECT'" for s in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"))
    imported = ", ".join(f"({DUCK.lit(x)}, '{m}')" for x, m in IMPORTED)
    reached = ", ".join(f"({DUCK.lit(x)}, {scope}, '{n}', {r})" for x, scope, n, r in TAINTED)
    expected = ", ".join(f"('{x}', {DUCK.lit(snip)}, '{r}', '{v}', {at})" for x, snip, r, v, at in EXPECTED)
    return f"""WITH tree AS ({tree_sql(DUCK)}
), files AS (
  SELECT path, lower(path) AS lpath, string_split(path, '/')[-1] AS name, lower(string_split(path, '/')[-1]) AS lname,
         lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)) AS suffix, mode, text, text AS text_lossy FROM tree
), raws AS (
  SELECT * EXCLUDE (ls), unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS raw, unnest(range(1, len(ls) + CASE WHEN ls[-1] = '' THEN 0 ELSE 1 END)) AS line FROM (SELECT *, {split} AS ls FROM files)
), strip AS (
  SELECT *, regexp_replace(raw, '^[\\s\\x1c-\\x1f\\x0b]+|[\\s\\x1c-\\x1f\\x0b]+$', '', 'g') AS s FROM raws
), lines AS (
  SELECT *, {ctx}, coalesce(lag(s) OVER o, '') || ' ' || s || ' ' || coalesce(lead(s) OVER o, '') AS ctx11 FROM strip WINDOW o AS (PARTITION BY path ORDER BY line)
), lossy_lines AS (SELECT * FROM lines
), req AS (
  SELECT path, line, trim(string_split(s, ' #')[1]) AS l FROM lines WHERE starts_with(name, 'requirements') AND suffix = '.txt' AND s <> '' AND s NOT LIKE '#%'
), pj AS (
  SELECT path, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM files WHERE name = 'package.json'
), deps AS (
  SELECT replace(lower(n), '_', '-') AS name, spec, path AS file_path, line, 'python' AS ecosystem FROM (
    SELECT path, line, trim(CASE WHEN regexp_matches(l, '{op}') THEN regexp_extract(l, '^(.*?){op}', 1) ELSE l END) AS n,
           CASE WHEN regexp_matches(l, '{op}') THEN regexp_extract(l, '^.*?{op}', 1) || trim(regexp_extract(l, '^.*?{op}(.*)$', 2)) ELSE '' END AS spec
    FROM req WHERE NOT regexp_matches(l, '^(?:-r |--requirement|-c |--constraint)')) WHERE n <> '' AND NOT regexp_matches(n, '^(?:git\\+|http://|https://|file:)')
  UNION ALL
  SELECT replace(lower(k), '_', '-'), trim(json_extract_string(j, '$.' || sec || '."' || k || '"')), path, NULL, 'node' FROM (SELECT t.*, pj.j FROM ({sections}) t JOIN pj ON pj.path = t.path)
  WHERE json_type(j, '$.' || sec || '."' || k || '"') = 'VARCHAR'
), project_licenses AS (
  SELECT path AS file_path, trim(json_extract_string(j, '$.license')) AS license_expr FROM pj WHERE json_type(j, '$.license') = 'VARCHAR'
  UNION ALL SELECT path, json_extract_string(v, '$.type') FROM (SELECT path, unnest(CAST(json_extract(j, '$.licenses') AS JSON[])) AS v FROM pj WHERE json_type(j, '$.licenses') = 'ARRAY')
), lock AS (
  SELECT *, sum(CASE WHEN s = '[[package]]' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS block FROM lines WHERE name = 'poetry.lock'
), named AS (
  SELECT *, last_value(CASE WHEN regexp_matches(s, '^name\\s*=\\s*"[^"]+"\\s*$') THEN lower(regexp_extract(s, '^name\\s*=\\s*"([^"]+)"', 1)) END IGNORE NULLS) OVER (PARTITION BY path, block ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM lock
), pl AS (
  SELECT path, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM files WHERE name = 'package-lock.json'
), pl_items AS (
  SELECT path, 0 AS part, k, '$.packages."' || k || '"' AS spot, j FROM (SELECT path, j, unnest(json_keys(j, '$.packages')) AS k FROM pl WHERE json_type(j, '$.packages') = 'OBJECT')
  UNION ALL SELECT path, 1, k, '$.dependencies."' || k || '"', j FROM (SELECT path, j, unnest(json_keys(j, '$.dependencies')) AS k FROM pl WHERE json_type(j, '$.dependencies') = 'OBJECT')
), dep_licenses AS (
  SELECT p AS package, regexp_extract(s, '^license\\s*=\\s*"([^"]*)"', 1) AS license_expr, path AS file_path, line, 2 AS part FROM named
  WHERE regexp_matches(s, '^license\\s*=\\s*"[^"]+"\\s*$') AND p IS NOT NULL
  UNION ALL
  SELECT lower(trim(package)), license_expr, path, NULL, part FROM (
    SELECT path, part, CASE WHEN part = 1 THEN k ELSE coalesce(nullif(trim(CASE WHEN json_type(j, spot || '.name') = 'VARCHAR' THEN json_extract_string(j, spot || '.name') END), ''), CASE WHEN starts_with(k, 'node_modules/') THEN substr(k, 14) END) END AS package,
           CASE WHEN json_type(j, spot || '.license') = 'VARCHAR' THEN trim(json_extract_string(j, spot || '.license')) END AS license_expr
    FROM pl_items WHERE json_type(j, spot) = 'OBJECT') WHERE trim(package) <> '' AND license_expr <> ''
), imports AS (
  SELECT DISTINCT 'node' AS ecosystem, replace(lower(CASE WHEN n LIKE '@%' THEN array_to_string(string_split(n, '/')[1:2], '/') ELSE string_split(n, '/')[1] END), '_', '-') AS name
  FROM (SELECT unnest(regexp_extract_all(text, {DUCK.lit(JS_IMPORT)}, 1)) AS n FROM files WHERE regexp_matches(name, '\\.(?:js|jsx|ts|tsx|mjs|cjs)$')) WHERE n NOT LIKE '.%'
  UNION SELECT DISTINCT 'python', module FROM files JOIN (VALUES {imported}) v(snip, module) ON ends_with(text, concat(chr(10), snip)) WHERE suffix = '.py'
), expected AS (
  SELECT v.rule_id, v.severity, path AS file_path, length(text) - length(replace(text, chr(10), '')) + 1 - (length(snip) - length(replace(snip, chr(10), '')) + 1) + v.nth AS line
  FROM files JOIN (VALUES {expected}) v(suffix, snip, rule_id, severity, nth) ON files.suffix = v.suffix AND ends_with(text, concat(chr(10), snip))
), reached AS (
  SELECT path AS file_path, CAST(v.scope AS INTEGER) AS scope, v.name, CAST(v.round AS INTEGER) AS round FROM files JOIN (VALUES {reached}) v(snip, scope, name, round) ON ends_with(text, concat(chr(10), snip)) WHERE suffix = '.py'
), advisories AS (SELECT *, '' AS summary, CAST([] AS VARCHAR[]) AS refs FROM (VALUES {rows}) v(ecosystem, name, version, vuln_id, severity_score, source) WHERE list_contains(['osv', 'github', 'nvd'], source)
  QUALIFY row_number() OVER (PARTITION BY ecosystem, name, version, vuln_id ORDER BY list_position(['osv', 'github', 'nvd'], source)) = 1
), repo_meta AS ({META_SQL.replace('epoch_of', 'epoch')}
)
"""

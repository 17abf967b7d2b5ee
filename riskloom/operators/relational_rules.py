"""Rules over whole files, groups of lines, manifests and the corpus as a whole, as SQL.

Each is one select of (severity, file_path, line, sometimes message) over the relations
files, lines, deps, dep_licenses, project_licenses, imports, repo_meta and advisories. It
states the rule relation by relation and is what an independent engine runs; what Spark
runs is in ``plans.file_pass`` and ``plans.table_rules``, which read each file once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from riskloom.functions.dialect import Dialect, number
from riskloom.operators import rule_values as V
from riskloom.operators.line_rules import TEXT18, WORKFLOW, ext

NULLS = "CAST(NULL AS STRING) AS file_path, CAST(NULL AS BIGINT) AS line"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    title: str
    sql: Callable[[Dialect], str]


def _exists(cond: str) -> str:
    return f"coalesce(bool_or({cond}), false)"


def _c3(d: Dialect) -> str:
    t = d.sub(d.group("raw", V.USES), V.QUOTES, "")
    owner = f"lower({d.group(t, V.OWNER)})"
    return f"""SELECT CASE WHEN n >= 6 THEN 'High' ELSE 'Medium' END AS severity, file_path, line FROM (
        SELECT path AS file_path, count(*) AS n, min(line) AS line FROM lines
        WHERE {WORKFLOW(d)} AND {d.rx('raw', V.USES)} AND NOT {d.starts(t, *V.LOCAL_TARGETS)} AND NOT {d.among(owner, V.OWN_OWNERS)}
        GROUP BY path) x WHERE n >= 3"""


def _c4(d: Dialect) -> str:
    return f"""SELECT 'High' AS severity, file_path, CAST(1 AS BIGINT) AS line FROM (
        SELECT path AS file_path, bool_or({d.rx('raw', V.PULL_REQUEST_TARGET)}) AS t, bool_or({d.rx('raw', V.CHECKOUT)}) AS c,
               bool_or({d.rx('raw', V.PULL_REQUEST_HEAD)}) AS r, bool_or({d.rx('raw', V.SECRETS)}) AS k
        FROM lines WHERE {WORKFLOW(d)} GROUP BY path) x WHERE c AND t AND (r OR k)"""


def _c5(d: Dialect) -> str:
    return f"""SELECT CASE WHEN secret AND NOT guarded THEN 'High' ELSE 'Medium' END AS severity, file_path, line FROM (
        SELECT path AS file_path, min(line) AS line, bool_or({d.rx('text', V.SECRETS)}) AS secret, bool_or({d.rx('text', V.COMMENT_GUARD)}) AS guarded
        FROM lines WHERE {WORKFLOW(d)} AND {d.has('lower(s)', *V.COMMENT_TRIGGERS)} GROUP BY path) x"""


def _c6(d: Dialect) -> str:
    up, down, days = d.rx("raw", V.UPLOAD), d.rx("raw", V.DOWNLOAD), d.group("raw", V.RETENTION)
    inner = f"""(SELECT path AS file_path, bool_or({up}) AS u, bool_or({down}) AS dn, min(CASE WHEN {up} OR {down} THEN line END) AS line,
        bool_or({d.rx('raw', V.RETENTION)} AND {d.digits(days)} > {number(30)}) AS long
        FROM lines WHERE {WORKFLOW(d)} GROUP BY path)"""
    verified = f"(SELECT path FROM files WHERE {d.rx('text', V.ARTIFACT_CHECK)})"
    return f"SELECT 'High' AS severity, file_path, line FROM {inner} x WHERE dn AND file_path NOT IN {verified} UNION ALL SELECT 'Medium' AS severity, file_path, line FROM {inner} y WHERE u AND long"


def header_files(d: Dialect) -> str:
    return f"({d.among('lname', V.HEADER_NAMES)} OR ({ext(*V.HEADER_SUFFIXES)(d)} AND {d.rx('lpath', *V.HEADER_PATHS)}))"


def _d6(d: Dialect) -> str:
    seen = ", ".join(f"{_exists(d.rx('text', h))} AS h{i}" for i, h in enumerate(V.HEADERS))
    return f"""SELECT 'Medium' AS severity, '(config)' AS file_path, CAST(1 AS BIGINT) AS line FROM (
        SELECT count(*) AS n, {seen} FROM files WHERE text IS NOT NULL AND {header_files(d)}) x WHERE n > 0 AND NOT (h0 AND h1 AND h2 AND h3 AND h4)"""


def open_keys(d: Dialect) -> str:
    return f"(({ext(*V.KEY_SUFFIXES)(d)} OR {d.has('lname', *V.KEY_NAMES)}) AND mode & 22 > 0)"


def _d7(d: Dialect) -> str:
    return f"SELECT CASE WHEN mode & 6 > 0 THEN 'High' ELSE 'Medium' END AS severity, path AS file_path, CAST(1 AS BIGINT) AS line FROM files WHERE {open_keys(d)}"


def fixed_sessions(d: Dialect) -> str:
    return f"({ext(*V.SESSION_SUFFIXES)(d)} AND {d.rx('text', V.SESSION)} AND NOT {d.rx('text', V.SESSION_RENEWED)})"


def _e4(d: Dialect) -> str:
    return f"SELECT 'Low' AS severity, path AS file_path, CAST(1 AS BIGINT) AS line FROM files WHERE {fixed_sessions(d)}"


def _f5(d: Dialect) -> str:
    return f"SELECT 'Critical' AS severity, path AS file_path, min(line) AS line FROM lines WHERE {ext(*V.PRIVATE_KEY_SUFFIXES)(d)} AND {d.rx('raw', V.PRIVATE_KEY)} GROUP BY path"


def _g1(d: Dialect) -> str:
    root, user = d.rx("s", V.ROOT_USER), d.rx("s", V.ANY_USER)
    live = "s <> '' AND s NOT LIKE '#%'"
    return f"""SELECT CASE WHEN root IS NOT NULL THEN 'High' ELSE 'Medium' END AS severity, file_path, coalesce(root, CAST(1 AS BIGINT)) AS line FROM (
            SELECT f.path AS file_path, max(CASE WHEN {live} AND {root} THEN line END) AS root, max(CASE WHEN {live} AND {user} THEN line END) AS usr
            FROM (SELECT path FROM files WHERE text IS NOT NULL AND {d.starts('lname', 'dockerfile')}) f LEFT JOIN (SELECT path, line, s FROM lines WHERE {d.starts('lname', 'dockerfile')}) l ON l.path = f.path GROUP BY f.path) x
        WHERE root IS NOT NULL OR usr IS NULL
        UNION ALL SELECT 'High' AS severity, path AS file_path, line FROM lines
        WHERE {ext(*V.ROOT_SUFFIXES)(d)} AND {live} AND {d.rx('s', *V.ROOT_LINES)}"""


def _g7(d: Dialect) -> str:
    return f"""SELECT CASE WHEN (SELECT {_exists(d.rx('text', V.SANDBOX))} FROM files WHERE {ext(*TEXT18)(d)}) THEN 'Medium' ELSE 'High' END AS severity, path AS file_path, line
        FROM lines WHERE {ext(*TEXT18)(d)} AND s <> '' AND s NOT LIKE '#%' AND {d.rx('s', *V.EXECUTION)} AND {d.rx('ctx11', V.UNTRUSTED)}"""


def tls_docs(d: Dialect) -> str:
    return f"({ext(*V.TLS_SUFFIXES)(d)} AND {d.rx('path', *V.TLS_PATHS)})"


def _h6(d: Dialect) -> str:
    return f"""SELECT 'High' AS severity, path AS file_path, line FROM lossy_lines WHERE {tls_docs(d)} AND s <> '' AND {d.rx('s', V.TLS_EXPIRED)}
        UNION ALL SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(d.rx('s', V.TLS_WORDS))} AS seen FROM lossy_lines WHERE {tls_docs(d)} AND s <> '') x WHERE NOT seen"""


def policies(d: Dialect) -> str:
    return f"({d.among('path', V.POLICIES)} OR ({d.among('path', V.READMES)} AND {d.rx('text_lossy', V.POLICY_HINT)}))"


def templates(d: Dialect) -> str:
    return f"({d.among('path', V.TEMPLATES)} OR ({d.starts('path', *V.TEMPLATE_DIRS)} AND {d.rx('name', V.TEMPLATE_NAME)}))"


def bills(d: Dialect) -> str:
    return f"({d.among('path', V.BILLS)} OR ({d.starts('path', *V.BILL_DIRS)} AND {d.has('lname', *V.BILL_WORDS)}))"


def _j2(d: Dialect) -> str:
    return f"SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(policies(d))} AS ok FROM files) x WHERE NOT ok"


def _j3(d: Dialect) -> str:
    return f"SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(templates(d))} AS ok FROM files) x WHERE NOT ok"


def _age(column: str) -> str:
    return f"floor((now_ts - {column}) / 86400)"


def _j1(d: Dialect) -> str:
    return f"SELECT CASE WHEN {_age('last_commit_ts')} >= 365 THEN 'High' ELSE 'Medium' END AS severity, '.git' AS file_path, CAST(1 AS BIGINT) AS line FROM repo_meta WHERE {_age('last_commit_ts')} >= 180"


def _j4(d: Dialect) -> str:
    return "SELECT CASE WHEN author_count = 1 THEN 'High' ELSE 'Medium' END AS severity, '.git' AS file_path, CAST(1 AS BIGINT) AS line FROM repo_meta WHERE author_count IN (1, 2)"


def _j5(d: Dialect) -> str:
    return f"""SELECT CASE WHEN {_age('last_tag_ts')} >= 365 THEN 'High' ELSE 'Medium' END AS severity, '.git/tags' AS file_path, CAST(1 AS BIGINT) AS line FROM repo_meta WHERE last_tag_ts > 0 AND {_age('last_tag_ts')} >= 180
        UNION ALL SELECT 'Medium' AS severity, {NULLS} FROM (SELECT (SELECT {_exists('last_tag_ts > 0')} FROM repo_meta) AS tagged, (SELECT {_exists(d.among('path', V.CHANGE_LOGS))} FROM files) AS logged) x WHERE NOT tagged AND NOT logged"""


def _j6(d: Dialect) -> str:
    return f"SELECT 'High' AS severity, {NULLS} FROM repo_meta WHERE archived"


def _j7(d: Dialect) -> str:
    return f"""SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(bills(d))} AS ok FROM files) x WHERE NOT ok
        UNION ALL SELECT 'Low' AS severity, path AS file_path, CAST(1 AS BIGINT) AS line FROM files WHERE {bills(d)} AND suffix <> '' AND NOT {d.among('suffix', V.BILL_SUFFIXES)}"""


# ---- dependencies


def loose(d: Dialect) -> str:
    s = "lower(trim(spec))"
    return f"({s} = '' OR {d.has(s, *V.LOOSE_MARKS)} OR (ecosystem = 'python' AND NOT {d.starts(s, '==')}) OR (ecosystem = 'node' AND NOT {d.rx(s, V.PLAIN_VERSION)}))"


def pinned(d: Dialect) -> str:
    return f"((ecosystem = 'python' AND {d.starts('trim(spec)', '==')}) OR (ecosystem = 'node' AND {d.rx('trim(spec)', V.PLAIN_VERSION)}))"


def suspicious(d: Dialect) -> str:
    near = " OR ".join(f"{d.one_edit('name', p)}" for p in V.COMMON_PACKAGES)
    return f"({d.has('name', *V.SUSPICIOUS_PARTS)} OR {d.starts('lower(spec)', *V.SUSPICIOUS_SPECS)} OR {near})"


def deprecation(d: Dialect) -> str:
    """The severity of a dependency that is deprecated, else null."""
    version = d.group("spec", V.VERSION)
    limit = " ".join(f"WHEN name = '{n}' THEN CASE WHEN {version} = '' THEN 'Low' WHEN {d.ints(version)} < {d.int_list(v)} THEN 'Medium' END" for n, v in V.DEPRECATED_BELOW)
    return f"CASE WHEN {d.among('name', V.DEPRECATED)} THEN 'Medium' {limit} END"


def import_name(d: Dialect) -> str:
    """What a dependency is imported as."""
    return "CASE ecosystem WHEN 'python' THEN lower(" + d.group("CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.IMPORT_NAMES) + " ELSE name END", "^([^.]*)") + ") ELSE lower(name) END"


def advisory_version(d: Dialect) -> str:
    return f"trim({d.sub('spec', '^=+', '')})"


SCORE = "CASE WHEN severity_score IS NULL THEN 'Medium' WHEN severity_score >= 9 THEN 'Critical' WHEN severity_score >= 7 THEN 'High' WHEN severity_score >= 4 THEN 'Medium' ELSE 'Low' END"
SPEC = "CASE WHEN spec = '' THEN 'none' ELSE spec END"
MESSAGES = {
    "B-1": f"concat(name, ' may have known vulnerabilities, but its version is not pinned (', {SPEC}, ')')",
    "B-2": f"concat(name, ' is not pinned to one version (', {SPEC}, ')')",
    "B-3": "concat(name, ' ', spec, ' looks unlike a package of that name')",
    "B-4": "concat(name, ' ', spec, ' is deprecated or of a deprecated version')",
    "B-6": "concat(name, ' is declared, but ', expected, ' is imported nowhere')",
    "K-4": "concat(name, ' has no known licence (', coalesce(lic, 'none'), ')')",
    "K-5": "concat(package, ' allows no commercial use (', license_expr, ')')",
}
#: Characters of a summary and addresses that a message has.
SUMMARY_CHARS, REFERENCES, EXAMPLES = 160, 2, 3


def advisory_message(d: Dialect, join: str) -> str:
    refs = f"CASE WHEN {d.size('refs')} > 0 THEN concat(' refs: ', {join}({d.first_of_list('refs', REFERENCES)}, ', ')) ELSE '' END"
    return f"concat(name, ' ', spec, ' may have a known vulnerability [', source, ':', vuln_id, '] ', substr(summary, 1, {SUMMARY_CHARS}), {refs})"


def _b1(d: Dialect) -> str:
    known = f"(SELECT deps.*, severity_score, source, vuln_id, summary, refs FROM deps JOIN advisories a ON a.ecosystem = deps.ecosystem AND a.name = deps.name AND a.version = {advisory_version(d).replace('spec', 'deps.spec')})"
    return f"""SELECT 'Medium' AS severity, file_path, line, {MESSAGES['B-1']} AS message FROM deps WHERE NOT {pinned(d)}
        UNION ALL SELECT {SCORE} AS severity, file_path, line, {advisory_message(d, 'array_to_string')} AS message FROM {known} k WHERE {pinned(d)}"""


def _b2(d: Dialect) -> str:
    return f"SELECT 'Medium' AS severity, file_path, line, {MESSAGES['B-2']} AS message FROM deps WHERE {loose(d)}"


def _b3(d: Dialect) -> str:
    return f"SELECT 'Medium' AS severity, file_path, line, {MESSAGES['B-3']} AS message FROM deps WHERE {suspicious(d)}"


def _b4(d: Dialect) -> str:
    return f"SELECT * FROM (SELECT {deprecation(d)} AS severity, file_path, line, {MESSAGES['B-4']} AS message FROM deps) x WHERE severity IS NOT NULL"


def _b5(d: Dialect) -> str:
    def missing(manifests, locks):
        return f"SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(d.among('name', manifests))} AS m, {_exists(d.among('name', locks))} AS l FROM files) x WHERE m AND NOT l"

    return missing(V.PYTHON_MANIFESTS, V.PYTHON_LOCKS) + " UNION ALL " + missing(V.NODE_MANIFESTS, V.NODE_LOCKS)


def _b6(d: Dialect) -> str:
    return f"SELECT 'Low' AS severity, file_path, line, {MESSAGES['B-6']} AS message FROM (SELECT *, {import_name(d)} AS expected FROM deps) t WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.ecosystem = t.ecosystem AND i.name = t.expected)"


# ---- licences


def _tokens(d: Dialect) -> str:
    """One row for each token of each dependency licence."""
    return f"(SELECT upper(tok) AS tok FROM {d.each(d.all('license_expr', V.LICENSE_TOKEN), 'tok', 'dep_licenses')} z)"


def closed(d: Dialect) -> str:
    return f"({d.among('path', V.CLOSED_FILES)} OR ({d.among('path', V.READMES)} AND {d.has('lower(text_lossy)', *V.CLOSED_TERMS)}))"


def no_commerce_file(d: Dialect) -> str:
    return f"({d.among('name', V.LICENSE_FILES)} AND {d.has('lower(text_lossy)', *V.NONCOMMERCIAL)})"


def _k1(d: Dialect) -> str:
    return f"""SELECT 'Medium' AS severity, {NULLS} FROM (SELECT (SELECT {_exists(d.among('name', V.LICENSE_FILES))} FROM files) AS f, (SELECT count(*) FROM project_licenses) AS n) x WHERE NOT f AND n = 0
        UNION ALL SELECT 'Low' AS severity, file_path, CAST(NULL AS BIGINT) AS line FROM project_licenses WHERE {d.has('lower(license_expr)', *V.VAGUE_LICENSES)}"""


def _k2(d: Dialect) -> str:
    pair = lambda left: f"SELECT 'Medium' AS severity, {NULLS} FROM (SELECT {_exists(f'tok = {d.lit(left)}')} AS a, {_exists('tok = ' + d.lit('APACHE-2.0'))} AS b FROM {_tokens(d)} t) x WHERE a AND b"
    return pair("GPL-2.0") + " UNION ALL " + pair("GPL-2.0-ONLY")


def _k3(d: Dialect) -> str:
    strong = f"list_sort(list_distinct(list_filter(list_transform({d.all('license_expr', V.LICENSE_TOKEN)}, lambda t: upper(t)), lambda t: {d.among('t', V.STRONG_COPYLEFT)})))"
    return f"""SELECT CASE WHEN (SELECT {_exists(closed(d))} FROM files) THEN 'High' ELSE 'Medium' END AS severity, {NULLS},
        concat('strong copyleft among the dependencies (', string_agg(package || ': ' || array_to_string(strong, ', '), '; ' ORDER BY n), ')') AS message
        FROM (SELECT package, strong, row_number() OVER (ORDER BY part, file_path, coalesce(line, 0), license_expr, package) AS n FROM (SELECT *, {strong} AS strong FROM dep_licenses) z WHERE len(strong) > 0) x
        WHERE n <= {EXAMPLES} HAVING count(*) > 0"""


def _k4(d: Dialect) -> str:
    return f"""SELECT 'Medium' AS severity, deps.file_path, deps.line, {MESSAGES['K-4']} AS message FROM deps LEFT JOIN (SELECT package, min_by(license_expr, (part, file_path, coalesce(line, 0), license_expr)) AS lic FROM dep_licenses GROUP BY package) m ON m.package = deps.name
        WHERE {d.among("coalesce(lower(trim(lic)), '')", V.UNKNOWN_LICENSES)}"""


def _k5(d: Dialect) -> str:
    return f"""SELECT 'High' AS severity, file_path, line, {MESSAGES['K-5']} AS message FROM dep_licenses WHERE {d.has('lower(license_expr)', *V.NONCOMMERCIAL)}
        UNION ALL SELECT 'High' AS severity, path AS file_path, CAST(1 AS BIGINT) AS line, concat(path, ' allows no commercial use') AS message FROM files WHERE {no_commerce_file(d)}"""


RELATIONAL_RULES = {
    r.rule_id + ("/file" if r.rule_id == "E-4" else ""): r
    for r in (
        Rule("B-1", "dependencies", "Known Vulnerabilities", _b1),
        Rule("B-2", "dependencies", "Unpinned Versions", _b2),
        Rule("B-3", "dependencies", "Suspicious Packages", _b3),
        Rule("B-4", "dependencies", "Deprecated Dependencies", _b4),
        Rule("B-5", "dependencies", "Missing Lockfile", _b5),
        Rule("B-6", "dependencies", "Unused Dependencies", _b6),
        Rule("C-3", "cicd", "Third Party Action Usage", _c3),
        Rule("C-4", "cicd", "Untrusted Checkout", _c4),
        Rule("C-5", "cicd", "Dangerous Workflow Triggers", _c5),
        Rule("C-6", "cicd", "Insecure Artifact Handling", _c6),
        Rule("D-6", "config", "Missing Security Headers", _d6),
        Rule("D-7", "config", "Insecure File Permissions", _d7),
        Rule("E-4", "auth", "Insecure Session Config", _e4),
        Rule("F-5", "secrets", "Private Keys Detected", _f5),
        Rule("G-1", "runtime", "Runs as Root", _g1),
        Rule("G-7", "runtime", "Missing Sandbox", _g7),
        Rule("H-6", "crypto", "Expired or Missing TLS Docs", _h6),
        Rule("J-1", "maintenance", "Stale Project", _j1),
        Rule("J-2", "maintenance", "Missing Security Policy", _j2),
        Rule("J-3", "maintenance", "Missing Issue Templates", _j3),
        Rule("J-4", "maintenance", "Low Bus Factor", _j4),
        Rule("J-5", "maintenance", "No Recent Release", _j5),
        Rule("J-6", "maintenance", "Archived Repository", _j6),
        Rule("J-7", "maintenance", "Missing SBOM", _j7),
        Rule("K-1", "license", "Missing License", _k1),
        Rule("K-2", "license", "Conflicting Licenses", _k2),
        Rule("K-3", "license", "Copyleft Risk", _k3),
        Rule("K-4", "license", "Unknown Dependency License", _k4),
        Rule("K-5", "license", "Noncommercial Restriction", _k5),
    )
}

"""What rules ask of one file as a whole: findings at places of its own, and facts about the corpus.

A file rule gives an array of (severity, line, message) from a file's row: its names, its
text, its lines ``ls`` and stripped lines ``ss``. Nothing is grouped or joined, as a file's
lines are in its row. A fact is a condition on a file; the facts of all files are one bit
set each and are put together with ``bit_or`` (see plans.file_pass).

Two line rules belong to rules that are more than line rules: LINE_PARTS. PENDING marks
findings whose severity depends on a fact about the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from riskloom.functions.dialect import SPARK, Dialect, number
from riskloom.operators import relational_rules as R
from riskloom.operators import rule_values as V
from riskloom.operators.line_rules import TEXT18, WORKFLOW, LineRule, always, ext, tested

PENDING = "?"


def places(array: str, cond: str) -> str:
    """The line numbers where cond holds of x."""
    return f"filter(transform({array}, (x, i) -> CASE WHEN {cond} THEN CAST(i + 1 AS BIGINT) END), n -> n IS NOT NULL)"


def once(value: str, name: str, body: str) -> str:
    """body, with name standing for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_line(array: str, cond: str) -> str:
    return f"exists({array}, x -> {cond})"


def find(severity: str, line: str, message: str = "CAST(NULL AS STRING)") -> str:
    return f"named_struct('severity', {severity}, 'line', CAST({line} AS BIGINT), 'message', {message})"


@dataclass(frozen=True)
class FileRule:
    rule_id: str
    #: whether a file may have findings: over path, name, lname, suffix, mode, text, text_lossy, ltext
    may: Callable[[Dialect], str]
    finds: Callable[[Dialect], str]
    lines: bool = True  # whether finds looks at ls or ss


def _c3(d: Dialect) -> str:
    target = d.sub(d.group("x", V.USES), V.QUOTES, "")
    foreign = f"{d.rx('x', V.USES)} AND NOT {d.starts(target, *V.LOCAL_TARGETS)} AND NOT {d.among(f'lower({d.group(target, V.OWNER)})', V.OWN_OWNERS)}"
    return once(places("ls", foreign), "h", f"CASE WHEN size(h) >= 3 THEN array({find("CASE WHEN size(h) >= 6 THEN 'High' ELSE 'Medium' END", 'h[0]')}) END")


def _c4(d: Dialect) -> str:
    cond = f"{any_line('ls', d.rx('x', V.CHECKOUT))} AND {any_line('ls', d.rx('x', V.PULL_REQUEST_TARGET))} AND {any_line('ls', d.rx('x', V.PULL_REQUEST_HEAD, V.SECRETS))}"
    return f"CASE WHEN {cond} THEN array({find("'High'", '1')}) END"


def _c5(d: Dialect) -> str:
    severity = f"CASE WHEN {d.rx('text', V.SECRETS)} AND NOT {d.rx('text', V.COMMENT_GUARD)} THEN 'High' ELSE 'Medium' END"
    return once(places("ss", d.has("lower(x)", *V.COMMENT_TRIGGERS)), "h", f"CASE WHEN size(h) > 0 THEN array({find(severity, 'h[0]')}) END")


def _c6(d: Dialect) -> str:
    up, down = d.rx("x", V.UPLOAD), d.rx("x", V.DOWNLOAD)
    long = f"{d.rx('x', V.RETENTION)} AND {d.digits(d.group('x', V.RETENTION))} > {number(30)}"
    unchecked = f"CASE WHEN {any_line('ls', down)} AND NOT {d.rx('text', V.ARTIFACT_CHECK)} THEN array({find("'High'", 'h[0]')}) ELSE array() END"
    kept = f"CASE WHEN {any_line('ls', up)} AND {any_line('ls', long)} THEN array({find("'Medium'", 'h[0]')}) ELSE array() END"
    return once(places("ls", f"{up} OR {down}"), "h", f"CASE WHEN size(h) > 0 THEN concat({unchecked}, {kept}) END")


def _d7(d: Dialect) -> str:
    return f"array({find("CASE WHEN mode & 6 > 0 THEN 'High' ELSE 'Medium' END", '1')})"


def _f5(d: Dialect) -> str:
    return once(places("ls", d.rx("x", V.PRIVATE_KEY)), "h", f"CASE WHEN size(h) > 0 THEN array({find("'Critical'", 'h[0]')}) END")


def _g1(d: Dialect) -> str:
    live = "x <> '' AND x NOT LIKE '#%'"
    root, user = places("ss", f"{live} AND {d.rx('x', V.ROOT_USER)}"), any_line("ss", f"{live} AND {d.rx('x', V.ANY_USER)}")
    return once(root, "h", f"CASE WHEN size(h) > 0 THEN array({find("'High'", 'h[size(h) - 1]')}) WHEN NOT {user} THEN array({find("'Medium'", '1')}) END")


def _h6(d: Dialect) -> str:
    # stripping takes nothing away that the pattern needs
    lines = "split(regexp_replace(text_lossy, lossy_end, ''), line_end)"
    return f"transform({places(lines, d.rx('x', V.TLS_EXPIRED))}, n -> {find("'High'", 'n')})"


FILE_RULES = [
    FileRule("C-3", WORKFLOW, _c3),
    FileRule("C-4", lambda d: f"({WORKFLOW(d)} AND {d.has('text', 'pull_request_target')} AND {d.has('text', 'actions/checkout@')})", _c4),
    FileRule("C-5", lambda d: f"({WORKFLOW(d)} AND {d.has('ltext', *V.COMMENT_TRIGGERS)})", _c5),
    FileRule("C-6", lambda d: f"({WORKFLOW(d)} AND {d.has('ltext', 'load-artifact@')})", _c6),
    FileRule("D-7", R.open_keys, _d7, lines=False),
    FileRule("E-4", R.fixed_sessions, lambda d: f"array({find("'Low'", '1')})", lines=False),
    FileRule("F-5", lambda d: f"({ext(*V.PRIVATE_KEY_SUFFIXES)(d)} AND {d.has('text', '-----BEGIN')})", _f5),
    FileRule("G-1", lambda d: f"(text IS NOT NULL AND {d.starts('lname', 'dockerfile')})", _g1),
    FileRule("H-6", lambda d: f"({R.tls_docs(d)} AND {d.rx('text_lossy', V.TLS_EXPIRED)})", _h6, lines=False),
    FileRule("J-7", lambda d: f"({R.bills(d)} AND suffix <> '' AND NOT {d.among('suffix', V.BILL_SUFFIXES)})", lambda d: f"array({find("'Low'", '1')})", lines=False),
    FileRule("K-5", R.no_commerce_file, lambda d: f"array({find("'High'", '1', "concat(path, ' allows no commercial use')")})", lines=False),
]

LINE_PARTS = {
    "G-1": LineRule("G-1", "runtime", "Runs as Root", ext(*V.ROOT_SUFFIXES), always("High", *V.ROOT_LINES), "B#"),
    "G-7": LineRule(
        "G-7", "runtime", "Missing Sandbox", ext(*TEXT18),
        tested(lambda d: d.rx("s", *V.EXECUTION), lambda d: [f"CASE WHEN {d.rx('s', *V.EXECUTION)} AND {d.rx('ctx11', V.UNTRUSTED)} THEN '{PENDING}' END"]), "B#",
    ),
}


def _headers(i: int) -> Callable[[Dialect], str]:
    return lambda d: f"text IS NOT NULL AND {R.header_files(d)} AND {d.rx('text', V.HEADERS[i])}"


#: name -> condition on a file; a fact's bit is its place in this list.
FACTS: dict[str, Callable[[Dialect], str]] = {
    "header files": lambda d: f"text IS NOT NULL AND {R.header_files(d)}",
    **{f"header {i}": _headers(i) for i in range(len(V.HEADERS))},
    "sandbox": lambda d: f"{ext(*TEXT18)(d)} AND {d.rx('text', V.SANDBOX)}",
    "tls words": lambda d: f"{R.tls_docs(d)} AND {d.rx('text_lossy', V.TLS_WORDS)}",
    "policy": R.policies,
    "issue templates": R.templates,
    "change log": lambda d: d.among("path", V.CHANGE_LOGS),
    "bill of materials": R.bills,
    "python manifest": lambda d: d.among("name", V.PYTHON_MANIFESTS),
    "python lock": lambda d: d.among("name", V.PYTHON_LOCKS),
    "node manifest": lambda d: d.among("name", V.NODE_MANIFESTS),
    "node lock": lambda d: d.among("name", V.NODE_LOCKS),
    "licence file": lambda d: d.among("name", V.LICENSE_FILES),
    "closed": R.closed,
}
#: rule -> the facts that it is judged by
FACTS_OF = {
    "B-5": ("python manifest", "python lock", "node manifest", "node lock"),
    "D-6": ("header files", *(f"header {i}" for i in range(len(V.HEADERS)))),
    "G-7": ("sandbox",),
    "H-6": ("tls words",),
    "J-2": ("policy",),
    "J-3": ("issue templates",),
    "J-5": ("change log",),
    "J-7": ("bill of materials",),
    "K-1": ("licence file",),
    "K-3": ("closed",),
}


def known(fact: str) -> str:
    """Whether a fact is among the bits of a row."""
    return f"(bits & {1 << list(FACTS).index(fact)} <> 0)"


def _row(rule: str, cond: str, path: str = "CAST(NULL AS STRING)", line: str = "CAST(NULL AS BIGINT)") -> tuple[str, str]:
    return rule, f"CASE WHEN {cond} THEN named_struct('rule_id', '{rule}', 'severity', 'Medium', 'file_path', {path}, 'line', {line}) END"


#: (rule, finding or null) over the bits of the whole corpus, tagged (a release is known) and licences (of the project)
CORPUS_RULES = [
    _row("B-5", f"{known('python manifest')} AND NOT {known('python lock')}"),
    _row("B-5", f"{known('node manifest')} AND NOT {known('node lock')}"),
    _row("D-6", f"{known('header files')} AND NOT ({' AND '.join(known(f'header {i}') for i in range(len(V.HEADERS)))})", "'(config)'", "CAST(1 AS BIGINT)"),
    _row("H-6", f"NOT {known('tls words')}"),
    _row("J-2", f"NOT {known('policy')}"),
    _row("J-3", f"NOT {known('issue templates')}"),
    _row("J-5", f"NOT tagged AND NOT {known('change log')}"),
    _row("J-7", f"NOT {known('bill of materials')}"),
    _row("K-1", f"NOT {known('licence file')} AND licences = 0"),
]


#: rule -> (files, pattern) that it looks for in the whole text of many files
SOUGHT = {"E-4": (ext(*V.SESSION_SUFFIXES), V.SESSION), "G-7": (ext(*TEXT18), V.SANDBOX)}


def fact_bits(names: tuple[str, ...], d: Dialect = SPARK) -> str:
    """The bits of one file."""
    terms = [f"CASE WHEN {FACTS[n](d)} THEN {1 << i}L ELSE 0L END" for i, n in enumerate(FACTS) if n in names]
    return " + ".join(terms) or "0L"

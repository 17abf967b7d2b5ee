"""Scripts as nodes: a tolerant reader of JavaScript or TypeScript and one of shell.

Each turns a text into nodes with their place (start, end), line, kind and parts. They know
quotes, templates and their expressions, comments, regular expressions, here-documents and
nested substitutions, and nothing of types or operators: what isn't one of the kinds below
is passed over. Unbalanced or unknown text never fails; a text nested too deeply for
the stack has no nodes.

JavaScript: ``import``, ``declaration`` (a whole const, let or var statement), ``declarator``
and ``assignment`` (name and value), ``call`` (name: the callee's text).
Shell: ``command``, ``substitution`` ($(...) or backticks), ``process`` (<(...)), ``redirected`` (a
command with its redirections), ``assignment`` (name and value), ``case``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    kind: str
    start: int
    end: int
    line: int
    text: str
    name: str = ""
    value: str = ""


def outermost(spans: Iterable[tuple[int, int, object]]) -> list[int]:
    """Of spans (start, end, what), by place: which aren't inside another span of the same ``what``.

    Spans are in the order of their start, longer ones first; of equal spans the first stays.
    """
    rows = sorted(((s, -e, k, w) for k, (s, e, w) in enumerate(spans)), key=lambda r: r[:3])
    furthest: dict[object, int] = {}
    out = []
    for _, end, k, what in rows:
        # all spans before begin no later, so one that ends no earlier holds this one
        if what not in furthest or -end > furthest[what]:
            out.append(k)
            furthest[what] = -end
    return out


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text))]

    def at(self, place: int) -> int:
        return bisect_right(self.starts, place)


# ---------------------------------------------------------------- JavaScript

_JS_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n\r]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\.?[0-9][\w.]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)|(?P<mark>=>|[=!]==?|\?\.(?![0-9])|\.\.\.|\+\+|--|&&|\|\||\?\?|[-+*/%&|^<>]=|[\s\S])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: words after which a slash begins a regular expression, and which are no callees
_JS_KEYWORDS = frozenset("if for while switch catch with return typeof case do else in of instanceof void delete throw new await yield function import export super const let var class extends async default".split())
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class _Token:
    kind: str  # word, number, string, mark, group or template
    text: str
    start: int
    end: int
    fresh: bool  # whether a line ends before it
    inner: list = field(default_factory=list)


class _JsReader:
    def __init__(self, text: str):
        self.text, self.i = text, 0
        self.nodes: list[Node] = []
        self.lines = _Lines(text)
        self.last: _Token | None = None

    def sequence(self, closer: str | None) -> list[_Token]:
        """Tokens up to the closer, groups as tokens of their own."""
        out: list[_Token] = []
        fresh = False
        self.last = None
        while self.i < len(self.text):
            start = self.i
            if self.text[start] == "/" and not self.text.startswith(("//", "/*"), start) and self._pattern_may_begin() and (m := _REGEX.match(self.text, start)):
                token = _Token("string", m[0], start, m.end(), fresh)
            elif self.text[start] == "`":
                token = self._template(fresh)
            else:
                m = _JS_TOKEN.match(self.text, start)
                if m.lastgroup in ("space", "comment"):
                    fresh |= "\n" in m[0] or "\r" in m[0]
                    self.i = m.end()
                    continue
                token = _Token(m.lastgroup, m[0], start, m.end(), fresh)
            self.i = token.end
            if token.kind == "mark" and token.text in _CLOSERS:
                inner = self.sequence(_CLOSERS[token.text])
                token = _Token("group", token.text, start, self.i, fresh, inner)
            elif token.kind == "mark" and token.text in ")]}":
                if token.text == closer:
                    break
                if closer and token.text != closer:  # another group's end ends this one too
                    self.i = start
                    break
            out.append(token)
            self.last, fresh = token, False
        return out

    def _pattern_may_begin(self) -> bool:
        t = self.last
        return t is None or (t.kind == "mark" and t.text not in ("++", "--")) or (t.kind == "word" and t.text in _JS_KEYWORDS)

    def _template(self, fresh: bool) -> _Token:
        start = self.i
        self.i += 1
        inner: list[_Token] = []
        while self.i < len(self.text) and self.text[self.i] != "`":
            if self.text[self.i] == "\\":
                self.i += 2
            elif self.text.startswith("${", self.i):
                at = self.i
                self.i += 2
                parts = self.sequence("}")
                inner.append(_Token("group", "{", at, self.i, False, parts))
            else:
                self.i += 1
        self.i = min(self.i + 1, len(self.text))
        return _Token("template", "`", start, self.i, fresh, inner)

    # ---- nodes

    def put(self, kind: str, start: int, end: int, name: str = "", value: str = "") -> None:
        self.nodes.append(Node(kind, start, end, self.lines.at(start), self.text[start:end], name, value))

    @staticmethod
    def _goes_on(before: _Token, token: _Token) -> bool:
        """Whether a token after a line end belongs to the statement before."""
        if before.kind == "mark" and before.text not in ("++", "--", ")", "]", "}"):
            return True
        return (token.kind == "mark" and token.text not in ("++", "--", "!", "~", "@")) or token.kind == "template" or (token.kind == "group" and token.text != "{")

    def _until(self, seq: list[_Token], i: int, stops: tuple[str, ...]) -> int:
        """Where the statement, or the value that a stop ends, ends."""
        k = i
        while k < len(seq):
            t = seq[k]
            if t.kind == "mark" and t.text in stops:
                break
            if k > i and t.fresh and not self._goes_on(seq[k - 1], t):
                break
            k += 1
        return k

    def walk(self, seq: list[_Token]) -> None:
        declared: set[int] = set()
        for i, t in enumerate(seq):
            if t.kind == "word" and t.text in ("const", "let", "var") and not self._is_member(seq, i):
                end = self._until(seq, i + 1, (";",))
                if end > i + 1:
                    self.put("declaration", t.start, seq[end - 1].end)
                    self._declarators(seq, i + 1, end, declared)
            elif t.kind == "word" and t.text == "import" and not self._is_member(seq, i):
                self.put("import", t.start, seq[self._until(seq, i + 1, (";",)) - 1].end)
            elif t.kind == "mark" and t.text == "=" and i not in declared and i:
                end, first = self._until(seq, i + 1, (";", ",")), self._chain(seq, i - 1)
                if end > i + 1 and first is not None:
                    self.put("assignment", seq[first].start, seq[end - 1].end, self.text[seq[first].start : seq[i - 1].end], self.text[seq[i + 1].start : seq[end - 1].end])
            elif t.kind == "group" and t.text == "(" and i:
                first = self._chain(seq, i - 1)
                if first is not None and self._is_call(seq, first, i):
                    self.put("call", seq[first].start, t.end, self.text[seq[first].start : seq[i - 1].end].removesuffix("?."))
            if t.inner:
                self.walk(t.inner)

    def _declarators(self, seq: list[_Token], i: int, end: int, declared: set[int]) -> None:
        while i < end:
            stop = self._until(seq[:end], i, (",",))
            at = next((k for k in range(i, stop) if seq[k].kind == "mark" and seq[k].text == "="), None)
            if at is not None and i < at < stop - 1:
                declared.add(at)
                self.put("declarator", seq[i].start, seq[stop - 1].end, self.text[seq[i].start : seq[at - 1].end], self.text[seq[at + 1].start : seq[stop - 1].end])
            i = stop + 1

    @staticmethod
    def _is_member(seq: list[_Token], i: int) -> bool:
        return i > 0 and seq[i - 1].kind == "mark" and seq[i - 1].text in (".", "?.")

    def _chain(self, seq: list[_Token], i: int) -> int | None:
        """Where a chain like a.b(c)[d].e begins that ends at i."""
        if seq[i].kind == "mark" and seq[i].text == "?." and i:
            i -= 1
        while True:
            t = seq[i]
            if t.kind == "word" and (t.text not in _JS_KEYWORDS or t.text in ("import", "super") or self._is_member(seq, i)):
                if i > 1 and self._is_member(seq, i):
                    i -= 2
                    continue
                return i
            if t.kind == "group" and t.text in "([" and i:
                before = seq[i - 1]
                if before.kind == "word" and before.text not in _JS_KEYWORDS or (before.kind == "group" and before.text in "(["):
                    i -= 1
                    continue
                if before.kind == "mark" and before.text == "?." and i > 1:
                    i -= 2
                    continue
            if t.kind == "group" and t.text == "(":
                return i  # (function () { ... })(x)
            return None

    @staticmethod
    def _is_call(seq: list[_Token], first: int, i: int) -> bool:
        before = seq[first - 1] if first else None
        if before is not None and before.kind == "word" and before.text in ("function", "new", "class"):
            return False
        if before is not None and before.kind == "mark" and before.text == "*" and first > 1 and seq[first - 2].text == "function":
            return False
        # name(...) { ... } is a method
        return not (first == i - 1 and seq[first].kind == "word" and i + 1 < len(seq) and seq[i + 1].kind == "group" and seq[i + 1].text == "{" and not seq[i + 1].fresh)


def _in_order(nodes: list[Node]) -> list[Node]:
    """By place, outer nodes before what they hold."""
    return sorted(nodes, key=lambda n: (n.start, -n.end))


def js_nodes(text: str) -> list[Node]:
    reader = _JsReader(text)
    try:
        seq: list[_Token] = []
        while reader.i < len(text):  # a stray closer ends nothing
            seq += reader.sequence(None)
        reader.walk(seq)
    except RecursionError:
        return []
    return _in_order(reader.nodes)


# ---------------------------------------------------------------- shell

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\[[^\]\n]*\])?\+?=")
_REDIRECTION = re.compile(r"[0-9]*(?:<<<|<<-?|<>|>>|>\||[<>]&|&>>?|<(?!\()|>(?!\())")
_SHELL_WORDS = frozenset("if then elif else fi while until do done time ! { } [[ function select".split())
_DECLARING = frozenset(("local", "export", "declare", "readonly", "typeset"))


class _ShellReader:
    def __init__(self, text: str):
        self.text, self.i = text, 0
        self.nodes: list[Node] = []
        self.lines = _Lines(text)
        self.documents: list[tuple[str, bool, bool]] = []  # (end, tabs stripped, quoted) of here-documents that begin at the next line

    def put(self, kind: str, start: int, end: int, name: str = "", value: str = "") -> None:
        end = min(end, len(self.text))  # an escape at the very end
        self.nodes.append(Node(kind, start, end, self.lines.at(start), self.text[start:end], name, value))

    def _at(self, what: str) -> bool:
        return self.text.startswith(what, self.i)

    def commands(self, closers: tuple[str, ...]) -> None:
        """Commands up to one of the closers, which is left, or the end."""
        n = len(self.text)
        while self.i < n:
            c = self.text[self.i]
            if any(self._at(x) for x in closers if not x.isalpha()):
                return
            if c == "\n":
                self.i += 1
                self._bodies()
            elif c == "#":
                self.i = self._line_end()
            elif c == "\\" and self.text[self.i + 1 : self.i + 2] == "\n":
                self.i += 2
            elif c in " \t\r;&|)(":
                self.i += 1
            else:
                word = self._peek()
                if word in closers:
                    return
                if word in _SHELL_WORDS:
                    self.i += len(word)
                elif word == "for":
                    self._heading()
                elif word == "case":
                    self._case(closers)
                else:
                    self._command(closers)

    def _peek(self) -> str:
        m = re.compile(r"[^\s;&|()<>\"'`$\\#]+").match(self.text, self.i)
        return m[0] if m else ""

    def _line_end(self) -> int:
        at = self.text.find("\n", self.i)
        return len(self.text) if at < 0 else at

    def _heading(self) -> None:
        """for NAME in WORDS, up to the end of the list of words."""
        while self.i < len(self.text) and self.text[self.i] not in "\n;":
            if self.text[self.i] in " \t\r()&|<>":
                self.i += 1
            elif not self._moved():
                break

    def _moved(self) -> bool:
        """Read a word; false at the end of backticks, where none can begin."""
        start = self.i
        self._word()
        return self.i > start

    def _case(self, closers: tuple[str, ...]) -> None:
        start = self.i
        self.i += len("case")
        while self.i < len(self.text) and self._peek() != "in":
            if self.text[self.i].isspace() or self.text[self.i] in ";&|()<>":
                self.i += 1
            elif not self._moved():
                return
        self.i = min(self.i + len("in"), len(self.text))
        while self.i < len(self.text) and not any(self._at(x) for x in closers if x in (")", "`")):
            while self.i < len(self.text) and (self.text[self.i].isspace() or self._at(";;") or self._at(";&")):
                self.i += 2 if self.text[self.i] == ";" else 1
            if self._peek() == "esac":
                self.i += len("esac")
                break
            while self.i < len(self.text) and self.text[self.i] != ")":  # a pattern
                if self.text[self.i] in " \t\r\n|(;&<>":
                    self.i += 1
                elif not self._moved():
                    return
            self.i += 1
            self.commands((";;", ";&", "esac", *(x for x in closers if x in (")", "`"))))
        self.i = min(self.i, len(self.text))
        self.put("case", start, self.i)

    def _command(self, closers: tuple[str, ...]) -> None:
        begun, body, redirected, first, n_words = self.i, self.i, False, "", 0
        declared = 0
        while self.i < len(self.text):
            c = self.text[self.i]
            if c == "\\" and self.text[self.i + 1 : self.i + 2] == "\n":
                self.i += 2
            elif c in " \t\r":
                self.i += 1
            elif c in "\n;)" or (c in "&|" and not self._at("&>")) or (c == "`" and "`" in closers):
                break
            elif c == "#":
                break
            elif m := _REDIRECTION.match(self.text, self.i):
                self._redirect(m[0])
                redirected = True
                self.i = max(self.i, m.end())
            elif c == "(" and n_words:  # a function's name before it, or an array's values after an assignment
                self.i += 1
                if self._at(")"):
                    self.i += 1
                    return
            else:
                start = self.i
                assigned = _ASSIGNED.match(self.text, start)
                self._word()
                if self.i == start:
                    self.i += 1
                    continue
                if assigned and self.text[assigned.end() : assigned.end() + 1] == "(":
                    self._array()
                if assigned and (not n_words or first in _DECLARING):
                    self.put("assignment", start, self.i, assigned[1], self.text[assigned.end() : self.i])
                    declared += 1
                else:
                    first = first or self.text[start : self.i]
                    n_words += 1
                body = self.i
        if n_words and first not in _DECLARING:
            self.put("command", begun, body)
            if redirected:
                self.put("redirected", begun, self.i)

    def _array(self) -> None:
        self.i += 1
        while self.i < len(self.text) and self.text[self.i] != ")":
            if self.text[self.i] in " \t\r\n;&|(<>":
                self.i += 1
            elif not self._moved():
                return
        self.i = min(self.i + 1, len(self.text))

    def _redirect(self, mark: str) -> None:
        self.i += len(mark)
        while self.i < len(self.text) and self.text[self.i] in " \t":
            self.i += 1
        start = self.i
        if self.i < len(self.text) and self.text[self.i] not in "\n;&|)":
            self._word()
        word = self.text[start : self.i]
        if mark.lstrip("0123456789") in ("<<", "<<-") and word:
            self.documents.append((re.sub(r"[\"'\\]", "", word), mark.endswith("-"), bool(re.search(r"[\"'\\]", word))))

    def _bodies(self) -> None:
        """Skip the here-documents that begin here; substitutions in unquoted ones count."""
        for end, tabs, quoted in self.documents:
            m = re.compile(rf"^{chr(9) + '*' if tabs else ''}{re.escape(end)}\r?$", re.M).search(self.text, self.i)
            stop, after = (m.start(), min(m.end() + 1, len(self.text))) if m else (len(self.text), len(self.text))
            while not quoted and self.i < stop:
                if self.text[self.i] == "\\":
                    self.i += 2
                elif not self._expansion():
                    self.i += 1
            self.i = max(self.i, after)
        self.documents.clear()

    def _word(self) -> None:
        n = len(self.text)
        while self.i < n:
            c = self.text[self.i]
            if c in " \t\r\n;&|)(" or (c in "<>" and not self.text.startswith("(", self.i + 1)):
                return
            if c == "\\":
                self.i = min(self.i + 2, n)
            elif c == "'":
                at = self.text.find("'", self.i + 1)
                self.i = n if at < 0 else at + 1
            elif c == '"':
                self._quoted()
            elif c in "<>":
                start = self.i
                self._nested(self.i + 2, ")")
                self.put("process", start, self.i)
            elif self._at("$'"):
                m = re.compile(r"\$'(?:[^'\\]|\\[\s\S])*'?").match(self.text, self.i)
                self.i = m.end()
            elif c == "`" and self._inside_backticks:
                return
            elif not self._expansion():
                self.i += 1

    _inside_backticks = 0

    def _quoted(self) -> None:
        self.i += 1
        while self.i < len(self.text) and self.text[self.i] != '"':
            if self.text[self.i] == "\\":
                self.i += 2
            elif self.text[self.i] == "`" and self._inside_backticks:
                return
            elif not self._expansion():
                self.i += 1
        self.i = min(self.i + 1, len(self.text))

    def _expansion(self) -> bool:
        """Read a substitution or a ${...} if one begins here."""
        start = self.i
        if self._at("$(("):
            self._balanced(start + 3, "(", ")", 2)
        elif self._at("$("):
            self._nested(start + 2, ")")
            self.put("substitution", start, self.i)
        elif self._at("${"):
            self._balanced(start + 2, "{", "}", 1)
        elif self._at("`") and not self._inside_backticks:
            self._inside_backticks += 1
            self._nested(start + 1, "`")
            self._inside_backticks -= 1
            self.put("substitution", start, self.i)
        else:
            return False
        return True

    def _nested(self, start: int, closer: str) -> None:
        outer, self._inside_backticks = self._inside_backticks, self._inside_backticks if closer == "`" else 0
        self.i = start
        while self.i < len(self.text):
            self.commands((closer,))
            if self._at(closer):
                self.i += 1
                break
        self._inside_backticks = outer

    def _balanced(self, start: int, opener: str, closer: str, depth: int) -> None:
        self.i = start
        while self.i < len(self.text) and depth:
            c = self.text[self.i]
            if c == "\\":
                self.i += 2
                continue
            if self._expansion():
                continue
            depth += (c == opener) - (c == closer)
            self.i += 1
        self.i = min(self.i, len(self.text))


def shell_nodes(text: str) -> list[Node]:
    reader = _ShellReader(text)
    try:
        while reader.i < len(text):
            reader.commands(())
            reader.i += 1
    except RecursionError:
        return []
    return _in_order(reader.nodes)

"""Rule predicates as text that Spark SQL and a second engine both understand.

A rule is written once as a SQL select; the few functions whose spelling differs go
through a dialect. ``SPARK`` is what runs; ``DUCK`` renders the same rule for the
independent oracle.
"""

from __future__ import annotations

from riskloom.functions.literals import needed


#: More literals than these cost as much to look for as their pattern.
MOST_LITERALS = 8


def number(n: int) -> str:
    """A literal like those of Dialect.digits."""
    text = str(n).lstrip("0")
    return f"'{len(text):010d}{text}'"


class Dialect:
    def lit(self, text: str) -> str:
        raise NotImplementedError

    def rx(self, column: str, *patterns: str) -> str:
        """True where any pattern is found."""
        return "(" + " OR ".join(self._rx(column, p) for p in patterns) + ")"

    def has(self, column: str, *tokens: str) -> str:
        """True where any token is contained."""
        return "(" + " OR ".join(f"contains({column}, {self.lit(t)})" for t in tokens) + ")"

    def starts(self, column: str, *tokens: str) -> str:
        """True where the column starts with any token."""
        return "(" + " OR ".join(f"{self.prefix}({column}, {self.lit(t)})" for t in tokens) + ")"

    def among(self, column: str, values) -> str:
        return f"{column} IN ({', '.join(self.lit(v) for v in values)})"


class Recorder(Dialect):
    """Renders nothing; keeps the patterns and tokens that a rule looks for."""

    prefix = "prefix"

    def __init__(self):
        self.patterns: list[str] = []

    def lit(self, text: str) -> str:
        return "''"

    def _rx(self, column: str, pattern: str) -> str:
        self.patterns.append(pattern)
        return "false"

    def has(self, column: str, *tokens: str) -> str:
        import re

        self.patterns += [re.escape(t) for t in tokens]
        return "false"

    def starts(self, column: str, *tokens: str) -> str:
        return "false"

    def among(self, column: str, values) -> str:
        return "false"

    def group(self, column: str, pattern: str, n: int = 1) -> str:
        self.patterns.append(pattern)
        return "''"

    def all(self, column: str, pattern: str, n: int = 0) -> str:
        self.patterns.append(pattern)
        return "array()"

    def sub(self, column: str, pattern: str, by: str) -> str:
        return column

    def each(self, array: str, alias: str, source: str) -> str:
        return source

    def any(self, array: str, test) -> str:
        return "false"


class _Spark(Dialect):
    prefix = "startswith"

    def lit(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def _rx(self, column: str, pattern: str) -> str:
        return f"{column} RLIKE {self.lit(pattern)}"

    def group(self, column: str, pattern: str, n: int = 1) -> str:
        """The n-th group of the first match, '' without one."""
        return f"regexp_extract({column}, {self.lit(pattern)}, {n})"

    def all(self, column: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({column}, {self.lit(pattern)}, {n})"

    def sub(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.lit(pattern)}, {self.lit(by)})"

    def each(self, array: str, alias: str, source: str) -> str:
        return f"{source} LATERAL VIEW explode({array}) AS {alias}"

    def any(self, array: str, test) -> str:
        return f"exists({array}, x -> {test('x')})"

    def distinct_chars(self, text: str) -> str:
        return f"size(array_distinct(split({text}, '')))"

    def one_edit(self, a: str, text: str) -> str:
        """Whether a value is one edit away from a text; other lengths need no distance."""
        return f"(length({a}) BETWEEN {len(text) - 1} AND {len(text) + 1} AND levenshtein({a}, {self.lit(text)}) = 1)"

    def ints(self, text: str) -> str:
        """The numbers of a dotted text as digits without leading zeros, their count before them; arrays compare part by part, a shorter one that is equal so far is smaller. No number is too long."""
        return f"transform(split({text}, '[.]'), x -> {self.digits('x')})"

    def digits(self, text: str) -> str:
        return f"concat(lpad(CAST(length(trim(LEADING '0' FROM {text})) AS STRING), 10, '0'), trim(LEADING '0' FROM {text}))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def first_of_list(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def int_list(self, values) -> str:
        return f"array({', '.join(number(v) for v in values)})"


class _Gated(_Spark):
    """Spark's, over lines with their lower-case text ``low``: a pattern is tried where a literal that it needs is held.

    Patterns that only match at a line's begin fail at once, and are tried as they are.
    """

    def _rx(self, column: str, pattern: str) -> str:
        plain = super()._rx(column, pattern)
        literals = needed(pattern) if column in ("s", "raw") and not pattern.removeprefix("(?i)").startswith("^") else None
        return f"({self.has('low', *sorted(literals))} AND {plain})" if literals and len(literals) <= MOST_LITERALS else plain


class Known(_Spark):
    """Spark's, where it is known of some patterns, by a condition each, whether the text may hold them."""

    def __init__(self, may_hold: dict[str, str]):
        self.may_hold = may_hold

    def _rx(self, column: str, pattern: str) -> str:
        plain = super()._rx(column, pattern)
        return f"({self.may_hold[pattern]} AND {plain})" if column == "text" and pattern in self.may_hold else plain


class _Duck(Dialect):
    prefix = "starts_with"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def _rx(self, column: str, pattern: str) -> str:
        return f"regexp_matches({column}, {self.lit(pattern)})"

    def group(self, column: str, pattern: str, n: int = 1) -> str:
        return f"regexp_extract({column}, {self.lit(pattern)}, {n})"

    def all(self, column: str, pattern: str, n: int = 0) -> str:
        return f"regexp_extract_all({column}, {self.lit(pattern)}, {n})"

    def sub(self, column: str, pattern: str, by: str) -> str:
        return f"regexp_replace({column}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def each(self, array: str, alias: str, source: str) -> str:
        return f"(SELECT *, unnest({array}) AS {alias} FROM {source})"

    def any(self, array: str, test) -> str:
        return f"(len(list_filter({array}, lambda x: {test('x')})) > 0)"

    def distinct_chars(self, text: str) -> str:
        return f"len(list_distinct(string_split({text}, '')))"

    def one_edit(self, a: str, text: str) -> str:
        return f"levenshtein({a}, {self.lit(text)}) = 1"

    def ints(self, text: str) -> str:
        return f"list_transform(string_split({text}, '.'), lambda x: {self.digits('x')})"

    def digits(self, text: str) -> str:
        return f"concat(lpad(CAST(length(ltrim({text}, '0')) AS VARCHAR), 10, '0'), ltrim({text}, '0'))"

    def size(self, array: str) -> str:
        return f"len({array})"

    def first_of_list(self, array: str, n: int) -> str:
        return f"{array}[1:{n}]"

    def int_list(self, values) -> str:
        return f"[{', '.join(number(v) for v in values)}]"


SPARK, GATED, DUCK = _Spark(), _Gated(), _Duck()

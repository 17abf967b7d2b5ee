"""Literals that a text must hold for a pattern to be found in it.

``needed(pattern)`` gives lower-case strings of which at least one is part of every
match, so that a cheap containment test on the lower-case text can come before the
pattern itself. None means that nothing can be said. Literals hold no white space: a
match inside a context of joined lines has them inside one line.
"""

from __future__ import annotations

from re import _constants as K
from re import _parser

#: Shorter literals are too common to be worth a test.
LEAST = 2


def _rank(options: frozenset[str]) -> tuple[int, int]:
    return min(len(x) for x in options), -len(options)


def _best(found: list[frozenset[str] | None]) -> frozenset[str] | None:
    found = [f for f in found if f]
    return max(found, key=_rank) if found else None


def _walk(items) -> frozenset[str] | None:
    found: list[frozenset[str] | None] = []
    run = ""

    def close() -> None:
        nonlocal run
        for piece in run.split():
            if len(piece) >= LEAST:
                found.append(frozenset([piece]))
        run = ""

    for op, arg in items:
        if op is K.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        close()
        if op is K.BRANCH:
            options = [_walk(branch) for branch in arg[1]]
            found.append(frozenset().union(*options) if all(options) else None)
        elif op is K.SUBPATTERN:
            found.append(_walk(arg[3]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_walk(arg[2]))
        elif op is K.ATOMIC_GROUP:
            found.append(_walk(arg))
    close()
    return _best(found)


def needed(pattern: str) -> frozenset[str] | None:
    return _walk(_parser.parse(pattern))


def needed_by_any(patterns) -> frozenset[str] | None:
    """Literals of which one is needed for any of the patterns to be found."""
    out: set[str] = set()
    for p in patterns:
        one = needed(p)
        if one is None:
            return None
        out |= one
    # a literal that holds another is tested by it
    return frozenset(x for x in out if not any(y != x and y in x for y in out))

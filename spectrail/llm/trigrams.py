"""Boolean trigram queries from regular expressions: what every match must hold, as alternatives of sets of trigrams."""

from __future__ import annotations

from re import _constants as op
from re import _parser

#: Strings that are followed at once; beyond this a part of the pattern is given up, which only weakens the query.
MOST_STRINGS = 64
#: A class of so many characters or fewer is spelled out.
MOST_CLASS = 8

#: Letters from common to rare in prose; other characters are rarer still.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"

Query = frozenset[frozenset[str]] | None


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def rarity(gram: str) -> int:
    return sum(COMMON.index(c) if c in COMMON else len(COMMON) for c in gram)


def query(pattern: str, most: int | None = None) -> list[list[str]] | None:
    """Sets of lower-case trigrams, of which each match of the pattern (lower-cased) holds one whole; None: nothing is mandatory.

    most: of a larger set only the rarest trigrams are asked for, which admits more and loses none.
    """
    strings, found = _sequence(_parser.parse(pattern))
    found = _both(found, _of(strings))
    if found is None:
        return None
    found = {frozenset(sorted(s, key=lambda g: (-rarity(g), g))[:most]) for s in _least(found)}
    return sorted(sorted(s) for s in _least(found))


def _least(sets) -> list[frozenset[str]]:
    """Without the sets that hold another one: they admit no text that the other does not."""
    return [s for s in sets if not any(o < s for o in sets)]


def _of(strings: set[str] | None) -> Query:
    """The query for one of these strings occurring."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return frozenset(trigrams(s) for s in strings)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_STRINGS:
        return a if len(a) <= len(b) else b
    return frozenset(x | y for x in a for y in b)


def _sequence(tree) -> tuple[set[str] | None, Query]:
    """(the strings it can match, if they are few, else None; the query)."""
    exact, held, found = True, {""}, None
    for code, value in tree:
        strings, own = _node(code, value)
        found = _both(found, own)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        found, held, exact = _both(found, _of(held)), {""} if strings is None else strings, False
    if exact:
        return held, found
    return None, _both(found, _of(held))


def _node(code, value) -> tuple[set[str] | None, Query]:
    if code is op.LITERAL:
        return {chr(value).lower()}, None
    if code is op.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is op.LITERAL:
                chars.add(chr(x).lower())
            elif kind is op.RANGE and x[1] - x[0] < 26:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= MOST_CLASS else (None, None)
    if code is op.SUBPATTERN:
        return _sequence(value[3])
    if code is op.BRANCH:
        parts = [_sequence(t) for t in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        queries = [_both(q, _of(s)) for s, q in parts]
        return None, None if any(q is None for q in queries) else frozenset().union(*queries)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, sub = value
        strings, own = _sequence(sub)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if strings is not None and least == most and len(strings) == 1:
            return {next(iter(strings)) * least}, None
        return None, None if least == 0 else _both(own, _of(strings))
    if code is op.AT:
        return {""}, None
    return None, None

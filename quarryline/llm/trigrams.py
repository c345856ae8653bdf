"""Boolean trigram queries derived from regular expressions.

A query is True (no mandatory trigram: scan everything), a trigram, or ("and" | "or", parts). Trigrams are
those of the lower-cased text, so one index serves rules of either case.
"""

from __future__ import annotations

from re import _constants as codes
from re import _parser as parser

#: Largest set of strings that is tracked exactly before it is turned into trigrams.
MOST_STRINGS = 64
MOST_CLASS = 8


def both(kind: str, parts: list):
    """A simplified conjunction or disjunction: flat, without repeats, and in a disjunction without absorbed parts."""
    if kind == "or" and any(p is True for p in parts):
        return True
    flat: list = []
    for p in parts:
        flat += list(p[1]) if isinstance(p, tuple) and p[0] == kind else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    if kind == "or":
        needs = {p: grams(p) for p in flat if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1])}
        flat = [p for p in flat if not (p in needs and any(n < needs[p] for q, n in needs.items() if q != p))]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[str] | None):
    """What a text must hold when it holds one of the strings."""
    if strings is None:
        return True
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is codes.LITERAL:
            out.add(chr(arg).lower())
        elif op is codes.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _node(op, arg):
    """(exact strings or None, query) of one parsed element."""
    if op is codes.LITERAL:
        return {chr(arg).lower()}, True
    if op is codes.IN:
        return _members(arg), True
    if op is codes.AT:
        return {""}, True
    if op is codes.SUBPATTERN:
        return _sequence(arg[-1])
    if op is codes.BRANCH:
        sides = [_sequence(x) for x in arg[1]]
        strings = [s for s, _ in sides]
        if None not in strings and all(q is True for _, q in sides) and len(joined := set().union(*strings)) <= MOST_STRINGS:
            return joined, True
        return None, both("or", [both("and", [of_strings(s), q]) for s, q in sides])
    if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if (least, most) == (1, 1):
            return strings, query
        if (least, most) == (0, 1) and strings is not None and query is True:
            return strings | {""}, True
        return None, both("and", [of_strings(strings), query]) if least else True
    return None, True


def _sequence(items):
    """Runs of exactly known strings are concatenated; where knowledge ends, they become trigrams."""
    strings, queries, whole = {""}, [], True
    for op, arg in items:
        more, query = _node(op, arg)
        queries.append(query)
        if more is not None and len(strings) * len(more) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in more}
            continue
        queries.append(of_strings(strings))
        whole, strings = False, more if more is not None else {""}
    if whole and all(q is True for q in queries):
        return strings, True
    return None, both("and", [*queries, of_strings(strings)])


def trigram_query(pattern: str):
    strings, query = _sequence(parser.parse(pattern))
    return both("and", [of_strings(strings), query])


def grams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(grams(p) for p in query[1]))


def holds(query, text: str) -> bool:
    """The query over one text, for tests."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(p, text) for p in query[1])


__all__ = ["grams", "holds", "trigram_query"]

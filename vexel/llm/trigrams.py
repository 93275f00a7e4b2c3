"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of conjunctions: a frozenset of frozensets of lower-case trigrams, one
of which every matching text contains in full. ``None`` means that nothing is mandatory.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product

#: Strings a part of a pattern may stand for before it counts as unknown.
MAX_STRINGS = 64
Query = frozenset[frozenset[str]] | None


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(queries: list[Query]) -> Query:
    if any(q is None for q in queries):
        return None
    return _simple(frozenset().union(*queries))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)
    return _simple(frozenset(x | y for x, y in product(a, b)))


def _simple(query: Query) -> Query:
    """Without the conjunctions that a weaker one implies."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_strings(strings: set[str]) -> Query:
    found = [grams(s) for s in strings]
    return None if not all(found) else _simple(frozenset(found))


def _class_members(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """Exact strings a sequence stands for (``None``: unknown) and its query."""
    exact: set[str] | None = {""}
    run, query, known = {""}, None, True
    for kind, value in nodes:
        strings, inner = _node(kind, value)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, known = _both(_both(query, _of_strings(run)), inner), False
        run = strings if strings is not None else {""}
    exact = run if known else None
    return exact, _both(query, _of_strings(run))


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        return _class_members(value), None
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        found = [_walk(branch) for branch in value[1]]
        exact = set().union(*[s for s, _ in found]) if all(s is not None for s, _ in found) else None
        return exact if exact is not None and len(exact) <= MAX_STRINGS else None, _either([q for _, q in found])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, body = value
        strings, query = _walk(body)
        if strings is not None and high <= 1:
            return strings | ({""} if low == 0 else set()), None
        if strings is not None and low == high and len(strings) ** low <= MAX_STRINGS:
            return {"".join(p) for p in product(strings, repeat=low)}, None
        return None, query if low else None
    return None, None


def query_of(pattern: str) -> Query:
    """The trigram query of ``pattern``; ``None`` where a match need not hold any trigram.

    >>> sorted(map(sorted, query_of("ab(cd|ce)")))
    [['abc', 'bcd'], ['abc', 'bce']]
    """
    return _walk(parser.parse(pattern))[1]

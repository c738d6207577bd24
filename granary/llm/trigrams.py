"""Boolean trigram queries from regular expressions.

A query is a set of clauses; a text can match only if it holds all trigrams of
some clause. Letters are folded to lower case, so queries hold for either
case. A clause without trigrams means that every text must be scanned.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

Query = frozenset
ALWAYS: Query = frozenset([frozenset()])
#: Limits of the sets that are kept exactly; beyond them a query is only weaker, never wrong.
MAX_STRINGS = 64
MAX_CLAUSES = 64
MAX_CLASS = 8


def trigrams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _smallest(clauses) -> Query:
    """Without clauses that another one implies."""
    kept: list[frozenset] = []
    for c in sorted(set(clauses), key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MAX_CLAUSES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _smallest(x | y for x, y in product(a, b))


def _of_strings(strings: frozenset[str]) -> Query:
    return _smallest(trigrams(s) for s in strings)


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    """The strings that the items match, if those are few, and their query."""
    run, query, exact = frozenset([""]), ALWAYS, True
    for item in items:
        strings, own = _item(*item)
        if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        exact, query = False, _both(_both(query, _of_strings(run)), own)
        run = frozenset([""])
    return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))


def _item(kind, value) -> tuple[frozenset[str] | None, Query]:
    if kind is op.LITERAL:
        strings = frozenset([chr(value).lower()])
    elif kind is op.IN and len(value) <= MAX_CLASS and all(k is op.LITERAL for k, _ in value):
        strings = frozenset(chr(v).lower() for _, v in value)
    elif kind is op.SUBPATTERN:
        return _sequence(value[3])
    elif kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MAX_STRINGS:
            strings = frozenset().union(*(s for s, _ in parts))
        else:
            return None, _smallest(c for _, q in parts for c in q)
    elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and low == high and len(strings) ** low <= MAX_STRINGS:
            strings = frozenset("".join(x) for x in product(strings, repeat=low))
        elif strings is not None and (low, high) == (0, 1):
            strings |= {""}
        else:
            return None, query if low else ALWAYS
    elif kind is op.AT:
        strings = frozenset([""])
    else:
        return None, ALWAYS
    return strings, _of_strings(strings)


def trigram_query(pattern: str) -> Query:
    return _sequence(parser.parse(pattern))[1]

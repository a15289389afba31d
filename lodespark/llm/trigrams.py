"""Boolean trigram queries: what every match of a regular expression must contain.

`query(pattern)` gives a tree of ("and", parts), ("or", parts) and trigrams, or
True when no trigram is mandatory. The text is taken in lower case, so a query
holds for either case of a letter.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

#: Sets of possible strings larger than this are turned into a query and forgotten.
MOST = 64

Query = bool | str | tuple


def both(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_string(s: str) -> Query:
    return both([s[i : i + 3] for i in range(len(s) - 2)])


def of_set(strings: set[str]) -> Query:
    return either([of_string(s) for s in sorted(strings)]) if strings else True


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 4:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return out if len(out) <= 4 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings it can match, or None; what each match must contain)."""
    strings: set[str] | None = {""}
    need: list[Query] = []
    run: set[str] = {""}  # strings that end where the walk is, since the last break

    def take(more: set[str]) -> None:
        nonlocal run
        if len(run) * len(more) > MOST:
            need.append(of_set(run))
            run = {s[-2:] for s in run}
            if len(run) * len(more) > MOST:
                need.append(of_set(more))
                run = {""}
                return
        run = {a + b for a in run for b in more}

    def break_off(query: Query) -> None:
        nonlocal run, strings
        need.extend([of_set(run), query])
        run, strings = {""}, None

    for op, value in tree:
        if op is C.LITERAL:
            exact, query = {chr(value).lower()}, True
        elif op is C.IN:
            exact, query = _class(value), True
        elif op is C.BRANCH:
            parts = [_walk(x) for x in value[1]]
            exact = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
            query = either([both([p[1], of_set(p[0]) if p[0] is not None else True]) for p in parts])
        elif op is C.SUBPATTERN:
            exact, query = _walk(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = value
            exact, query = _walk(body)
            if least == 0:
                exact, query = ({""} | exact if most == 1 and exact is not None else None), True
            elif exact is not None and not least == most == 1:
                one = exact
                exact = {s * least for s in one} if least == most and len(one) == 1 else None
                query = of_set({s * least for s in one}) if len(one) == 1 else of_set(one)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        else:
            exact, query = None, True
        if exact is None or len(exact) > MOST:
            break_off(query if exact is None else both([query, of_set(exact)]))
        else:
            take(exact)
            if strings is not None:
                strings = {a + b for a in strings for b in exact} if len(strings) * len(exact) <= MOST else None
    need.append(of_set(run))
    return strings, both(need)


def query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression."""
    return _walk(P.parse(pattern, re.ASCII))[1]


def mentioned(q: Query) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(mentioned, q[1]))

"""Literal factors of patterns: short texts of which every match holds at least one, as a cheap test before the pattern."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=512)
def factors(pattern: str) -> frozenset[str] | None:
    """Texts of which each match of the pattern holds one; None if there are none. The longest are taken."""
    parsed = re._parser.parse(pattern)
    return None if parsed.state.flags & re.IGNORECASE else _of(parsed)


def _of(items) -> frozenset[str] | None:
    found, run = [], ""

    def end():
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            end()
            found.append(_of(arg[3]))
        elif name == "BRANCH":
            end()
            each = [_of(b) for b in arg[1]]
            found.append(None if None in each else frozenset().union(*each))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0]:
            if len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                run += chr(arg[2][0][1]) * arg[0]
                end()
            else:
                end()
                found.append(_of(arg[2]))
        elif name != "AT":
            end()
    end()
    return max(filter(None, found), key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


def may_match(text: Column, patterns: list[str]) -> Column:
    """False only where none of the patterns matches the text or any part of it."""
    every = [factors(p) for p in patterns]
    if None in every:
        return F.lit(True)
    # a text that holds another one is no news
    texts = frozenset().union(*every)
    least = sorted(t for t in texts if not any(o != t and o in t for o in texts))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in least]), F.lit(False))


"""Scores of a pattern as a subsequence of a text, best alignment first.

A match gives points, more at the beginning of the text, after a separator, at an inner capital
and right after another match; opening and widening a gap costs some, as does a letter of the
other case. Case counts once the pattern has a capital.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of the matcher.
MATCH, GAP_OPEN, GAP_WIDEN = 16, -3, -1
HEAD, BREAK, CAMEL, CONSECUTIVE, OTHER_CASE, FIRST = 8, 7, 6, 4, -2, 2
_SEPARATORS = frozenset(" /\\|_-.:,;")


def score(text: str, pattern: str) -> int | None:
    """The best score of pattern in text, None if it is no subsequence; 0 for an empty pattern."""
    if not pattern:
        return 0
    exact = any(c.isupper() for c in pattern)
    same = (lambda a, b: a == b) if exact else (lambda a, b: a.lower() == b.lower())
    bonus = []
    for i, c in enumerate(text):
        before = text[i - 1] if i else ""
        bonus.append(HEAD if not i else BREAK if before in _SEPARATORS else CAMEL if c.isupper() and before.islower() else 0)
    # last[i]: the best score of the pattern so far whose last letter is matched at i
    last: list[int | None] = []
    for k, p in enumerate(pattern):
        now: list[int | None] = [None] * len(text)
        best: int | None = None  # of an earlier match and the gap after it, up to here
        for i, c in enumerate(text):
            if k and i > 1 and last[i - 2] is not None:
                opened = last[i - 2] + GAP_OPEN
                best = opened if best is None else max(best + GAP_WIDEN, opened)
            elif best is not None:
                best += GAP_WIDEN
            if not same(c, p):
                continue
            own = MATCH + bonus[i] * (FIRST if not k else 1) + (OTHER_CASE if c != p else 0)
            if not k:
                now[i] = own
                continue
            near = None if not i or last[i - 1] is None else last[i - 1] + max(CONSECUTIVE, 0)
            options = [x for x in (near, best) if x is not None]
            if options:
                now[i] = own + max(options)
        last = now
    found = [x for x in last if x is not None]
    return max(found) if found else None


def best_score(texts: Column, pattern: str) -> Column:
    """The best score over an array of texts, null if the pattern is in none."""

    @F.pandas_udf(T.LongType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: max((s for t in (ts if ts is not None else ()) if (s := score(t, pattern)) is not None), default=None)).astype("Int64")

    return run(texts)

"""Routing of contents: entropy, risky contents, guards on intents and outputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beginnings of commit subjects.
COMMIT = ("feat:", "fix:", "chore:", "docs:", "refactor:", "test:", "ci:", "style:", "perf:")
IMPLICIT_SCOPES = ("/", "~", "$HOME", "", ".")


def _has(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def commit_log(lower: Column) -> Column:
    """Whether a third of the first ten lines start like commits."""
    lines = F.transform(F.slice(F.split(lower, "\n"), 1, 10), lambda x: F.trim(x))
    votes = F.aggregate(
        lines,
        F.lit(0),
        lambda a, s: a + (s.rlike("^[0-9a-f]{7}") & (F.octet_length(s) > 8)).cast("int") + s.rlike("^(" + "|".join(COMMIT) + ")").cast("int"),
    )
    return (votes > 0) & (votes >= F.floor(F.size(lines) / 3))


def high_risk(content: Column) -> Column:
    """Stack traces, migrations, keys, credentials, legal texts, cluster secrets: all that must stay whole."""
    t = F.lower(content)
    trace = (_has(t, "panicked at", "traceback") & _has(t, "stack backtrace", "  0:", "  at ")) | (_has(t, "stack trace") & _has(t, "  at "))
    migration = _has(t, "alter table", "create table", "drop table") & _has(t, "column", "index", "constraint", "primary key", "references")
    keys = _has(t, "private_key", "secret_key", "api_key") & _has(t, "=", ":")
    passwords = _has(t, "password:", "password=", 'password "')
    legal = _has(t, "terms of service", "privacy policy", "license agreement", "gdpr")
    cluster = _has(t, "apiversion:") & _has(t, "kind:") & _has(t, "secret", "configmap")
    return trace | migration | _has(t, "-----begin") | ((keys | passwords) & ~commit_log(t)) | legal | cluster


def entropies(docs: DataFrame) -> DataFrame:
    """doc, entropy: Shannon's, in bits a byte, of (doc, content). Counted in Arrow batches: no byte becomes a row."""
    return docs.select("doc", _entropy(F.col("content")).alias("entropy"))


def _bits(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> float:
        if not t:
            return 0.0
        n = np.bincount(np.frombuffer(t.encode(), np.uint8))
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return texts.map(one).astype("float64")


def _entropy(content: Column) -> Column:
    return F.pandas_udf(_bits, T.DoubleType())(content)


def route(docs: DataFrame) -> DataFrame:
    """doc, mode: safe, aggressive or default for (doc, content)."""
    mode = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) < 100, "default").when(high_risk(F.col("content")), "safe").when(_entropy(F.col("content")) < 2.5, "aggressive").otherwise("default")
    return docs.select("doc", mode.alias("mode"))


def scope_guard(scope: Column) -> Column:
    """Whether a scope is wider than said."""
    return F.trim(scope).isin(*IMPLICIT_SCOPES)


def dispatch_guard(intent: Column, tool: Column, heavy: tuple[str, ...]) -> Column:
    """Whether a simple intent asks for a heavy tool."""
    return intent.rlike("^(explain|read|summary)") & tool.isin(*heavy)


def output_guard(text: Column, produced: Column, markers: tuple[str, ...] = ()) -> Column:
    """Whether an output is long, made nothing, and excuses itself or is very long."""
    return (produced == 0) & (F.char_length(text) > 120) & (_has(text, *markers) | (F.octet_length(text) > 200))

"""Literal search in lines, with context, for one or several patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_of(content: Column) -> Column:
    """Lines without their ends; a last empty one and carriage returns before line ends are dropped."""
    return F.transform(F.split(F.regexp_replace(content, r"\r?\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))


def grep(files: DataFrame, patterns: list[str], context: int = 2) -> DataFrame:
    """path, line (from 1), col (byte, from 1), text, before, after of the lines that hold a pattern.

    A line comes once, at its first listed pattern that occurs. The context is cut from the file's own
    lines, so no row meets another: there is no shuffle, and files without a hit end in the scan.
    """
    any_hit = reduce(lambda a, b: a | b, [F.contains("content", F.lit(p)) for p in patterns])
    rows = files.filter(any_hit).select("path", lines_of(F.col("content")).alias("lines"))
    place = lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(p)), F.octet_length(F.substring_index(t, p, 1)) + 1) for p in patterns])
    lines = F.col("lines")
    found = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("i"), place(t).cast("int").alias("col"))), lambda h: h.col.isNotNull())
    start = lambda h: F.greatest(h.i - context, F.lit(0))
    # hits are cut out inside the file's row, so that only they are copied
    cut = F.transform(found, lambda h: F.struct((h.i + 1).alias("line"), h.col.alias("col"), F.get(lines, h.i).alias("text"), F.slice(lines, start(h) + 1, h.i - start(h)).alias("before"), F.slice(lines, h.i + 2, F.lit(context)).alias("after")))
    return rows.select("path", F.explode(cut).alias("h")).select("path", "h.*")


def find_paths(files: DataFrame, text: str) -> DataFrame:
    """Files whose path holds text, case aside, each with the constant score 100."""
    return files.filter(F.contains(F.lower("path"), F.lit(text.lower()))).select("path", F.lit(100).alias("score"))

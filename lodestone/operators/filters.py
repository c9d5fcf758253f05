"""Composable file filters and the query language that compiles to them.

Filters become one boolean column; Catalyst pushes what it can to the scan. A query is
white-space separated tokens, all of which must hold: ``ext: name: path: kind: dup: after:
before: size> size>= size< size<=`` and bare words, which the name has to contain. All four
size comparisons are inclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"path": "path", "name": "name", "extension": "extension", "kind": "kind", "size": "size", "modified": "modified"}
UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def size_literal(text: str) -> int:
    """A number, whole or not, with an optional unit of 1024: 50MB, 1.5k, 7."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([BKMGT]?)(?:I?B)?", text.strip().upper())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2]])


def size_literal_strict(text: str) -> int:
    """A whole number with an optional unit b, k, m or g, held at the largest bigint."""
    m = re.fullmatch(r"(\d+)([bkmg]?)", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return min(int(m[1]) * UNITS[m[2].upper()], 2**63 - 1)


@dataclass(frozen=True)
class Custom:
    """field op value, with op of eq, contains, starts_with, ends_with, ge or le."""

    field: str
    op: str
    value: str

    def column(self) -> Column:
        if self.field not in FIELDS:
            return F.lit(False)
        text, value = F.lower(F.col(FIELDS[self.field]).cast("string")), self.value.lower()
        number = F.col(FIELDS[self.field]).cast("string").try_cast("bigint")
        asked = int(self.value) if re.fullmatch(r"\d+", self.value) else None
        made = {
            "eq": lambda: text == value,
            "contains": lambda: F.contains(text, F.lit(value)),
            "starts_with": lambda: F.startswith(text, F.lit(value)),
            "ends_with": lambda: F.endswith(text, F.lit(value)),
            "ge": lambda: F.lit(False) if asked is None else number >= asked,
            "le": lambda: F.lit(False) if asked is None else number <= asked,
        }[self.op]()
        return F.coalesce(made, F.lit(False))


ALIASES = {"prefix": "starts_with", "suffix": "ends_with"}


def parse_custom(text: str) -> Custom:
    """field:op:value; sizes may carry a unit."""
    name, op, value = text.split(":", 2)
    op = ALIASES.get(op, op)
    if op not in ("eq", "contains", "starts_with", "ends_with", "ge", "le", "gt", "lt"):
        raise ValueError(f"unknown operation {op!r}")
    if name == "size" and op in ("ge", "le", "gt", "lt"):
        n = size_literal(value) + {"gt": 1, "lt": -1}.get(op, 0)
        return Custom(name, {"gt": "ge", "lt": "le"}.get(op, op), str(n))
    return Custom(name, op, value)


@dataclass(frozen=True)
class FilterSet:
    """All of ``all``, one of ``any`` if there are any, and every custom filter."""

    all: tuple[Column, ...] = ()
    any: tuple[Column, ...] = ()
    custom: tuple[Custom, ...] = ()

    def column(self) -> Column:
        parts = [*self.all, *(c.column() for c in self.custom)]
        if self.any:
            parts.append(reduce(or_, self.any))
        return reduce(and_, parts) if parts else F.lit(True)

    def apply(self, files: DataFrame) -> DataFrame:
        return files.filter(self.column())


def ext_is(value: str) -> Column:
    return F.lower("extension") == value.lstrip(".").lower()


def contains(column: str, value: str) -> Column:
    return F.contains(F.lower(column), F.lit(value.lower()))


@dataclass
class Query:
    filters: FilterSet
    explanation: list[str] = field(default_factory=list)
    duplicates: list[str] = field(default_factory=list)


def parse(query: str) -> Query:
    made: list[Column] = []
    said: list[str] = []
    dups: list[str] = []
    for token in query.split():
        key, sep, value = token.partition(":")
        size = re.fullmatch(r"size(>=|<=|>|<)(.+)", token)
        if size:
            n = size_literal(size[2])
            made.append(F.col("size") >= n if size[1][0] == ">" else F.col("size") <= n)
            said.append(f"size {'at least' if size[1][0] == '>' else 'at most'} {n} bytes")
        elif sep and key == "ext":
            made.append(ext_is(value))
            said.append(f"extension is {value.lstrip('.').lower()}")
        elif sep and key in ("name", "path"):
            made.append(contains(key, value))
            said.append(f"{key} contains {value}")
        elif sep and key == "kind":
            made.append(F.lower("kind") == value.lower())
            said.append(f"kind is {value}")
        elif sep and key in ("after", "before"):
            made.append(F.col("modified") >= int(value) if key == "after" else F.col("modified") <= int(value))
            said.append(f"modified {key} {int(value)}")
        elif sep and key == "dup":
            if value not in ("content", "exact", "name", "same_name"):
                raise ValueError(f"unknown duplicates {value!r}")
            dups.append(value)
            said.append(f"has a duplicate by {value}")
        else:
            made.append(contains("name", token))
            said.append(f"name contains {token}")
    return Query(FilterSet(all=tuple(made)), said, dups)


def find(files: DataFrame, query: str) -> DataFrame:
    """The files that a query asks for; dup: keeps those that have a duplicate among all files."""
    from lodestone.operators import duplicates as D

    q = parse(query)
    out = q.filters.apply(files)
    for kind in q.duplicates:
        members = D.content_members(files) if kind == "content" else D.name_members(files)
        out = out.join(members.select("path"), "path", "left_semi")
    return out

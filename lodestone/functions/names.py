"""Column functions on file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and characters that some file systems refuse.
RESERVED_NAMES = ("con", "prn", "aux", "nul", "com1", "lpt1")
RESERVED_CHARACTERS = r'[<>:"/\\|?*]'


def stem(name: Column) -> Column:
    """The name before its last dot; a name that only starts with a dot is whole."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The lower-cased text after the last dot that has something before it, else ''."""
    return F.lower(F.regexp_extract(name, r"(?s).\.([^.]*)$", 1))


def first_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def separators(text: Column, mark: str = "-") -> Column:
    """Runs of blanks, underscores and hyphens become one mark; none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s_-]+", mark), F.lit(mark))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\s_-]+"), "")


def portable(name: Column) -> Column:
    """Whether common file systems take the name."""
    return ~name.rlike(RESERVED_CHARACTERS) & ~F.lower(stem(name)).isin(*RESERVED_NAMES) & ~name.rlike(r"[. ]$")


def slug(text: Column) -> Column:
    """An id: letters, digits and underscores; blanks and hyphens become one underscore; lower case."""
    kept = F.regexp_replace(F.regexp_replace(text, r"[ -]+", "_"), r"[^\p{L}\p{N}_]", "")
    return F.lower(F.trim(F.regexp_replace(kept, "_+", "_"), F.lit("_")))


def within(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of roots or below one, by whole segments."""
    found = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        found = found | (path == r) | path.startswith(r + "/")
    return found

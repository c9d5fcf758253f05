"""Keyboard layouts: texts typed with the wrong one, and the normal form of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import THAI_MARKS, collapse

#: Keys of the Latin layout and the Thai letters on them, key by key.
LATIN_KEYS = "1234567890-=qwertyuiop[]asdfghjkl;'zxcvbnm"
THAI_KEYS = "ๅ/-ภถุึคตจขชๆไำพะัูีนยอฮฝกดเ้่าสวงลทธำิุนม"


def to_thai(text: Column) -> Column:
    """What the same keys give in the Thai layout, case aside; other characters stay."""
    upper = "".join(c.upper() if c.isalpha() else "" for c in LATIN_KEYS)
    letters = "".join(t for c, t in zip(LATIN_KEYS, THAI_KEYS, strict=True) if c.isalpha())
    return F.translate(text, LATIN_KEYS + upper, THAI_KEYS + letters)


def to_latin(text: Column) -> Column:
    """The keys of Thai letters; of two keys for a letter the first in the layout."""
    first = dict(reversed(list(zip(THAI_KEYS, LATIN_KEYS, strict=True))))
    return F.translate(text, "".join(first), "".join(first.values()))


def wrong_layout(text: Column) -> Column:
    """Whether a text may be Thai typed in the Latin layout: ASCII letters alone, as all of them are Thai keys."""
    return text.rlike(r"\A[A-Za-z]+\z")


def query_forms(text: Column) -> Column:
    """The distinct forms to search for: the text itself without Thai marks, and what the other layout gives."""
    t = F.lower(collapse(text))
    plain = F.regexp_replace(t, THAI_MARKS, "")
    other = F.when(wrong_layout(t), F.regexp_replace(to_thai(t), THAI_MARKS, "")).when(t.rlike("[฀-๿]"), to_latin(t))
    return F.array_distinct(F.array_compact(F.array(plain, other)))

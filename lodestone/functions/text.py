"""Column functions on texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of personal data and what stands for them, in the order they are applied.
MASKS = (
    (r"(?i)(?<![A-Za-z0-9_])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![A-Za-z0-9_])", "[EMAIL]"),
    (r"(?<![A-Za-z0-9_])([0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])", "[IP_ADDRESS]"),
    (r"(?<![A-Za-z0-9_+])(\+66|0)[0-9]{8,9}(?![A-Za-z0-9_])", "[PHONE]"),
    (r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![A-Za-z0-9_])", "[UUID]"),
    (r"/home/[^/\s]+", "[HOME]"),
)
LATIN = r"[A-Za-zÀ-ɏḀ-ỿⱠ-Ɀ]"
#: Marks that a Thai query loses.
THAI_MARKS = "[ัิ-ฺ็-๎]"


def mask(text: Column) -> Column:
    for pattern, name in MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def collapse(text: Column) -> Column:
    """Runs of any white space become one blank; none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """NFC, collapsed blanks, Latin letters in lower case. Only texts with marks to compose leave the JVM's own functions."""
    lower = F.lower(collapse(text))
    return F.when(text.rlike(r"\A[\x00-\x7F]*\z"), lower).otherwise(F.pandas_udf(_normal_forms, T.StringType())(text))


def composed(text: Column) -> Column:
    """NFC. Texts of plain letters alone stay with the JVM."""
    return F.when(text.rlike(r"\A[\x00-\xFF]*\z"), text).otherwise(F.pandas_udf(_nfc, T.StringType())(text))


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _normal_forms(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = " ".join(unicodedata.normalize("NFC", t).split())
        return "".join(c.lower() if _latin(c) else c for c in t)

    return texts.map(one)


def _latin(c: str) -> bool:
    return "A" <= c <= "Z" or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ" or "Ⱡ" <= c <= "Ɀ"


def query_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), THAI_MARKS, "")


def terms(text: Column) -> Column:
    """White-space tokens; one of several characters with a Thai letter becomes its overlapping pairs.

    Only texts with a Thai letter are looked at word by word.
    """
    words = F.array_remove(F.split(F.trim(text), r"(?U)\s+"), "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    each = F.flatten(F.transform(words, lambda w: F.when(w.rlike("[฀-๿]") & (F.char_length(w) > 1), pairs(w)).otherwise(F.array(w))))
    return F.when(text.rlike("[฀-๿]"), each).otherwise(words)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def reference_tag(text: Column) -> Column:
    return F.concat(F.lit("§ref:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8), F.lit("§"))


def cell(text: Column) -> Column:
    """A text as one cell of a pipe table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\*~`$\[\]<>{}|^])", r"\\$1")


def unescape_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\*~`$\[\]<>{}|^])", "$1")


#: Signatures (extension, offset, bytes in hex); the first that fits names the file.
MAGIC = (
    ("png", 0, "89504E470D0A1A0A"),
    ("jpg", 0, "FFD8FF"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("webp", 8, "57454250"),
    ("pdf", 0, "255044462D"),
    ("zip", 0, "504B0304"),
    ("gz", 0, "1F8B"),
    ("7z", 0, "377ABCAF271C"),
    ("tar", 257, "7573746172"),
)
SAME_AS = {"jpeg": "jpg", "tgz": "gz", "docx": "zip", "xlsx": "zip", "pptx": "zip", "jar": "zip"}


def detected_extension(content: Column) -> Column:
    found = None
    for ext, at, magic in MAGIC:
        hit = F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic
        found = F.when(hit, ext) if found is None else found.when(hit, ext)
    return found


def integrity(content: Column, extension: Column) -> Column:
    """valid, mismatch, corrupt (empty) or unknown signature."""
    told = extension
    for a, b in SAME_AS.items():
        told = F.when(F.lower(extension) == a, b).otherwise(told)
    found = detected_extension(content)
    return F.when(F.octet_length(content) == 0, "corrupt").when(found.isNull(), "unknown").when(found == F.lower(told), "valid").otherwise("mismatch")


def binary(content: Column, first: int = 8192) -> Column:
    """Whether a zero byte is among the first bytes."""
    return F.hex(F.substring(content, 1, first)).rlike(r"^(..)*00")

#: Kinds of alerts.
ALERTS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")
#: Schemes of targets.
SCHEMES = ("file", "symbol", "search", "context")


def strip_ansi(text: Column) -> Column:
    """A terminal's text without escapes; what a carriage return overwrites is dropped."""
    plain = F.regexp_replace(text, r"\x1b(\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(\x07|\x1b\\)|[@-Z\\-_])", "")
    return F.regexp_replace(F.regexp_replace(plain, "\r\n", "\n"), "[^\n]*\r", "")


def alert(text: Column) -> Column:
    """The kind of a quoted alert such as > [!NOTE], or null."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)^\s*>?\s*\[!(" + "|".join(ALERTS) + r")\]", 1)), F.lit(""))


def target(uri: Column) -> Column:
    """struct(scheme, path) of scheme://path with a known scheme and a path, or null."""
    pattern = "^(" + "|".join(SCHEMES) + ")://(.+)$"
    return F.when(uri.rlike(pattern), F.struct(F.regexp_extract(uri, pattern, 1).alias("scheme"), F.regexp_extract(uri, pattern, 2).alias("path")))


def attribute(text: Column, name: str) -> Column:
    """The first value of name="..." in text, or ''."""
    return F.regexp_extract(text, name + '="([^"]*)"', 1)


def to_yaml(properties: Column) -> Column:
    """A map of texts as simple front matter, keys in order."""
    entries = F.array_sort(F.map_entries(properties))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n"), F.lit("\n---\n"))

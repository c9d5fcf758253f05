"""Column functions on single values: identities, dates, numbers, lists, messages, webhooks, languages."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity(content: Column) -> Column:
    """struct(hash_algorithm, digest) of a content."""
    return F.struct(F.lit("sha256").alias("hash_algorithm"), F.sha2(content.cast("binary"), 256).alias("digest"))


def hash_hex(content: Column) -> Column:
    return F.lower(F.hex(content.cast("binary")))


def verified(content: Column, checksum: Column) -> Column:
    """Whether bytes have the SHA-256 that a manifest names, case aside."""
    return F.sha2(content.cast("binary"), 256) == F.lower(checksum)


def base64_bytes(text: Column) -> Column:
    """The bytes of Base64 text, also of a data: URI and without its padding; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^data:[^,]*,", ""), r"[\s=]", "")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.when(bare.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1), F.unbase64(padded))


def base64_text(content: Column) -> Column:
    return F.regexp_replace(F.base64(content.cast("binary")), r"\s", "")


def listed(text: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def entry_terms(name: Column, aliases: Column) -> Column:
    """An entry's id and its aliases."""
    return F.array_compact(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))


def rerank_text(name: Column, description: Column, aliases: Column) -> Column:
    """What a reranker reads of an entry."""
    return F.concat_ws(" ", name, description, aliases)


def to_unix(time: Column) -> Column:
    """Whole seconds since 1970, 0 before."""
    return F.greatest(F.unix_seconds(time), F.lit(0).cast("bigint"))


def timestamp_or_epoch(text: Column) -> Column:
    """A blank timestamp becomes the epoch's."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("1970-01-01T00:00:00Z"))


def is_date(text: Column) -> Column:
    """Ten characters, digits and hyphens alone."""
    return text.rlike(r"\A[0-9-]{10}\z")


def is_datetime(start: Column, end: Column | None = None) -> Column:
    ok = F.contains(start, F.lit("T"))
    return ok if end is None else ok & (end.isNull() | F.contains(end, F.lit("T")))


def number(value: Column) -> Column:
    """Not a number is null."""
    return F.when(~F.isnan(value), value)


def missing_properties(properties: Column, required: list[str]) -> Column:
    """Names of a schema that a map lacks, in order."""
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), F.map_keys(properties)))


#: What messages of the system say, the kind of issue and what to do.
ISSUES = (
    (("permission", "access is denied", "operation not permitted"), "permission_denied", "Check file permissions or run with appropriate access privileges."),
    (("not found", "cannot find", "no such file"), "not_found", "Verify path exists and has not been moved or deleted."),
    (("used by another process", "locked", "busy"), "locked_or_busy", "Close the application currently locking this file and retry."),
    (("encoding", "invalid utf-8"), "invalid_encoding", "File contains invalid character encoding."),
)
OTHER_ISSUE = ("generic_io", "Check storage device integrity and file accessibility.")


def issue(message: Column) -> Column:
    """struct(kind, remedy) of an error message."""
    low, kind, remedy = F.lower(message), F.lit(OTHER_ISSUE[0]), F.lit(OTHER_ISSUE[1])
    for words, name, what in reversed(ISSUES):
        hit = low.rlike("|".join(words))
        kind, remedy = F.when(hit, name).otherwise(kind), F.when(hit, what).otherwise(remedy)
    return F.when(message.isNotNull(), F.struct(kind.alias("kind"), remedy.alias("remedy")))


#: Languages, their endings and how their comments begin.
LANGUAGES = {
    "rust": (("rs",), "//"),
    "python": (("py", "pyi"), "#"),
    "javascript": (("js", "jsx", "mjs", "cjs"), "//"),
    "typescript": (("ts", "tsx", "mts", "cts"), "//"),
    "go": (("go",), "//"),
    "html": (("html", "htm"), None),
    "markdown": (("md", "mdx", "markdown"), None),
    "json": (("json", "jsonc"), None),
    "yaml": (("yaml", "yml"), "#"),
    "bash": (("sh", "bash"), "#"),
    "toml": (("toml",), None),
}
#: Languages whose sources are read for definitions, and the endings that only settings know.
PARSED = ("rust", "python", "javascript", "typescript", "go", "html", "markdown")
SETTINGS_ONLY = ("pyi", "markdown")


def _by_ending(pairs: list[tuple[str, str]], ending: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.try_element_at(table, ending)


def configured_language(extension: Column) -> Column:
    """The language of an ending, with or without its dots, case aside; null if none is known."""
    return _by_ending([(e, name) for name, (ends, _) in LANGUAGES.items() for e in ends], F.lower(F.ltrim(extension, F.lit("."))))


def parsed_language(extension: Column) -> Column:
    """The language that an ending's source is parsed as; the case counts."""
    return _by_ending([(e, name) for name in PARSED for e in LANGUAGES[name][0] if e not in SETTINGS_ONLY], extension)


def comment_mark(language: Column) -> Column:
    return _by_ending([(name, mark) for name, (_, mark) in LANGUAGES.items() if mark], language)


#: Events that a webhook names.
PAGE_EVENTS = ("created", "content_updated", "properties_updated", "moved", "deleted", "undeleted")
STORE_EVENTS = ("created", "content_updated", "schema_updated", "moved", "deleted", "undeleted")
COMMENT_EVENTS = ("created", "updated", "deleted")
EVENTS = tuple(f"{k}.{e}" for k, names in (("page", PAGE_EVENTS), ("database", STORE_EVENTS), ("data_source", STORE_EVENTS), ("comment", COMMENT_EVENTS)) for e in names)


def event_kind(name: Column) -> Column:
    """The event's name if it is known, else other:name."""
    return F.when(name.isin(*EVENTS), name).otherwise(F.concat(F.lit("other:"), name))


def webhook(body: Column) -> Column:
    """struct(verification_token, kind, entity_id, entity_type, timestamp, data) of a body: a handshake first, else an event; null if neither."""
    b = F.from_json(body, "verification_token string, id string, timestamp string, type string, entity struct<id:string,type:string>, data string")
    token = b.verification_token
    event = token.isNull()
    only = lambda c: F.when(event, c)
    out = F.struct(token.alias("verification_token"), only(event_kind(b.type)).alias("kind"), only(b.entity.id).alias("entity_id"), only(b.entity.type).alias("entity_type"), only(b.timestamp).alias("timestamp"), only(b.data).alias("data"))
    return F.when(token.isNotNull() | b.type.isNotNull(), out)


@F.pandas_udf(T.BooleanType())
def _signed(token: pd.Series, body: pd.Series, header: pd.Series) -> pd.Series:
    def one(t, b, h) -> bool:
        if t is None or b is None or h is None or not h.startswith("sha256="):
            return False
        try:
            told = bytes.fromhex(h[7:])
        except ValueError:
            return False
        return hmac.compare_digest(hmac.new(t.encode(), bytes(b), hashlib.sha256).digest(), told)

    return pd.Series([one(*x) for x in zip(token, body, header, strict=True)], dtype=bool)


def signed(token: Column, body: Column, header: Column) -> Column:
    """Whether a header sha256=<hex> is the HMAC of a raw body; compared in constant time."""
    return _signed(token, body.cast("binary"), header)

"""Naming rules: which scope governs a file, what its name breaks, and the name it should have."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions.text import composed


@dataclass(frozen=True)
class Rules:
    """Settings of one profile; what is None or empty changes and checks nothing."""

    unicode: str | None = None
    case: str | None = None
    separator: str | None = None
    trim: bool = True
    control: bool = True
    replacements: tuple[tuple[str, str], ...] = ()
    shortcuts: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)
    reposition: tuple[tuple[str, str], ...] = ()
    front: str | None = None
    prefix: str | None = None
    pattern: str | None = None
    max_length: int | None = None
    max_words: int | None = None
    max_digits: int | None = None
    portable: bool = True


def expand(text: str, variables: dict[str, str]) -> str:
    """text with every {{name}} replaced, names in order."""
    for name in sorted(variables):
        text = text.replace("{{" + name + "}}", variables[name])
    return text


def replaced(text: Column, old: str, new: str) -> Column:
    """Every old, whatever its case, becomes new; $1 and the like in new are groups as in any pattern."""
    return F.regexp_replace(text, r"(?iu)\Q" + old.replace("\\E", r"\E\\E\Q") + r"\E", new) if old else text


def _by_token(stem: Column, table: dict[str, str], variables: dict[str, str]) -> Column:
    """The stem's tokens joined by blanks, those that the table names, case aside, as it says."""
    lookup = F.create_map(*[x for k in sorted(table, reverse=True) for x in (F.lit(k.lower()), F.lit(expand(table[k], variables)))]) if len({k.lower() for k in table}) == len(table) else None
    if lookup is None:
        first: dict[str, str] = {}
        for k in sorted(table):
            first.setdefault(k.lower(), table[k])
        return _by_token(stem, first, variables)
    return F.array_join(F.transform(names.tokens(stem), lambda w: F.coalesce(F.try_element_at(lookup, F.lower(w)), w)), " ")


def reposition(stem: Column, token: str, back: bool = False) -> Column:
    """The stem's tokens joined by blanks, the first that is token, case aside, moved to the front or the back."""
    parts = names.tokens(stem)
    at = F.array_position(F.transform(parts, lambda w: F.lower(w)), token.lower()).cast("int")
    one = F.slice(parts, at, F.lit(1))
    rest = F.concat(F.slice(parts, F.lit(1), at - 1), F.slice(parts, at + 1, F.size(parts)))
    return F.array_join(F.when(at > 0, F.concat(rest, one) if back else F.concat(one, rest)).otherwise(parts), " ")


def target_stem(stem: Column, rules: Rules) -> Column:
    """The chain of changes, in order: normal form, control characters, blanks, replacements, shortcuts, aliases, positions, prefix, case, separator."""
    t = stem
    if rules.unicode == "nfc":
        t = composed(t)
    if rules.control:
        t = F.regexp_replace(t, r"\p{Cc}", "")
    if rules.trim:
        t = F.trim(t)
    for a, b in rules.replacements:
        t = replaced(t, expand(a, rules.variables), expand(b, rules.variables))
    for table in (rules.shortcuts, rules.aliases):
        if table:
            t = _by_token(t, table, rules.variables)
    for token, where in rules.reposition or (((rules.front, "front"),) if rules.front else ()):
        t = reposition(t, expand(token, rules.variables), where == "back")
    if rules.prefix:
        t = F.when(~t.startswith(rules.prefix), F.concat(F.lit(rules.prefix + " "), t)).otherwise(t)
    if rules.case in ("lower", "upper"):
        t = F.lower(t) if rules.case == "lower" else F.upper(t)
    if rules.separator:
        t = names.separators(t, rules.separator)
    return t


def settings_errors(settings: dict) -> list[str]:
    """What is wrong with a profile's settings (a mapping, as read from a file)."""
    import re

    errors = []
    for key, allowed in (("unicode", ("nfc",)), ("case", ("lower", "upper", "preserve")), ("separator", ("kebab", "snake", "preserve"))):
        if settings.get(key) is not None and settings[key] not in allowed:
            errors.append(f"unsupported {key} value {settings[key]}")
    threshold = ((settings.get("similarity") or {}).get("name") or {}).get("threshold")
    if threshold is not None and not 0 <= threshold <= 1:
        errors.append(f"similarity threshold must be between 0 and 1: {threshold}")
    for key, bounds in (("length.stem", (settings.get("length") or {}).get("stem") or {}), ("words", settings.get("words") or {})):
        if None not in (bounds.get("min"), bounds.get("max")) and bounds["min"] > bounds["max"]:
            errors.append(f"{key} min cannot exceed max")
    if settings.get("stemRegex") is not None:
        try:
            re.compile(settings["stemRegex"])
        except re.error as e:
            errors.append(f"invalid stemRegex {settings['stemRegex']}: {e}")
    if any(not x or x.startswith(".") or any(c.isspace() for c in x) for x in settings.get("extensions") or ()):
        errors.append("extensions must be non-empty values without a leading dot or blank")
    return errors


def issues(name: Column, rules: Rules) -> Column:
    """The kinds of rules that a name breaks, in order."""
    stem = names.stem(name)
    parts, digits = names.tokens(stem), F.char_length(F.regexp_replace(stem, "[^0-9]", ""))
    checks = [
        (rules.unicode == "nfc", stem != composed(stem), "unicode"),
        (rules.control, stem.rlike(r"\p{Cc}"), "control_character"),
        (rules.trim, stem != F.trim(stem), "trim_whitespace"),
        (rules.prefix, ~stem.startswith(rules.prefix or ""), "prefix"),
        (rules.case == "lower", stem != F.lower(stem), "case"),
        (rules.case == "upper", stem != F.upper(stem), "case"),
        (rules.separator, stem != names.separators(stem, rules.separator or "-"), "separator"),
        (rules.pattern, ~stem.rlike(rules.pattern or ""), "stem_regex"),
        (rules.max_length is not None, F.char_length(stem) > (rules.max_length or 0), "length"),
        (rules.max_words is not None, F.size(parts) > (rules.max_words or 0), "word_count"),
        (rules.max_digits is not None, digits > (rules.max_digits or 0), "number"),
        (rules.portable, ~names.portable(name), "portability"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for on, c, k in checks if on]))


def target(name: Column, rules: Rules) -> Column:
    ext = names.extension(name)
    stem = target_stem(names.stem(name), rules)
    return F.when(ext == "", stem).otherwise(F.concat(stem, F.lit("."), ext))


def governing(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """path, profile, ambiguous: the deepest scope above a path, then the highest priority, then the first profile.

    scopes: (scope, profile, recursive, priority, exceptions array). Each path meets only the
    scopes at its own ancestors, by an equi-join; two scopes of one depth and priority are ambiguous.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("scope"), n.alias("depth")))
    rows = files.select("path", F.explode(above).alias("a")).select("path", "a.scope", "a.depth", F.size(F.split("path", "/")).alias("n"))
    met = rows.join(scopes, "scope").filter((F.col("recursive") | (F.col("depth") == F.col("n") - 1)) & ~F.exists("exceptions", lambda e: F.col("path").startswith(F.concat(e, F.lit("/"))) | (F.col("path") == e)))
    best = met.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), (-F.col("priority")).alias("p"), "profile"))).alias("s"))
    first, second = F.col("s")[0], F.get("s", F.lit(1))
    return best.select("path", first.profile.alias("profile"), F.coalesce((first.d == second.d) & (first.p == second.p), F.lit(False)).alias("ambiguous"))


def findings(files: DataFrame, rules: Rules) -> DataFrame:
    """path, issues, target, blocked of the files that break a rule; a target that some file has is blocked."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    out = files.select("path", issues(F.col("name"), rules).alias("issues"), F.concat(folder, target(F.col("name"), rules)).alias("target")).filter(F.size("issues") > 0)
    taken = files.select(F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("name")).alias("target")).distinct().withColumn("taken", F.lit(True))
    out = out.join(taken, "target", "left")
    return out.select("path", "issues", "target", F.coalesce("taken", F.lit(False)).alias("blocked"))


def ordered(found: DataFrame) -> DataFrame:
    """findings() by path, as a report lists them."""
    return found.orderBy("path")

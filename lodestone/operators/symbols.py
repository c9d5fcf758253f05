"""A source graph as one flat table: definitions, implementations, imports and references by the heads of lines.

Rows: path, line (from 1), role (definition, implementation, import, reference), kind, name, other.
Everything is a regular expression over one line of one file, chosen by the file's language, so
files are parsed where they are read; comment lines and unknown languages give nothing. Changing
the graph replaces the rows of the files that changed and shuffles nothing but their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions.values import comment_mark, parsed_language
from lodestone.operators.grep import lines_of

KEY = ["path", "line", "role", "kind", "name", "other"]
_WORD = "[A-Za-z_][A-Za-z0-9_]*"
#: Heads of definitions by language: (pattern, group of the kind or the kind itself, group of the name).
DEFINITIONS: dict[str, tuple[tuple[str, int | str, int], ...]] = {
    "rust": ((rf"(?:^|\s)(fn|struct|enum|trait|type|mod)\s+({_WORD})", 1, 2),),
    "python": ((rf"^\s*(?:async\s+)?(def|class)\s+({_WORD})", 1, 2),),
    "javascript": ((rf"(?:^|\s)(function|class)\s*\*?\s+({_WORD})", 1, 2), (rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_WORD})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_WORD})\s*=>", "function", 1)),
    "go": ((rf"^func\s+(?:\([^)]*\)\s*)?({_WORD})", "func", 1), (rf"^type\s+({_WORD})", "type", 1)),
}
DEFINITIONS["typescript"] = (*DEFINITIONS["javascript"], (rf"(?:^|\s)(interface|enum|type)\s+({_WORD})\s*[={{<]?", 1, 2))
#: Heads of imports by language: (pattern, group of the path, group of the alias or 0).
IMPORTS: dict[str, tuple[tuple[str, int, int], ...]] = {
    "rust": ((rf"^\s*(?:pub\s+)?use\s+([^;\s]+)(?:\s+as\s+({_WORD}))?", 1, 2),),
    "python": ((rf"^\s*import\s+([A-Za-z0-9_.]+)(?:\s+as\s+({_WORD}))?", 1, 2), (r"^\s*from\s+([A-Za-z0-9_.]+)\s+import", 1, 0)),
    "javascript": ((r"^\s*(?:import|export)\s[^'\"]*['\"]([^'\"]+)['\"]", 1, 0), (r"require\(['\"]([^'\"]+)['\"]\)", 1, 0)),
    "go": (((rf"^\s*(?:import\s+)?(?:({_WORD}|\.)\s+)?\"([^\"]+)\"\s*$"), 2, 1),),
}
IMPORTS["typescript"] = IMPORTS["javascript"]
#: Heads of implementations by language: (pattern, group of the type, group of what it implements or 0).
IMPLEMENTATIONS: dict[str, tuple[tuple[str, int, int], ...]] = {
    "rust": ((r"^\s*impl(?:<[^>]*>)?\s+(.+?)\s+for\s+([^{]+?)\s*\{?\s*$", 2, 1), (r"^\s*impl(?:<[^>]*>)?\s+((?:(?! for )[^{])+?)\s*\{?\s*$", 1, 0)),
    "python": ((rf"^\s*class\s+({_WORD})\s*\(([^)]*)\)", 1, 2),),
    "javascript": ((rf"(?:^|\s)class\s+({_WORD})\s+extends\s+([A-Za-z0-9_.]+)", 1, 2),),
}
IMPLEMENTATIONS["typescript"] = (*IMPLEMENTATIONS["javascript"], (rf"(?:^|\s)class\s+({_WORD})[^{{]*\simplements\s+([A-Za-z0-9_., ]+?)\s*\{{?\s*$", 1, 2))
#: Words before a parenthesis that call nothing.
NO_CALL = ("if", "for", "while", "match", "switch", "return", "fn", "def", "func", "function", "class", "catch", "and", "or", "not", "in")


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(line, pattern, k)), F.lit("")) if k else F.lit(None).cast("string")


def _row(role: str, kind: Column, name: Column, other: Column) -> Column:
    return F.when(name.isNotNull(), F.struct(F.lit(role).alias("role"), kind.alias("kind"), name.alias("name"), other.alias("other")))


def _found(line: Column, language: Column) -> Column:
    """An array of (role, kind, name, other) in a line."""
    none = F.lit(None).cast("string")
    rows = []
    for lang in DEFINITIONS:
        here = []
        for pattern, kind, k in DEFINITIONS[lang]:
            here.append(_row("definition", _group(line, pattern, kind) if isinstance(kind, int) else F.lit(kind), _group(line, pattern, k), none))
        for pattern, k, alias in IMPORTS[lang]:
            path = _group(line, pattern, k)
            here.append(_row("import", F.when(path.endswith("*"), "wildcard").otherwise("import"), path, _group(line, pattern, alias)))
        for pattern, k, of in IMPLEMENTATIONS.get(lang, ()):
            here.append(_row("implementation", F.lit("implementation"), _group(line, pattern, k), _group(line, pattern, of)))
        rows.append((lang, F.array_compact(F.array(*here))))
    heads = None
    for lang, cols in rows:
        heads = F.when(language == lang, cols) if heads is None else heads.when(language == lang, cols)
    types = F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)"), F.lit(1))
    calls = F.filter(F.regexp_extract_all(line, F.lit(r"(?<![A-Za-z0-9_])(?<!fn )(?<!def )(?<!func )(?<!function )([a-z_][A-Za-z0-9_]*)\("), F.lit(1)), lambda w: ~w.isin(*NO_CALL))
    as_rows = lambda words, kind: F.transform(F.array_distinct(words), lambda w: F.struct(F.lit("reference").alias("role"), F.lit(kind).alias("kind"), w.alias("name"), none.alias("other")))
    return F.concat(heads, as_rows(types, "type"), as_rows(calls, "call"))


def parse(files: DataFrame, largest: int = 2 << 20) -> DataFrame:
    """The graph's rows of (path, content); hidden files and those over largest bytes are left out."""
    hidden = F.exists(F.split("path", "/"), lambda s: s.startswith(".") & (F.length(s) > 1) & ~s.isin("..", "."))
    known = files.select("path", "content", parsed_language(names.extension(F.col("path"))).alias("language"))
    known = known.filter(F.col("language").isin(*DEFINITIONS) & (F.octet_length("content") <= largest) & ~hidden)
    lines = known.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("i", "text"))
    lines = lines.filter((F.trim("text") != "") & ~F.ltrim(F.col("text")).startswith(comment_mark(F.col("language"))))
    rows = lines.select("path", (F.col("i") + 1).alias("line"), F.explode(_found(F.col("text"), F.col("language"))).alias("r"))
    return rows.select("path", "line", "r.*")


def compact(graph: DataFrame) -> DataFrame:
    return graph.dropDuplicates(KEY)


def definitions(graph: DataFrame, name: str) -> DataFrame:
    return graph.filter((F.col("role") == "definition") & (F.col("name") == name))


def references(graph: DataFrame, name: str) -> DataFrame:
    return graph.filter((F.col("role") == "reference") & (F.col("name") == name))


def statistics(graph: DataFrame) -> DataFrame:
    """files, definitions, references, imports, implementations: one row."""
    of = lambda role: F.count_if(F.col("role") == role).alias(role + "s")
    return graph.agg(F.count_distinct("path").alias("files"), *map(of, ("definition", "reference", "import", "implementation")))


def change(graph: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """The graph after events (path, change): rows of every path named go, files of those not deleted are parsed again."""
    kept = graph.join(events.select("path").distinct(), "path", "left_anti")
    again = files.join(events.filter("change != 'deleted'").select("path").distinct(), "path", "left_semi")
    return compact(kept.unionByName(parse(again)))


def outline(graph: DataFrame) -> DataFrame:
    """Definitions with the line before the file's next one as their end, by path and line."""
    from pyspark.sql import Window

    following = Window.partitionBy("path").orderBy("line")
    rows = graph.filter("role = 'definition'").dropDuplicates(["path", "line"])
    return rows.select("path", "kind", "name", F.col("line").alias("first"), (F.lead("line").over(following) - 1).alias("last"))


def save(graph: DataFrame, path: str) -> None:
    graph.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, line int, role string, kind string, name string, other string").json(path)

"""What a tool server offers, as plain functions over tables: one name for each tool.

Each takes DataFrames and values and returns a DataFrame; conversions name their forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import terminal
from lodestone.operators import blocks, documents, grep, snapshots

#: Forms of prose and of tables.
PROSE = ("tagged", "markdown", "gfm", "rest")
TABLES = ("pipe", "csv")


def find_documents(files: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Markdown files (path, name, extension) whose path holds text, case aside: the first by path."""
    markdown = F.lower("extension").isin("md", "mdx", "markdown")
    return files.filter(markdown & F.contains(F.lower("path"), F.lit(text.lower()))).orderBy("path").limit(limit)


def discover(files: DataFrame, depth: int = 4, limit: int = 20) -> DataFrame:
    """Markdown files at most depth folders deep, without hidden and built ones: the first by path."""
    parts = F.split("path", "/")
    off = F.exists(parts, lambda s: s.startswith(".") | s.isin("target", "node_modules"))
    return find_documents(files.filter((F.size(parts) <= depth + 1) & ~off), "", limit)


def convert_document(docs: DataFrame, source: str, target: str) -> DataFrame:
    """doc, text of (doc, text), from one form of prose to another."""
    return blocks.write(blocks.read(docs, source), target)


def convert_table(docs: DataFrame, source: str, target: str) -> DataFrame:
    """doc, text of tables in (doc, text), from one form to the other; the first line is the header."""
    if source == "pipe":
        rows = documents.read_table(docs).select("doc", "header", "rows")
    else:
        lines = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n"), lambda x: x != "")
        cells = F.transform(lines, _csv_cells)
        rows = docs.select("doc", cells.alias("c")).filter(F.size("c") > 0).select("doc", F.get("c", F.lit(0)).alias("header"), F.slice("c", F.lit(2), F.size("c")).alias("rows"))
    write = documents.write_table if target == "pipe" else documents.csv_lines
    return rows.select("doc", write(F.col("header"), F.col("rows")).alias("text"))


def _csv_cells(line):
    """Cells of a CSV line without line ends inside cells."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def diff_document(left: DataFrame, right: DataFrame, form: str = "markdown") -> DataFrame:
    """doc, pos, op, type, content: what turns the blocks of left into those of right (doc, text), place by place."""

    def flat(docs: DataFrame) -> DataFrame:
        return blocks.read(docs, form).select("doc", "pos", "type", blocks.plain(F.col("inlines")).alias("content"))

    a, b = flat(left), flat(right)
    return documents.diff(a, b).join(b, ["doc", "pos"], "left")


def diff_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc, line, op, cells: what turns the pipe tables of left into those of right (doc, text), line by line."""

    def flat(docs: DataFrame, name: str) -> DataFrame:
        t = documents.read_table(docs)
        return t.select("doc", F.posexplode(F.concat(F.array("header"), "rows")).alias("line", name))

    j = flat(left, "a").join(flat(right, "b"), ["doc", "line"], "full_outer")
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return j.select("doc", "line", op.alias("op"), F.col("b").alias("cells")).filter("op is not null")


def platforms(spark: SparkSession) -> DataFrame:
    """form, kind of everything that a conversion reads and writes."""
    return spark.createDataFrame([*((x, "prose") for x in PROSE), *((x, "table") for x in TABLES)], "form string, kind string")


def status(files: DataFrame) -> DataFrame:
    """files, bytes, issues, ready of an inventory: one row."""
    issue = F.count_if(F.col("issue").isNotNull()) if "issue" in files.columns else F.lit(0).cast("bigint")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"), issue.alias("issues")).withColumn("ready", F.lit(True))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "filesystem_find": grep.find_paths,
    "filesystem_grep": lambda files, pattern, context=2: grep.grep(files, [pattern], context),
    "filesystem_multi_grep": grep.grep,
    "filesystem_rescan": snapshots.refresh,
    "filesystem_status": status,
    "terminal_render": terminal.replay,
    "search_documents": find_documents,
    "convert_document": convert_document,
    "convert_table": convert_table,
    "diff_document": diff_document,
    "diff_table": diff_table,
    "parse_markdown": lambda docs: blocks.read(docs, "tagged"),
    "to_markdown": lambda rows: blocks.write(rows, "tagged"),
    "convert_md_to_ir": lambda docs: blocks.read(docs, "markdown"),
    "convert_ir_to_md": lambda rows: blocks.write(rows, "markdown"),
    "list_platforms": platforms,
    "csv_to_ir": lambda docs: convert_table(docs, "csv", "pipe"),
    "ir_to_csv": lambda docs: convert_table(docs, "pipe", "csv"),
    "document_to_diagram": lambda docs: documents.mermaid(documents.diagram_edges(docs)),
}

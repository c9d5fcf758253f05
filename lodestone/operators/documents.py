"""Documents: pipe tables, CSV, front matter, Markdown blocks, outlines, differences, diagrams.

A document is rows (doc, pos, type, content), never a nested tree; most conversions are column
expressions over its lines, in order inside each row, so a document is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions.text import cell

BULLET = r"^\s*[-*+]\s+"


def table_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1))


def cells(line: Column) -> Column:
    inner = F.regexp_replace(line, r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def alignment(mark: Column) -> Column:
    left, right = mark.startswith(":"), mark.endswith(":")
    return F.when(left & right, "center").when(left, "left").when(right, "right").otherwise("none")


def read_table(docs: DataFrame) -> DataFrame:
    """doc, header, alignments, rows (array of arrays) of the pipe tables of (doc, text); ragged rows stay so."""
    rows = docs.select("doc", table_lines(F.col("text")).alias("l")).filter(F.size("l") >= 2)
    return rows.select(
        "doc",
        cells(F.col("l")[0]).alias("header"),
        F.transform(cells(F.col("l")[1]), alignment).alias("alignments"),
        F.transform(F.slice("l", F.lit(3), F.size("l")), cells).alias("rows"),
    )


def write_table(header: Column, rows: Column) -> Column:
    """A pipe table; rows are filled to the widest."""
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def aligned_table(header: Column, rows: Column) -> Column:
    """A pipe table whose columns are as wide as their widest cell, three at least."""
    every = F.concat(F.array(header), rows)
    n = F.array_max(F.transform(every, lambda r: F.size(r)))
    width = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(3), F.array_max(F.transform(every, lambda r: F.coalesce(F.octet_length(F.get(r, i)), F.lit(0))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w, i: F.rpad(F.coalesce(F.get(r, i), F.lit("")), w, F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(width, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, lambda r: line(r))), "\n")


def csv_lines(header: Column, rows: Column) -> Column:
    """The table as CSV: cells with a comma, quote or line end are quoted."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(F.concat(F.array(header), rows), lambda r: F.array_join(F.transform(r, lambda c: quoted(c)), ",")), "\n")


def read_csv(docs: DataFrame, schema: str) -> DataFrame:
    """doc, pos, row (struct of schema) of the CSV texts of (doc, text) after their headers; a ragged line fails."""
    lines = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n"), lambda x: x != "")
    rows = docs.select("doc", F.posexplode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("pos", "line"))
    return rows.select("doc", "pos", F.from_csv("line", schema, {"mode": "FAILFAST"}).alias("row"))


def front_matter(text: Column) -> Column:
    """struct(yaml, body): the block between a first line --- and the next; without one, yaml is null."""
    t = F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    pattern = r"(?s)\A---[ \t]*\n(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\n|\z)(.*)\z"
    has = t.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(t, pattern, 1)).alias("yaml"), F.when(has, F.regexp_extract(t, pattern, 2)).otherwise(t).alias("body"))


def properties(yaml: Column) -> Column:
    """map of the top-level scalars of simple front matter, as text."""
    lines = F.filter(F.split(yaml, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_ -]+:\s*\S"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^["']|["']$""", "").alias("v")))
    return F.map_from_entries(entries)


def block_type(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^#{1,6}\s"), F.concat(F.lit("heading"), F.char_length(F.regexp_extract(line, "^(#+)", 1)).cast("string")))
        .when(line.rlike(r"^\s*[-*+]\s+\[[ xX]\]\s"), "task")
        .when(line.rlike(BULLET), "bullet")
        .when(line.rlike(r"^\s*\d+[.)]\s+"), "numbered")
        .when(line.rlike(r"^>"), "quote")
        .when(line.rlike(r"^(-{3,}|\*{3,}|_{3,})\s*$"), "divider")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table_row")
        .otherwise("paragraph")
    )


def blocks(docs: DataFrame) -> DataFrame:
    """doc, pos, type, content: one block per line with text of (doc, text)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs.select("doc", F.posexplode(lines).alias("pos", "line"))
    mark = r"^\s*(#{1,6}\s+|[-*+]\s+\[[ xX]\]\s+|[-*+]\s+|\d+[.)]\s+|>\s?)"
    return rows.select("doc", "pos", block_type(F.col("line")).alias("type"), F.regexp_replace("line", mark, "").alias("content"))


def write_markdown(rows: DataFrame) -> DataFrame:
    """doc, text of blocks (doc, pos, type, content), in order; unknown types become comments."""
    c = F.col("content")
    line = (
        F.when(F.col("type").rlike("^heading"), F.concat(F.repeat(F.lit("#"), F.substring("type", 8, 1).cast("int")), F.lit(" "), c))
        .when(F.col("type") == "bullet", F.concat(F.lit("- "), c))
        .when(F.col("type") == "task", F.concat(F.lit("- [ ] "), c))
        .when(F.col("type") == "numbered", F.concat(F.lit("1. "), c))
        .when(F.col("type") == "quote", F.concat(F.lit("> "), c))
        .when(F.col("type") == "divider", F.lit("---"))
        .when(F.col("type").isin("paragraph", "table_row"), c)
        .otherwise(F.lit("<!-- unsupported block -->"))
    )
    g = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("x"))
    return g.select("doc", F.array_join(F.transform("x", lambda x: x.l), "\n").alias("text"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc, pos, op of two sets of blocks by position: update, insert or delete."""
    key = ["doc", "pos"]
    a = left.select(*key, F.struct("type", "content").alias("a"))
    b = right.select(*key, F.struct("type", "content").alias("b"))
    j = a.join(b, key, "full_outer")
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return j.select(*key, op.alias("op")).filter("op is not null")


def outline(docs: DataFrame) -> DataFrame:
    """doc, pos, level, title of the headings of (doc, html)."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]\s*>)"), F.lit(1))
    rows = docs.select("doc", F.posexplode(found).alias("pos", "h"))
    title = F.trim(F.regexp_replace(F.regexp_replace("h", r"(?s)<[^>]*>", ""), r"\s+", " "))
    return rows.select("doc", "pos", F.regexp_extract("h", "(?i)^<h([1-6])", 1).cast("int").alias("level"), title.alias("title"))


def diagram_edges(docs: DataFrame) -> DataFrame:
    """doc, pos, source, target, label of the lines of (doc, text) with an arrow."""
    rows = docs.select("doc", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("pos", "line")).filter(F.col("line").rlike("->|=>") & ~F.col("line").startswith("#"))
    parts = F.split(F.regexp_replace("line", "-->|=>|->", "\u0001"), "\u0001")
    source = F.trim(F.regexp_replace(F.trim(parts[0]), r"^[-*•]+", ""))
    to = F.trim(parts[1])
    colon, paren = F.contains(to, F.lit(":")), to.rlike(r"\(.*\)$")
    target = F.when(colon, F.trim(F.substring_index(to, ":", 1))).when(paren, F.trim(F.substring_index(to, "(", 1))).otherwise(to)
    label = F.when(colon, F.trim(F.regexp_replace(to, "^[^:]*:", ""))).when(paren, F.trim(F.regexp_extract(to, r"^[^(]*\((.*)\)$", 1)))
    return rows.select("doc", "pos", source.alias("source"), target.alias("target"), label.alias("label"))


def diagram_nodes(edges: DataFrame) -> DataFrame:
    """doc, id, label, pos: each node where it first occurs."""
    ends = edges.select("doc", (F.col("pos") * 2).alias("pos"), F.col("source").alias("label")).unionByName(edges.select("doc", (F.col("pos") * 2 + 1).alias("pos"), F.col("target").alias("label")))
    ends = ends.withColumn("id", names.slug(F.col("label"))).filter("id != ''")
    return ends.groupBy("doc", "id").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def diagram_steps(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """doc, pos, source, target, label: each new list item of (doc, text) without an arrow follows the new one before it.

    An item whose id an earlier line has, as an item or an end of an edge, is not new.
    """
    rows = docs.select("doc", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("pos", "line"))
    rows = rows.filter(F.col("line").rlike(r"^([-*•]|[0-9].*\.)") & ~F.col("line").rlike("->|=>"))
    label = F.trim(F.regexp_replace("line", r"^[-*•0-9. ]+", ""))
    steps = rows.select("doc", (F.col("pos") * 2).alias("pos"), label.alias("label"), names.slug(label).alias("id"), F.lit(True).alias("step")).filter("label != ''")
    nodes = diagram_nodes(edges).select("doc", "pos", "label", "id", F.lit(False).alias("step"))
    first = steps.unionByName(nodes).groupBy("doc", "id").agg(F.min_by(F.struct("step", "label"), "pos").alias("f"), F.min("pos").alias("pos")).filter("f.step")
    before = F.lag(F.col("f.label")).over(Window.partitionBy("doc").orderBy("pos"))
    out = first.select("doc", (F.col("pos") / 2).cast("int").alias("pos"), before.alias("source"), F.col("f.label").alias("target"), F.lit("next_step").alias("label"))
    return out.filter("source is not null")


def diagram_json(edges: DataFrame) -> DataFrame:
    """doc, text: nodes and edges of each document as JSON, an edge's key being its place from 0."""
    nodes = diagram_nodes(edges).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "label"))).alias("n"))
    lines = edges.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", names.slug(F.col("source")).alias("source"), names.slug(F.col("target")).alias("target"), "label"))).alias("e"))
    as_nodes = F.transform("n", lambda x: F.struct(x.id.alias("id"), x.label.alias("label")))
    as_edges = F.transform("e", lambda x, i: F.struct(i.alias("key"), x.source.alias("source"), x.target.alias("target"), x.label.alias("label")))
    return nodes.join(lines, "doc").select("doc", F.to_json(F.struct(as_nodes.alias("nodes"), as_edges.alias("edges"))).alias("text"))


def mermaid(edges: DataFrame) -> DataFrame:
    """doc, text: a flowchart of edges, in order."""
    arrow = F.when(F.col("label").isNotNull(), F.concat(F.lit(" -->|"), F.col("label"), F.lit("| "))).otherwise(F.lit(" --> "))
    line = F.concat(F.lit("  "), names.slug(F.col("source")), arrow, names.slug(F.col("target")))
    g = edges.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("x"))
    return g.select("doc", F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("x", lambda x: x.l), "\n")).alias("text"))


def definitions(files: DataFrame) -> DataFrame:
    """path, line, kind, name of definitions in source lines of (path, content), by their heads."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    head = r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+|async\s+|static\s+)*(fn|def|func|function|class|struct|enum|trait|interface|type|mod)\s+([A-Za-z_][A-Za-z0-9_]*)"
    out = rows.select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("line", head, 1).alias("kind"), F.regexp_extract("line", head, 2).alias("name"))
    return out.filter("name != ''")


def imports(files: DataFrame) -> DataFrame:
    """path, line, target of import lines."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    head = r"^\s*(?:pub\s+)?(?:use|import|from)\s+[\"']?([A-Za-z_@./][A-Za-z0-9_:.@/*{}, -]*)"
    return rows.select("path", (F.col("i") + 1).alias("line"), F.trim(F.regexp_extract("line", head, 1)).alias("target")).filter("target != ''")

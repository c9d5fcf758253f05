"""Queries of the block documents: texts made of the columns of part, their rows and their texts again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.session import table

#: {name} stands for a column; both Spark and the oracle fill it in.
TAGGED = """# {p_name} {color="red"}
- [x] {p_brand}
	- **{p_type}** and `{p_size}`
<callout icon="i" color="blue">
	size  {p_size}
</callout>
```sql
select {p_partkey}
```
> [{p_brand}](http://x/{p_partkey})
---
<table>
	<tr>
		<td>key</td>
		<td>*name*</td>
	</tr>
	<tr>
		<td>{p_partkey}</td>
		<td>{p_name}</td>
	</tr>
</table>
"""
MARKDOWN = """## {p_name}

First ~~{p_brand}~~ line
goes on to {p_size}.

1. one {p_partkey}
   - inner **{p_type}**
2. two

> [!TIP]
> alert {p_brand}

> quoted
> > deeper {p_size}

| key | name |
| ---: | --- |
| {p_partkey} | a\\|b |

```py
x = {p_size}
```
"""
COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _made(spark, sf, form: str):
    text = F.lit(form)
    for c in COLUMNS:
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"))


def _flat(rows):
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";")
    marks = F.array_join(F.transform("inlines", lambda r: F.concat_ws("+", r.kind, F.array_join(r.marks, "+"), r.color, r.link)), ";")
    return rows.select("doc", "pos", "parent", "type", B.plain(F.col("inlines")).alias("text"), marks.alias("runs"), attrs.alias("attrs"))


def _sql(form: str) -> str:
    """SQL that fills a form with the columns of part."""
    out = "'" + form.replace("'", "''") + "'"
    for c in COLUMNS:
        out = f"replace({out}, '{{{c}}}', CAST({c} AS VARCHAR))"
    return out


def _rows(values: list[tuple]) -> str:
    """SQL for one row per value (pos, parent, type, text, runs, attrs), texts filled in."""
    parts = []
    for pos, parent, kind, text, runs, attrs in values:
        parts.append(f"SELECT p_partkey AS doc, CAST({pos} AS INTEGER) AS pos, CAST({'NULL' if parent is None else parent} AS INTEGER) AS parent, '{kind}' AS type, {_sql(text)} AS text, {_sql(runs)} AS runs, '{attrs}' AS attrs FROM part")
    return " UNION ALL ".join(parts)


T = "text+"
TAGGED_ROWS = [
    (0, None, "heading", "{p_name}", T, "color=red;level=1"),
    (1, None, "task", "{p_brand}", T, "checked=true"),
    (2, 1, "bullet", "{p_type} and {p_size}", "text+bold;text+;text+code", ""),
    (3, None, "callout", "", "", "color=blue;icon=i"),
    (4, 3, "paragraph", "size  {p_size}", T, ""),
    (5, None, "code", "select {p_partkey}", T, "language=sql"),
    (6, None, "quote", "{p_brand}", "text++http://x/{p_partkey}", ""),
    (7, None, "page_break", "", "", ""),
    (8, None, "table", "", "", ""),
    (9, 8, "table_row", "", "", "row=header"),
    (10, 9, "table_cell", "key", T, ""),
    (11, 9, "table_cell", "name", "text+italic", ""),
    (12, 8, "table_row", "", "", "row=body"),
    (13, 12, "table_cell", "{p_partkey}", T, ""),
    (14, 12, "table_cell", "{p_name}", T, ""),
]
MARKDOWN_ROWS = [
    (0, None, "heading", "{p_name}", T, "level=2"),
    (1, None, "paragraph", "First {p_brand} line goes on to {p_size}.", "text+;text+strike;text+;soft+;text+", ""),
    (2, None, "numbered", "one {p_partkey}", T, "number=1"),
    (3, 2, "bullet", "inner {p_type}", "text+;text+bold", ""),
    (4, None, "numbered", "two", T, "number=2"),
    (5, None, "callout", "", "", "alert=tip"),
    (6, 5, "paragraph", "alert {p_brand}", T, ""),
    (7, None, "quote", "", "", ""),
    (8, 7, "paragraph", "quoted", T, ""),
    (9, 7, "quote", "", "", ""),
    (10, 9, "paragraph", "deeper {p_size}", T, ""),
    (11, None, "table", "", "", ""),
    (12, 11, "table_row", "", "", "row=header"),
    (13, 12, "table_cell", "key", T, "align=right"),
    (14, 12, "table_cell", "name", T, ""),
    (15, 11, "table_row", "", "", "row=body"),
    (16, 15, "table_cell", "{p_partkey}", T, "align=right"),
    (17, 15, "table_cell", "a|b", T, ""),
    (18, None, "code", "x = {p_size}", T, "language=py"),
]
#: The Markdown of the tagged document.
AS_MARKDOWN = """# {p_name}
- [x] {p_brand}
  - **{p_type}** and `{p_size}`
> [!NOTE]
> size  {p_size}
```sql
select {p_partkey}
```
> [{p_brand}](http://x/{p_partkey})
---
| key | *name* |
| --- | --- |
| {p_partkey} | {p_name} |"""
AS_GFM = """## {p_name}
First ~~{p_brand}~~ line
goes on to {p_size}.
1. one {p_partkey}
   - inner **{p_type}**
2. two
> [!TIP]
> alert {p_brand}
> quoted
> > deeper {p_size}
| key | name |
| ---: | --- |
| {p_partkey} | a\\|b |
```py
x = {p_size}
```"""


def _rest(spark, sf):
    rows = B.read(_made(spark, sf, TAGGED), "tagged")
    again = B.read(B.write(rows, "rest"), "rest")
    return _flat(again)


#: What REST blocks add and lose: a code's text has a run, a table tells whether its first row is a header.
REST_ROWS = [(p, a, k, t, r, "has_header=true" if k == "table" else x) for p, a, k, t, r, x in TAGGED_ROWS]
REST_ROWS[0] = (0, None, "heading", "{p_name}", T, "level=1")

QUERIES = {
    "tagged_read": lambda s, d: _flat(B.read(_made(s, d, TAGGED), "tagged")),
    "tagged_write": lambda s, d: B.write(B.read(_made(s, d, TAGGED), "tagged"), "tagged"),
    "markdown_read": lambda s, d: _flat(B.read(_made(s, d, MARKDOWN), "markdown")),
    "tagged_as_markdown": lambda s, d: B.write(B.read(_made(s, d, TAGGED), "tagged"), "markdown"),
    "markdown_as_gfm": lambda s, d: B.write(B.read(_made(s, d, MARKDOWN), "markdown"), "gfm"),
    "rest_round_trip": _rest,
    "block_order": lambda s, d: B.tree_order(B.read(_made(s, d, TAGGED), "tagged")).select("doc", "pos", "parent", "sort_order"),
    "blank_filter": lambda s, d: _flat(B.with_text(B.read(_made(s, d, TAGGED), "tagged"), B.single_blanks)).filter("type = 'paragraph'").select("doc", "pos", "text"),
}

_ORDER = {}
for _p, _parent, *_ in TAGGED_ROWS:
    _ORDER[_p] = 1 + sum(1 for q, other, *_ in TAGGED_ROWS if other == _parent and q < _p)

ORACLE = {
    "tagged_read": _rows(TAGGED_ROWS),
    "tagged_write": f"SELECT p_partkey AS doc, {_sql(TAGGED)} AS text FROM part",
    "markdown_read": _rows(MARKDOWN_ROWS),
    "tagged_as_markdown": f"SELECT p_partkey AS doc, {_sql(AS_MARKDOWN)} AS text FROM part",
    "markdown_as_gfm": f"SELECT p_partkey AS doc, {_sql(AS_GFM)} AS text FROM part",
    "rest_round_trip": _rows(REST_ROWS),
    "block_order": " UNION ALL ".join(f"SELECT p_partkey AS doc, CAST({p} AS INTEGER) AS pos, CAST({'NULL' if a is None else a} AS INTEGER) AS parent, CAST({_ORDER[p]} AS DOUBLE) AS sort_order FROM part" for p, a, *_ in TAGGED_ROWS),
    "blank_filter": f"SELECT p_partkey AS doc, CAST(4 AS INTEGER) AS pos, {_sql('size {p_size}')} AS text FROM part",
}

"""Block documents: shapes that the tables can't show."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import blocks as B


def kinds(rows):
    return [(r["parent"], r["type"]) for r in rows]


def test_containers_of_tagged_markdown():
    text = '<columns>\n\t<column>\n\t\tleft\n\t</column>\n\t<column>\n\t\t- a\n\t\t\t- b\n\t</column>\n</columns>\n<details color="red">\n<summary>more **on** it</summary>\n\tinside\n</details>\n## Head {toggle="true"}\n\tbelow\nafter\n<table_of_contents color="gray"/>\n<mention-date start="2024-01-02"/>\n<empty-block/>\n$$\nx^2\n$$\n'
    rows = B.read_tagged(text)
    assert kinds(rows) == [(None, "columns"), (0, "column"), (1, "paragraph"), (0, "column"), (3, "bullet"), (4, "bullet"), (None, "toggle"), (6, "paragraph"), (None, "toggle"), (8, "paragraph"), (None, "paragraph"), (None, "contents"), (None, "mention"), (None, "paragraph"), (None, "paragraph")]
    assert rows[14]["inlines"] == [B.run("x^2", kind="equation")]
    assert dict(rows[12]["attrs"]) == {"kind": "date", "target": "2024-01-02"}
    # a toggled heading is written as details, the rest as it was
    assert B.read_tagged(B.write_tagged(rows))[:8] == rows[:8]


def test_unclosed_and_blank():
    assert kinds(B.read_tagged("<callout>\n\ta\n```\ncode")) == [(None, "callout"), (0, "paragraph"), (0, "code")]
    assert B.read_tagged("") == B.read_tagged(" \n\t\n") == B.read_markdown("\n\n") == []


def test_inlines():
    got = [(r["kind"], r["text"], r["marks"], r["color"], r["link"]) for r in B.read_inlines('a\\*b **c** *d* ~~e~~ `f<br>g` [h](i) $`j`$<br><span color="red" underline="true">k</span> * l')]
    assert got == [
        ("text", "a*b ", [], None, None), ("text", "c", ["bold"], None, None), ("text", " ", [], None, None), ("text", "d", ["italic"], None, None), ("text", " ", [], None, None),
        ("text", "e", ["strike"], None, None), ("text", " ", [], None, None), ("text", "f\ng", ["code"], None, None), ("text", " ", [], None, None), ("text", "h", [], None, "i"),
        ("text", " ", [], None, None), ("equation", "j", [], None, None), ("break", "\n", [], None, None), ("text", "k", ["underline"], "red", None), ("text", " * l", [], None, None),
    ]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\r\n\x0b\x0c\x1c\x1d\x1e\x85  "), min_size=1))
def test_written_text_reads_back(text):
    row = {"pos": 0, "parent": None, "type": "bullet", "inlines": [B.run(text)], "attrs": []}
    got = B.read_tagged(B.write_tagged([row]))
    if text.strip():
        assert got[0]["type"] in ("bullet", "task") and "".join(r["text"] for r in got[0]["inlines"]) in text


def test_markdown_shapes():
    rows = B.read_markdown("##### deep\n\n- a\n  more\n\n  - b\n\n    para\n- [ ] c\n\n~~~\nx\n~~~\n***\nhard  \nline")
    assert kinds(rows) == [(None, "heading"), (None, "bullet"), (1, "paragraph"), (1, "bullet"), (3, "paragraph"), (None, "task"), (None, "code"), (None, "page_break"), (None, "paragraph")]
    assert dict(rows[0]["attrs"]) == {"level": "3"} and [r["kind"] for r in rows[8]["inlines"]] == ["text", "break", "text"]


def test_body_only_table_gets_an_empty_header():
    rows = B.read_tagged("<table>\n<tr>\n<td>a</td>\n</tr>\n<tr>\n<td>b</td>\n<td>c|d</td>\n</tr>\n</table>")
    for r in rows:
        r["attrs"] = [(k, "body") for k, _ in r["attrs"]]
    assert B.write_markdown(rows) == "|  |  |\n| --- | --- |\n| a |  |\n| b | c\\|d |"


def test_rest_blocks():
    page = {"results": [
        {"type": "table", "table": {"table_width": 2, "has_column_header": True}},
        {"type": "table_row", "table_row": {"cells": [[{"type": "text", "text": {"content": "h"}}], []]}},
        {"type": "table_row", "table_row": {"cells": [[{"type": "text", "text": {"content": "x"}}]]}},
        {"type": "pdf", "pdf": {"type": "external", "external": {"url": "u"}}},
        {"type": "bookmark", "bookmark": {"url": "v"}},
        {"type": "odd", "odd": {"k": 1}},
        {"type": "toggle", "toggle": {"rich_text": [{"type": "mention", "mention": {"type": "user", "user": {"id": "me"}}}], "children": [{"type": "paragraph", "paragraph": {"rich_text": []}}]}},
    ]}
    rows = B.read_rest(json.dumps(page))
    assert kinds(rows) == [(None, "table"), (0, "table_row"), (1, "table_cell"), (1, "table_cell"), (0, "table_row"), (4, "table_cell"), (None, "file"), (None, "embed"), (None, "raw"), (None, "toggle"), (9, "paragraph")]
    back = json.loads(B.write_rest(rows))
    assert [len(x["table_row"]["cells"]) for x in back[0]["table"]["children"]] == [2, 2]
    assert back[3] == page["results"][5] and back[4]["toggle"]["rich_text"] == page["results"][6]["toggle"]["rich_text"]
    # the table's short row has an empty cell more now
    assert [(r["type"], r["inlines"]) for r in B.read_rest(json.dumps(back))[10:]] == [(r["type"], r["inlines"]) for r in rows[9:]]


def test_odd_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, "# x"), ("c", "y" * 100_000)], "doc string, text string")
    rows = B.read(df, "tagged")
    assert sorted((r["doc"] or "", r["type"]) for r in rows.collect()) == [("", "heading"), ("c", "paragraph")]
    assert {r["doc"]: len(r["text"]) for r in B.write(rows, "markdown").collect()} == {None: 3, "c": 100_000}

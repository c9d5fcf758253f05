"""Block documents as flat rows, with readers and writers of tagged Markdown, Markdown, GFM and REST blocks.

A document is rows (doc, pos, parent, type, inlines, attrs): pos counts blocks in reading order,
parent is the pos of the block around, inlines are the styled runs of the block itself. Tables
are table, table_row and table_cell blocks. Grammars that nest are walked in Python, a document
at a time in Arrow batches; what looks at one block or one run is a column expression. Reading
shuffles nothing; writing groups the blocks of a document.

Defined results: a null or blank text has no blocks; a container that is never closed ends with
the text; what no rule knows is a paragraph, and an unknown REST block is kept as its JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = "struct<kind:string,text:string,marks:array<string>,color:string,link:string>"
SCHEMA = f"pos int, parent int, type string, inlines array<{RUN}>, attrs map<string,string>"
_RUN = pa.struct([("kind", pa.string()), ("text", pa.string()), ("marks", pa.list_(pa.string())), ("color", pa.string()), ("link", pa.string())])
_ROW = [("pos", pa.int32()), ("parent", pa.int32()), ("type", pa.string()), ("inlines", pa.list_(_RUN)), ("attrs", pa.map_(pa.string(), pa.string()))]

#: Characters that tagged Markdown escapes, kinds of mentions and the attribute that has their target.
SPECIAL = "\\*~`$[]<>{}|^"
MENTIONS = {"user": "url", "page": "url", "database": "url", "date": "start"}
#: Kinds of alerts in quotes.
ALERTS = ("note", "tip", "important", "warning", "caution")

_ESCAPED = re.compile(r"\\([\\*~`$\[\]<>{}|^])")
_INLINE = re.compile(
    r"(?P<esc>\\[\\*~`$\[\]<>{}|^])|(?P<br><br/?>)|\$`(?P<eq>.*?)`\$|<span(?P<at>[^>]*)>(?P<span>.*?)</span>|\*\*(?P<bold>.*?)\*\*|\*(?!\*)(?P<italic>.*?)\*"
    r"|~~(?P<strike>.*?)~~|`(?P<code>.*?)`|\[(?P<label>[^\]]*)\]\((?P<link>[^)]*)\)|<mention-(?P<who>user|page|database|date) (?:url|start)=\"(?P<target>[^\"]*)\"\s*/>",
    re.S,
)
_TAIL = re.compile(r"\s*\{([^{}]*(?:color|toggle)=[^{}]*)\}$")


def run(text: str, *marks: str, kind: str = "text", color: str | None = None, link: str | None = None) -> dict:
    return {"kind": kind, "text": text, "marks": list(marks), "color": color, "link": link}


def attribute(tag: str, name: str) -> str | None:
    m = re.search(name + r'="([^"]*)"', tag)
    return m[1] if m else None


def read_inlines(text: str) -> list[dict]:
    """Styled runs, the first rule that fits at a place; styles don't nest, escaped characters are text."""
    out: list[dict] = []
    plain: list[str] = []
    plainly = lambda s: _ESCAPED.sub(r"\1", s)

    def flush() -> None:
        if plain:
            out.append(run("".join(plain)))
            plain.clear()

    at = 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            plain.append(text[at : m.start()])
        at = m.end()
        if m["esc"]:
            plain.append(m["esc"][1])
            continue
        flush()
        g = m.groupdict()
        if m["br"]:
            out.append(run("\n", kind="break"))
        elif m["eq"] is not None:
            out.append(run(m["eq"], kind="equation"))
        elif m["who"]:
            out.append(run(m["target"], kind="mention", link=m["who"]))
        elif m["span"] is not None:
            underline = ["underline"] if attribute(m["at"], "underline") == "true" else []
            out.append(run(plainly(m["span"]), *underline, color=attribute(m["at"], "color")))
        elif m["label"] is not None:
            out.append(run(plainly(m["label"]), link=m["link"]))
        elif m["code"] is not None:
            out.append(run(m["code"].replace("<br>", "\n"), "code"))
        else:
            mark = next(k for k in ("bold", "italic", "strike") if g[k] is not None)
            out.append(run(plainly(g[mark]), mark))
    if at < len(text):
        plain.append(text[at:])
    flush()
    return out


class _Rows:
    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, parent: int | None, kind: str, inlines: list[dict] | None = None, /, **attrs: str | None) -> int:
        self.rows.append({"pos": len(self.rows), "parent": parent, "type": kind, "inlines": inlines or [], "attrs": [(k, v) for k, v in attrs.items() if v is not None]})
        return len(self.rows) - 1


# --- tagged Markdown ---

_ITEMS = ((re.compile(r"- \[([ xX])\] "), "task"), (re.compile("- "), "bullet"), (re.compile(r"[0-9]+\. "), "numbered"), (re.compile("> "), "quote"))
_HEADING = re.compile("(#{1,4}) (.*)")
_MENTION = re.compile(r'<mention-(user|page|database|date)(?:\s+(?:url|start)="([^"]*)")?\s*/>')
_CONTAINERS = {"<callout": "</callout>", "<details": "</details>", "<columns>": "</columns>", "<column>": "</column>", "<table": "</table>"}


class _Tagged(_Rows):
    """Regions of lines: a container's ends with its closing line, an item's with the last deeper line."""

    def __init__(self, text: str):
        super().__init__()
        self.lines = text.splitlines()
        self.region(0, len(self.lines), None)

    def region(self, a: int, b: int, parent: int | None) -> None:
        while a < b:
            a = self.block(a, b, parent) if self.lines[a].strip() else a + 1

    def end(self, a: int, b: int, mark: str) -> int:
        return next((k for k in range(a, b) if self.lines[k].strip() == mark), b)

    def deeper(self, a: int, b: int, tabs: int) -> int:
        while a < b and (not self.lines[a].strip() or _tabs(self.lines[a]) > tabs):
            a += 1
        return a

    def block(self, a: int, b: int, parent: int | None) -> int:
        tabs = _tabs(self.lines[a])
        line = self.lines[a][tabs:]
        if line == "<empty-block/>":
            self.add(parent, "paragraph")
            return a + 1
        if line == "---":
            self.add(parent, "page_break")
            return a + 1
        if line.startswith("```") or line.strip() == "$$":
            mark = "$$" if line[0] == "$" else "```"
            stop = self.end(a + 1, b, mark)
            body = self.lines[a + 1 : stop]
            if mark == "$$":
                self.add(parent, "paragraph", [run("\n".join(x.strip() for x in body), kind="equation")])
            else:
                indent = "\t" * tabs
                self.add(parent, "code", [run("\n".join(x.removeprefix(indent) for x in body))], language=line.strip("`").strip() or None)
            return stop + 1
        if line.startswith("<table_of_contents"):
            self.add(parent, "contents", color=attribute(line, "color"))
            return a + 1
        if m := _MENTION.fullmatch(line.strip()):
            self.add(parent, "mention", kind=m[1], target=m[2] or "")
            return a + 1
        tag = next((t for t in _CONTAINERS if line.startswith(t)), None)
        if tag:
            return self.container(tag, line, a, b, parent)
        if m := _HEADING.fullmatch(line):
            text, color, toggle = _attributes(m[2])
            if not toggle:
                self.add(parent, "heading", read_inlines(text), level=str(len(m[1])), color=color)
                return a + 1
            at = self.add(parent, "toggle", read_inlines(text), level=str(len(m[1])), color=color)
            stop = self.deeper(a + 1, b, tabs)
            self.region(a + 1, stop, at)
            return stop
        for head, kind in _ITEMS:
            if m := head.match(line):
                text, color, _ = _attributes(line[m.end() :])
                checked = str(m[1] != " ").lower() if kind == "task" else None
                at = self.add(parent, kind, read_inlines(text), checked=checked, color=color)
                stop = self.deeper(a + 1, b, tabs)
                self.region(a + 1, stop, at)
                return stop
        text, color, _ = _attributes(line)
        self.add(parent, "paragraph", read_inlines(text), color=color)
        return a + 1

    def container(self, tag: str, line: str, a: int, b: int, parent: int | None) -> int:
        stop = self.end(a + 1, b, _CONTAINERS[tag])
        if tag == "<table":
            at = self.add(parent, "table")
            row = None
            for cell in (x.strip() for x in self.lines[a + 1 : stop]):
                if cell.startswith("<tr"):
                    row = self.add(at, "table_row", row="header" if row is None else "body")
                elif row is not None and (m := re.fullmatch(r"<td[^>]*>(.*?)(?:</td>)?", cell)):
                    self.add(row, "table_cell", read_inlines(m[1]))
            return stop + 1
        first = a + 1
        if tag == "<details":
            summary = self.lines[first].strip() if first < stop else ""
            has = summary.startswith("<summary>")
            at = self.add(parent, "toggle", read_inlines(summary.removeprefix("<summary>").removesuffix("</summary>")) if has else [], color=attribute(line, "color"))
            first += has
        elif tag == "<callout":
            at = self.add(parent, "callout", icon=attribute(line, "icon"), color=attribute(line, "color"))
        else:
            at = self.add(parent, tag.strip("<>"))
        self.region(first, stop, at)
        return stop + 1


def _tabs(line: str) -> int:
    return len(line) - len(line.lstrip("\t"))


def _attributes(text: str) -> tuple[str, str | None, bool]:
    """A line without its trailing {color= toggle=}, and these."""
    m = _TAIL.search(text)
    if not m:
        return text, None, False
    return text[: m.start()], attribute(m[1], "color"), attribute(m[1], "toggle") == "true"


def read_tagged(text: str) -> list[dict]:
    return _Tagged(text).rows


# --- Markdown ---

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*")
_ATX = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*")
_RULE = re.compile(r" {0,3}([-*_])(?:\s*\1){2,}\s*")
_ITEM = re.compile(r"(\s*)([-*+]|[0-9]{1,9}[.)])(\s+)(.*)")
_TASK = re.compile(r"\[([ xX])\]\s+(.*)")
_ALERT = re.compile(r"\[!(" + "|".join(ALERTS) + r")\]\s*", re.I)
_DELIMITER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||(?<!\\)\|\s*$", "", line))]


class _Markdown(_Rows):
    def __init__(self, text: str, levels: int):
        super().__init__()
        self.levels = levels
        self.region(text.splitlines(), None)

    def region(self, lines: list[str], parent: int | None) -> None:
        k = 0
        while k < len(lines):
            k = self.block(lines, k, parent) if lines[k].strip() else k + 1

    def block(self, lines: list[str], k: int, parent: int | None) -> int:
        line = lines[k]
        if m := _FENCE.fullmatch(line):
            stop = next((i for i in range(k + 1, len(lines)) if lines[i].strip().startswith(m[1]) and not lines[i].strip().strip(m[1][0])), len(lines))
            self.add(parent, "code", [run("\n".join(lines[k + 1 : stop]))], language=m[2] or None)
            return stop + 1
        if m := _ATX.fullmatch(line):
            self.add(parent, "heading", read_inlines(m[2] or ""), level=str(min(len(m[1]), self.levels)))
            return k + 1
        if _RULE.fullmatch(line):
            self.add(parent, "page_break")
            return k + 1
        if line.lstrip().startswith(">"):
            stop = k
            while stop < len(lines) and lines[stop].lstrip().startswith(">"):
                stop += 1
            inner = [re.sub(r"^\s*> ?", "", x) for x in lines[k:stop]]
            # an alert counts in quotes of the top alone
            alert = _ALERT.match(inner[0]) if parent is None else None
            if alert:
                inner[0] = inner[0][alert.end() :]
            at = self.add(parent, "callout" if alert else "quote", alert=alert[1].lower() if alert else None)
            self.region(inner, at)
            return stop
        if "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and "|" in lines[k + 1] and _DELIMITER.fullmatch(lines[k + 1]):
            return self.table(lines, k, parent)
        if m := _ITEM.fullmatch(line):
            return self.item(m, lines, k, parent)
        stop = k + 1
        while stop < len(lines) and lines[stop].strip() and not any(p.fullmatch(lines[stop]) for p in (_FENCE, _ATX, _RULE, _ITEM)) and not lines[stop].lstrip().startswith(">"):
            stop += 1
        self.add(parent, "paragraph", self.joined(lines[k:stop]))
        return stop

    @staticmethod
    def joined(lines: list[str]) -> list[dict]:
        out: list[dict] = []
        for i, x in enumerate(lines):
            hard = x.endswith(("  ", "\\"))
            out += read_inlines(x.strip().removesuffix("\\") if hard else x.strip())
            if i + 1 < len(lines):
                out.append(run("\n" if hard else " ", kind="break" if hard else "soft"))
        return out

    def item(self, m: re.Match, lines: list[str], k: int, parent: int | None) -> int:
        kind, text, checked = "numbered" if m[2][0].isdigit() else "bullet", m[4], None
        if t := _TASK.fullmatch(text):
            kind, text, checked = "task", t[2], str(t[1] != " ").lower()
        at = self.add(parent, kind, read_inlines(text), checked=checked, number=m[2][:-1] if kind == "numbered" else None)
        inside = len(m[1].expandtabs(4)) + len(m[2]) + 1
        stop = k + 1
        while stop < len(lines):
            x = lines[stop].expandtabs(4)
            if x.strip() and len(x) - len(x.lstrip()) < inside:
                break
            stop += 1
        self.region([x.expandtabs(4)[inside:] for x in lines[k + 1 : stop]], at)
        return stop

    def table(self, lines: list[str], k: int, parent: int | None) -> int:
        at = self.add(parent, "table")
        aligns = [("center" if c.startswith(":") and c.endswith(":") else "left" if c.startswith(":") else "right" if c.endswith(":") else None) for c in _cells(lines[k + 1])]
        stop = k + 2
        while stop < len(lines) and "|" in lines[stop] and lines[stop].strip():
            stop += 1
        for n, x in enumerate([lines[k], *lines[k + 2 : stop]]):
            row = self.add(at, "table_row", row="body" if n else "header")
            for i, c in enumerate(_cells(x)):
                self.add(row, "table_cell", read_inlines(c), align=aligns[i] if i < len(aligns) else None)
        return stop


def read_markdown(text: str, levels: int = 3) -> list[dict]:
    """Blocks of Markdown with tables, tasks and alerts; headings below the level count as it."""
    return _Markdown(text, levels).rows


# --- writers ---


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def _tagged_run(r: dict) -> str:
    kind, text = r["kind"], r["text"]
    if kind != "text":
        return {"equation": f"$`{text}`$", "break": "<br>", "soft": " ", "mention": f'<mention-{r["link"]} {MENTIONS.get(r["link"], "url")}="{text}"/>'}[kind]
    out = "`" + text.replace("\n", "<br>") + "`" if "code" in r["marks"] else escape(text)
    for mark, around in (("bold", "**"), ("italic", "*"), ("strike", "~~")):
        if mark in r["marks"]:
            out = around + out + around
    if "underline" in r["marks"]:
        out = f'<span underline="true">{out}</span>'
    if r["color"]:
        out = f'<span color="{r["color"]}">{out}</span>'
    return f"[{out}]({r['link']})" if r["link"] else out


def _markdown_run(r: dict, strike: bool) -> str:
    if r["kind"] != "text":
        return {"equation": f"${r['text']}$", "break": "  \n", "soft": "\n", "mention": r["text"]}[r["kind"]]
    out = f"[{r['text']}]({r['link']})" if r["link"] else r["text"]
    for mark, around in (("code", "`"), ("italic", "*"), ("bold", "**"), *((("strike", "~~"),) if strike else ())):
        if mark in r["marks"]:
            out = around + out + around
    return out


class _Tree:
    def __init__(self, rows: list[dict]):
        self.kids: dict[int | None, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["pos"]):
            self.kids.setdefault(r["parent"], []).append({**r, "attrs": dict(r["attrs"] or {}), "inlines": r["inlines"] or []})

    def below(self, row: dict) -> list[dict]:
        return self.kids.get(row["pos"], [])


def write_tagged(rows: list[dict]) -> str:
    """Tagged Markdown of a document's blocks; numbered items count within their run of neighbours."""
    tree, out = _Tree(rows), []
    inline = lambda r: "".join(map(_tagged_run, r["inlines"]))

    def tail(a: dict) -> str:
        return f' {{color="{a["color"]}"}}' if "color" in a else ""

    def several(parent: dict | None, depth: int) -> None:
        number = 0
        for r in tree.kids.get(parent["pos"] if parent else None, []):
            number = number + 1 if r["type"] == "numbered" else 0
            one(r, depth, number)

    def one(r: dict, depth: int, number: int) -> None:
        pad, a, kind = "\t" * depth, r["attrs"], r["type"]
        put = lambda text: out.append(pad + text)
        heads = {"quote": "> ", "bullet": "- ", "numbered": f"{number}. ", "task": "- [x] " if a.get("checked") == "true" else "- [ ] "}
        if kind == "paragraph":
            put(inline(r) + tail(a) if r["inlines"] else "<empty-block/>")
        elif kind == "heading":
            put("#" * min(int(a.get("level", 1)), 4) + " " + inline(r) + tail(a))
        elif kind in heads:
            put(heads[kind] + inline(r) + tail(a))
            several(r, depth + 1)
        elif kind == "code":
            put("```" + a.get("language", ""))
            for x in "".join(i["text"] for i in r["inlines"]).splitlines():
                put(x)
            put("```")
        elif kind in ("callout", "toggle", "columns", "column"):
            tag = "details" if kind == "toggle" else kind
            put("<" + tag + "".join(f' {k}="{a[k]}"' for k in ("icon", "color") if k in a) + ">")
            if kind == "toggle":
                put(f"<summary>{inline(r)}</summary>")
            several(r, depth + 1)
            put(f"</{tag}>")
        elif kind == "table":
            put("<table>")
            for row in tree.below(r):
                put("\t<tr>")
                for c in tree.below(row):
                    put(f"\t\t<td>{inline(c)}</td>")
                put("\t</tr>")
            put("</table>")
        elif kind == "page_break":
            put("---")
        elif kind == "contents":
            put("<table_of_contents" + (f' color="{a["color"]}"' if "color" in a else "") + "/>")
        elif kind == "mention":
            put(f'<mention-{a["kind"]} {MENTIONS.get(a["kind"], "url")}="{a["target"]}"/>')

    several(None, 0)
    return "".join(x + "\n" for x in out)


def write_markdown(rows: list[dict], gfm: bool = False) -> str:
    """Markdown of a document's blocks; with gfm also struck text. Blocks without a form become comments."""
    tree = _Tree(rows)
    inline = lambda r: "".join(_markdown_run(i, gfm) for i in r["inlines"])

    def several(rows: list[dict]) -> list[str]:
        lines, number, before = [], 0, None
        for r in rows:
            number = number + 1 if r["type"] == "numbered" else 0
            if before == r["type"] and before in ("paragraph", "quote", "callout"):
                lines.append("")
            lines += one(r, number)
            before = r["type"]
        return lines

    def one(r: dict, number: int) -> list[str]:
        a, kind = r["attrs"], r["type"]
        heads = {"bullet": "- ", "numbered": f"{number}. ", "task": "- [x] " if a.get("checked") == "true" else "- [ ] "}
        if kind == "paragraph":
            return inline(r).split("\n")
        if kind == "heading":
            return ["#" * int(a.get("level", 1)) + " " + inline(r)]
        if kind in heads:
            pad = " " * (len(heads[kind]) if kind == "numbered" else 2)
            return [heads[kind] + inline(r), *(pad + x for x in several(tree.below(r)))]
        if kind in ("quote", "callout"):
            first = [f"[!{a.get('alert', 'note').upper()}]"] if kind == "callout" else []
            own = inline(r).split("\n") if r["inlines"] else []
            return [("> " + x).rstrip() if not x else "> " + x for x in (*first, *own, *several(tree.below(r)))]
        if kind == "code":
            return ["```" + a.get("language", ""), *"".join(i["text"] for i in r["inlines"]).split("\n"), "```"]
        if kind == "page_break":
            return ["---"]
        if kind == "table":
            return table(r)
        return ["<!-- unsupported block -->"]

    def table(r: dict) -> list[str]:
        body = [[(inline(c).replace("|", "\\|").replace("\n", " ").replace("\r", " "), c["attrs"].get("align")) for c in tree.below(x)] for x in tree.below(r)]
        width = max(map(len, body), default=0)
        if not width:
            return []
        named = tree.below(r)[0]["attrs"].get("row") == "header"
        head = body.pop(0) if named else []
        marks = {"left": ":---", "center": ":---:", "right": "---:"}
        fill = lambda cells: "|" + "".join(f" {cells[i][0] if i < len(cells) else ''} |" for i in range(width))
        rule = "|" + "".join(f" {marks.get(head[i][1] if i < len(head) else None, '---')} |" for i in range(width))
        return [fill(head), rule, *map(fill, body)]

    return "\n".join(several(tree.kids.get(None, [])))


# --- REST blocks ---

#: Names of blocks in the service's JSON.
REST = {"paragraph": "paragraph", "quote": "quote", "bulleted_list_item": "bullet", "numbered_list_item": "numbered", "to_do": "task", "toggle": "toggle", "callout": "callout", "code": "code", "divider": "page_break", "table": "table", "table_row": "table_row", "column_list": "columns", "column": "column", "table_of_contents": "contents"}
_TO_REST = {v: k for k, v in REST.items()}
_ANNOTATIONS = {"bold": "bold", "italic": "italic", "strikethrough": "strike", "underline": "underline", "code": "code"}


def from_rich_text(parts: list[dict]) -> list[dict]:
    out = []
    for p in parts:
        a = p.get("annotations") or {}
        color = a.get("color") if a.get("color") not in (None, "default") else None
        if p.get("type") == "equation":
            out.append(run(p["equation"]["expression"], kind="equation"))
        elif p.get("type") == "mention":
            m = p["mention"]
            value = m.get(m["type"]) or {}
            out.append(run(value.get("start") or value.get("id") or value.get("url") or "", kind="mention", link=m["type"]))
        else:
            t = p.get("text") or {}
            out.append(run(t.get("content", p.get("plain_text", "")), *[v for k, v in _ANNOTATIONS.items() if a.get(k)], color=color, link=(t.get("link") or {}).get("url")))
    return out


def to_rich_text(runs: list[dict]) -> list[dict]:
    out = []
    for r in runs:
        if r["kind"] == "equation":
            out.append({"type": "equation", "equation": {"expression": r["text"]}})
        elif r["kind"] == "mention":
            out.append({"type": "mention", "mention": {"type": r["link"], r["link"]: {"start" if r["link"] == "date" else "id": r["text"]}}})
        else:
            marks = {k: v in r["marks"] for k, v in _ANNOTATIONS.items()}
            out.append({"type": "text", "text": {"content": r["text"], "link": {"url": r["link"]} if r["link"] else None}, "annotations": {**marks, "color": r["color"] or "default"}})
    return out


class _FromRest(_Rows):
    def __init__(self, text: str):
        super().__init__()
        found = json.loads(text)
        self.region(found if isinstance(found, list) else found.get("results", found.get("children", [])), None)

    def region(self, blocks: list[dict], parent: int | None) -> None:
        # rows that follow their table instead of lying inside it belong to it
        table = None
        for b in blocks:
            inside = table if b.get("type") == "table_row" and table is not None else parent
            at = self.block(b, inside)
            table = at if b.get("type") == "table" else table if inside == table else None

    def block(self, b: dict, parent: int | None) -> int:
        name = b.get("type", "")
        body = b.get(name) if isinstance(b.get(name), dict) else {}
        children = body.get("children") or b.get("children") or []
        if name.startswith("heading_"):
            at = self.add(parent, "heading", from_rich_text(body.get("rich_text", [])), level=name[-1])
        elif name == "table_row":
            before = sum(r["parent"] == parent and r["type"] == "table_row" for r in self.rows)
            header = parent is not None and dict(self.rows[parent]["attrs"]).get("has_header") == "true" and not before
            at = self.add(parent, "table_row", row="header" if header else "body")
            for cell in body.get("cells", []):
                self.add(at, "table_cell", from_rich_text(cell))
        elif name in ("image", "video", "file", "pdf"):
            place = body.get(body.get("type", ""), {})
            at = self.add(parent, "file" if name == "pdf" else name, from_rich_text(body.get("caption", [])), url=place.get("url"), name="document.pdf" if name == "pdf" else "file" if name == "file" else None)
        elif name in ("bookmark", "embed"):
            at = self.add(parent, "embed", url=body.get("url"), provider=name)
        elif name in REST:
            icon = (body.get("icon") or {}).get("emoji")
            color = body.get("color") if body.get("color") not in (None, "default") else None
            header = str(body["has_column_header"]).lower() if "has_column_header" in body else None
            at = self.add(parent, REST[name], from_rich_text(body.get("rich_text", [])), checked=str(body["checked"]).lower() if "checked" in body else None, icon=icon, color=color, language=body.get("language"), has_header=header)
        else:
            return self.add(parent, "raw", json=json.dumps(b, ensure_ascii=False, sort_keys=True))
        self.region(children, at)
        return at


def read_rest(text: str) -> list[dict]:
    """Blocks of the service's JSON, a list or a page of results; children lie inside their blocks."""
    return _FromRest(text).rows


def write_rest(rows: list[dict]) -> str:
    """The JSON list of a document's blocks; rows of a table are filled to its width."""
    tree = _Tree(rows)

    def one(r: dict) -> dict:
        a, kind = r["attrs"], r["type"]
        if kind == "raw":
            return json.loads(a["json"])
        kids = [one(x) for x in tree.below(r)] if kind not in ("table", "table_row") else []
        body: dict = {}
        if kind == "heading":
            name = f"heading_{min(int(a.get('level', 1)), 3)}"
        elif kind == "embed":
            return {"type": a.get("provider", "embed"), a.get("provider", "embed"): {"url": a.get("url")}}
        elif kind in ("image", "video", "file"):
            return {"type": kind, kind: {"type": "external", "external": {"url": a.get("url")}, "caption": to_rich_text(r["inlines"])}}
        elif kind == "table":
            cells = [[to_rich_text(c["inlines"]) for c in tree.below(x)] for x in tree.below(r)]
            width = max(map(len, cells), default=0)
            named = bool(cells) and tree.below(r)[0]["attrs"].get("row") == "header"
            lines = [{"type": "table_row", "table_row": {"cells": c + [[]] * (width - len(c))}} for c in cells]
            return {"type": "table", "table": {"table_width": width, "has_column_header": named, "has_row_header": False, "children": lines}}
        elif kind not in _TO_REST:
            raise ValueError(f"no REST block for {kind}")
        else:
            name = _TO_REST[kind]
        if kind not in ("page_break", "columns", "column", "contents"):
            body["rich_text"] = to_rich_text(r["inlines"])
        if "checked" in a:
            body["checked"] = a["checked"] == "true"
        if kind == "code":
            body["language"] = a.get("language", "plain text")
        if kind == "callout":
            body["icon"] = {"type": "emoji", "emoji": a["icon"]} if "icon" in a else None
        if "color" in a or kind == "callout":
            body["color"] = a.get("color", "default")
        if kids:
            body["children"] = kids
        return {"type": name, name: body}

    return json.dumps([one(r) for r in tree.kids.get(None, [])], ensure_ascii=False)


# --- over tables ---

READERS: dict[str, Callable[[str], list[dict]]] = {"tagged": read_tagged, "markdown": read_markdown, "gfm": read_markdown, "rest": read_rest}
WRITERS: dict[str, Callable[[list[dict]], str]] = {"tagged": write_tagged, "markdown": write_markdown, "gfm": lambda rows: write_markdown(rows, True), "rest": write_rest}
#: Blocks of an Arrow batch on the way back, at most, but for one document's.
ROWS = 5_000


def read(docs: DataFrame, form: str) -> DataFrame:
    """doc, pos, parent, type, inlines, attrs of (doc, text) in a form of READERS."""
    reader = READERS[form]
    kind = docs.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, of = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                found = reader(text.as_py()) if (text.as_py() or "").strip() else []
                rows += found
                of += [i] * len(found)
                if len(rows) >= ROWS:
                    yield out(ids, of, rows)
                    rows, of = [], []
            yield out(ids, of, rows)

    def out(ids, of, rows) -> pa.RecordBatch:
        cols = [pa.array([r[k] for r in rows], t) for k, t in _ROW]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *cols], names=["doc", *(k for k, _ in _ROW)])

    return docs.select("doc", "text").mapInArrow(go, f"doc {kind}, {SCHEMA}")


def write(rows: DataFrame, form: str) -> DataFrame:
    """doc, text of blocks in a form of WRITERS."""
    writer = WRITERS[form]
    kind = rows.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [writer(b.as_py()) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    gathered = rows.groupBy("doc").agg(F.collect_list(F.struct("pos", "parent", "type", "inlines", "attrs")).alias("b"))
    return gathered.mapInArrow(go, f"doc {kind}, text string")


def plain(inlines: Column) -> Column:
    """The runs' text: a break is a line end, a soft one a blank."""
    return F.array_join(F.transform(inlines, lambda r: r.text), "")


def tree_order(rows: DataFrame) -> DataFrame:
    """rows with sort_order (place among its siblings, from 1) and depth attributes for a flat table of blocks."""
    siblings = Window.partitionBy("doc", "parent").orderBy(F.asc_nulls_last("pos"))
    return rows.select("*", F.when(F.col("pos").isNotNull(), F.rank().over(siblings)).cast("double").alias("sort_order"))


def single_blanks(text: Column) -> Column:
    """Text with each pair of blanks as one, in one pass: what texts that mark no word ends are cleaned by."""
    return F.replace(text, F.lit("  "), F.lit(" "))


def on_text(inlines: Column, change: Callable[[Column], Column]) -> Column:
    """inlines with the text of every plain run changed."""
    return F.transform(inlines, lambda r: F.when(r.kind == "text", r.withField("text", change(r.text))).otherwise(r))


def with_text(rows: DataFrame, change: Callable[[Column], Column], but: tuple[str, ...] = ("task", "table", "table_row", "table_cell", "columns", "column", "code")) -> DataFrame:
    """rows with the runs of text blocks changed."""
    return rows.withColumn("inlines", F.when(F.col("type").isin(*but), F.col("inlines")).otherwise(on_text(F.col("inlines"), change)))

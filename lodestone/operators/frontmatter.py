"""Typed front matter: properties with a type tag, read from and written as YAML, and as the service's JSON.

A document's properties are map<string, struct<type,value>>, value being JSON text, so that every
type has one column. The YAML is the block form that write() gives: a key, and below it type,
value or values, end and time_zone; other YAML is an error, told by its kind, never dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags of properties.
TYPES = ("title", "rich_text", "number", "select", "multi_select", "date", "checkbox", "url", "email", "custom")
VALUE = "map<string,struct<type:string,value:string>>"
_KIND = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
_KEY = re.compile(r"""(\s*)("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[{-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")


class Malformed(ValueError):
    """What a property lacks: unknown_type, missing_field, wrong_type or invalid_yaml, and where."""

    def __init__(self, kind: str, where: str):
        super().__init__(f"{kind}: {where}")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[:1] in "[{":
        try:
            return json.loads(text)
        except ValueError:
            if text[0] == "[" and text[-1] == "]":
                return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
            raise Malformed("invalid_yaml", text) from None
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?", text):
        return float(text)
    return text


def parse_yaml(text: str) -> dict:
    """Nested mappings and lists of scalars in block form."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(k: int, indent: int):
        out: dict | list | None = None
        while k < len(lines):
            line = lines[k]
            depth = len(line) - len(line.lstrip(" "))
            item = line.lstrip(" ")
            if depth < indent:
                break
            if item == "-" or item.startswith("- "):
                out = [] if out is None else out
                if not isinstance(out, list):
                    break
                out.append(_scalar(item[1:]))
                k += 1
                continue
            if isinstance(out, list):
                break
            m = _KEY.fullmatch(line)
            if not m or depth > indent:
                raise Malformed("invalid_yaml", item)
            out = {} if out is None else out
            name = _scalar(m[2])
            if m[3] is not None and m[3].strip():
                out[str(name)] = _scalar(m[3])
                k += 1
                continue
            k += 1
            inner = len(lines[k]) - len(lines[k].lstrip(" ")) if k < len(lines) else 0
            if k < len(lines) and (inner > depth or inner == depth and lines[k].lstrip(" ").startswith("- ")):
                out[str(name)], k = block(k, inner)
            else:
                out[str(name)] = None
        return out, k

    found, k = block(0, 0)
    if k < len(lines) or not isinstance(found, (dict, type(None))):
        raise Malformed("invalid_yaml", lines[min(k, len(lines) - 1)])
    return found or {}


def decode(name: str, entry) -> tuple[str, object]:
    """(type, value) of one property's mapping."""
    if not isinstance(entry, dict):
        raise Malformed("wrong_type", name)
    if "type" not in entry:
        raise Malformed("missing_field", f"{name}.type")
    kind = entry["type"]
    if not isinstance(kind, str):
        raise Malformed("wrong_type", f"{name}.type")
    if kind not in TYPES:
        raise Malformed("unknown_type", kind)
    where = "values" if kind == "multi_select" else "value"
    value = entry.get(where)
    if kind in ("title", "rich_text", "number", "multi_select", "checkbox") and where not in entry:
        raise Malformed("missing_field", f"{name}.{where}")
    optional = {"select", "url", "email", "date"}
    good = {
        "title": isinstance(value, str),
        "rich_text": isinstance(value, str),
        "number": value is None or isinstance(value, (int, float)) and not isinstance(value, bool) or isinstance(value, str) and _number(value) is not None,
        "multi_select": isinstance(value, list) and all(isinstance(x, str) for x in value),
        "checkbox": isinstance(value, bool),
        "custom": True,
    }.get(kind, value is None or isinstance(value, str) if kind in optional else False)
    if not good:
        raise Malformed("wrong_type", f"{name}.{where}")
    if kind == "number" and value is not None:
        value = _number(value)
    if kind == "date" and value is not None:
        more = {}
        for k in ("end", "time_zone"):
            if entry.get(k) is not None:
                if not isinstance(entry[k], str):
                    raise Malformed("wrong_type", f"{name}.{k}")
                more[k] = entry[k]
        value = {"start": value, **more}
    return kind, value


def _number(value) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _written(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    plain = re.fullmatch(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`][^\n\r#:\"\\]*", value) and value == value.strip() and _scalar(value) == value
    return value if plain else json.dumps(value, ensure_ascii=False)


def write_yaml(properties: dict[str, tuple[str, object]]) -> str:
    """The properties as YAML, keys in order; '' without any."""
    out = []
    for name in sorted(properties):
        kind, value = properties[name]
        out += [f"{_written(name)}:", f"  type: {kind}"]
        if kind == "multi_select":
            out += ["  values:", *(f"  - {_written(x)}" for x in value)] if value else ["  values: []"]
        elif kind == "date" and value is not None:
            out += [f"  value: {_written(value['start'])}", *(f"  {k}: {_written(value[k])}" for k in ("end", "time_zone") if k in value)]
        else:
            out.append(f"  value: {_written(value)}")
    return "".join(x + "\n" for x in out)


#: How the service's JSON holds a value.
def to_json(kind: str, value) -> dict:
    """One property as the service's JSON."""
    if kind in ("title", "rich_text"):
        return {kind: [{"type": "text", "text": {"content": value}}] if value else []}
    if kind == "select":
        return {kind: None if value is None else {"name": value}}
    if kind == "multi_select":
        return {kind: [{"name": x} for x in value]}
    if kind == "custom":
        return value if isinstance(value, dict) else {"custom": value}
    return {kind: value}


def from_json(value: dict) -> tuple[str, object]:
    """(type, value) of the service's JSON; kinds that no tag has are custom."""
    kind = value.get("type") or next((k for k in value if k in TYPES), None)
    body = value.get(kind) if kind else None
    if kind in ("title", "rich_text"):
        return kind, "".join(x.get("plain_text") or (x.get("text") or {}).get("content", "") for x in body or [])
    if kind == "select":
        return kind, body and body.get("name")
    if kind == "multi_select":
        return kind, [x["name"] for x in body or []]
    if kind == "date":
        return kind, body and {k: v for k, v in body.items() if v is not None and k in ("start", "end", "time_zone")}
    if kind in ("number", "checkbox", "url", "email"):
        return kind, body
    return "custom", value


def read(docs: DataFrame) -> DataFrame:
    """doc, properties, error of (doc, yaml): a malformed mapping has no properties and tells its error."""
    kind = docs.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for y in batch.column(1).to_pylist():
                try:
                    decoded = [(k, decode(k, v)) for k, v in parse_yaml(y or "").items()]
                    found.append([(k, {"type": t, "value": json.dumps(v, ensure_ascii=False, sort_keys=True)}) for k, (t, v) in decoded])
                    errors.append(None)
                except (Malformed, ValueError) as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _KIND), pa.array(errors, pa.string())], names=["doc", "properties", "error"])

    return docs.select("doc", "yaml").mapInArrow(go, f"doc {kind}, properties {VALUE}, error string")


def write(docs: DataFrame, form: str = "yaml") -> DataFrame:
    """doc, text of (doc, properties): YAML, or the service's JSON."""
    kind = docs.schema["doc"].dataType.simpleString()

    def one(properties) -> str:
        p = {k: (v["type"], json.loads(v["value"])) for k, v in properties or []}
        return write_yaml(p) if form == "yaml" else json.dumps({k: to_json(*p[k]) for k in sorted(p)}, ensure_ascii=False)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(p) for p in batch.column(1).to_pylist()], pa.string())], names=["doc", "text"])

    return docs.select("doc", "properties").mapInArrow(go, f"doc {kind}, text string")

"""Word documents: text blocks of their paragraphs, and paragraphs of text blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import _ROW, SCHEMA, run

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def read_bytes(content: bytes) -> list[dict]:
    """A paragraph block for every paragraph with text, its runs with their marks; ends are trimmed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    for p in body.findall(f"{_W}p"):
        runs = []
        for r in p.iter(f"{_W}r"):
            text = "".join("\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else t.text or "" for t in r if t.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))
            props = r.find(f"{_W}rPr")
            marks = [name for name, tag in (("bold", "b"), ("italic", "i"), ("strike", "strike")) if props is not None and props.find(_W + tag) is not None]
            if text:
                runs.append(run(text, *marks))
        if "".join(r["text"] for r in runs).strip():
            runs[0]["text"], runs[-1]["text"] = runs[0]["text"].lstrip(), runs[-1]["text"].rstrip() if len(runs) > 1 else runs[-1]["text"].strip()
            out.append({"pos": len(out), "parent": None, "type": "paragraph", "inlines": runs, "attrs": []})
    return out


def write_bytes(rows: list[dict]) -> bytes:
    """A Word document of the paragraphs and headings (bold) of a document's blocks; other blocks are left out."""
    parts = []
    for r in sorted(rows, key=lambda r: r["pos"]):
        if r["type"] not in ("paragraph", "heading"):
            continue
        runs = []
        for i in r["inlines"] or []:
            marks = "".join(tag for name, tag in (("bold", "<w:b/>"), ("italic", "<w:i/>")) if name in i["marks"] or name == "bold" and r["type"] == "heading")
            runs.append(f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(i["text"])}</w:t></w:r>')
        parts.append(f"<w:p>{''.join(runs)}</w:p>")
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", body)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read(docs: DataFrame) -> DataFrame:
    """doc, error and blocks of (doc, content); what is no Word document has one row with its error."""
    kind = docs.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in enumerate(batch.column(1)):
                try:
                    rows, error = read_bytes(c.as_py() or b""), None
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                n = max(len(rows), error is not None)
                cols = [pa.array([r[k] for r in rows] or [None] * n, t) for k, t in _ROW]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n, pa.int64())), *cols, pa.array([error] * n, pa.string())], names=["doc", *(k for k, _ in _ROW), "error"])

    return docs.select("doc", "content").mapInArrow(go, f"doc {kind}, {SCHEMA}, error string")


def write(rows: DataFrame) -> DataFrame:
    """doc, content of blocks."""
    kind = rows.schema["doc"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_bytes(b.as_py()) for b in batch.column(1)], pa.binary())], names=["doc", "content"])

    return rows.groupBy("doc").agg(F.collect_list(F.struct("pos", "parent", "type", "inlines", "attrs")).alias("b")).mapInArrow(go, f"doc {kind}, content binary")

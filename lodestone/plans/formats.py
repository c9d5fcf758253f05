"""Queries of typed front matter, Word documents, recorded terminals and diagrams of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import terminal as T
from lodestone.operators import blocks as B
from lodestone.operators import documents as D
from lodestone.operators import frontmatter as M
from lodestone.plans.blocks import _made, _sql
from lodestone.session import table
from lodestone.sources import docx

#: {name} stands for a column of part.
YAML = """done:
  type: checkbox
  value: true
due:
  type: date
  value: 2024-01-02
  end: 2024-02-03
  time_zone: UTC
link:
  type: url
  value: null
size:
  type: number
  value: {p_size}
tags:
  type: multi_select
  values:
  - {p_type}
  - "a: b"
title:
  type: title
  value: {p_name}
"""
VALUES = {"done": ("checkbox", "true"), "due": ("date", '{"end": "2024-02-03", "start": "2024-01-02", "time_zone": "UTC"}'), "link": ("url", "null"), "size": ("number", "{p_size}.0"), "tags": ("multi_select", '["{p_type}", "a: b"]'), "title": ("title", '"{p_name}"')}
JSON = '{"done": {"checkbox": true}, "due": {"date": {"end": "2024-02-03", "start": "2024-01-02", "time_zone": "UTC"}}, "link": {"url": null}, "size": {"number": {p_size}.0}, "tags": {"multi_select": [{"name": "{p_type}"}, {"name": "a: b"}]}, "title": {"title": [{"type": "text", "text": {"content": "{p_name}"}}]}}'
SCREEN = "\x1b[31m{p_name}\x1b[0m\r\nfirst\rlast {p_size}\n\x1b[2Clate\x1b[1A\x1b[1Gre\b\bX\n\n"
STEPS = "# Flow\nstart -> {p_brand}\n- {p_name}\n1. second {p_size}\n* {p_name}\n- start\n- third\n"


def _properties(spark, sf):
    broken = F.when(F.col("doc") % 5 == 0, F.replace("text", F.lit("type: url"), F.lit("type: uri"))).when(F.col("doc") % 5 == 1, F.replace("text", F.lit("  value: true\n"), F.lit(""))).otherwise(F.col("text"))
    return M.read(_made(spark, sf, YAML).select("doc", broken.alias("yaml")))


def _flat(spark, sf):
    rows = _properties(spark, sf)
    return rows.select("doc", "error", F.explode_outer("properties").alias("name", "v")).select("doc", "error", "name", "v.type", "v.value")


def _good(spark, sf):
    return M.read(_made(spark, sf, YAML).withColumnRenamed("text", "yaml"))


def _words(spark, sf):
    rows = B.read(_made(spark, sf, "# {p_name}\n**{p_type}** & *{p_brand}*<br>x\n- left out\nlast {p_size}\n"), "tagged")
    back = docx.read(docx.write(rows))
    return back.select("doc", "pos", B.plain(F.col("inlines")).alias("text"), F.array_join(F.transform("inlines", lambda r: F.array_join(r.marks, "+")), ";").alias("marks"))


def _recordings(spark, sf):
    return T.replay(_made(spark, sf, SCREEN).select("doc", F.col("text").cast("binary").alias("content")), rows=3, cols=60).select("doc", "screen", F.array_join("history", "|").alias("history"), "truncated")


def _steps(spark, sf):
    docs = _made(spark, sf, STEPS)
    return D.diagram_steps(docs, D.diagram_edges(docs))


def _graph_json(spark, sf):
    docs = _made(spark, sf, STEPS)
    return D.diagram_json(D.diagram_edges(docs))


QUERIES = {
    "typed_properties": _flat,
    "properties_yaml": lambda s, d: M.write(_good(s, d)),
    "properties_json": lambda s, d: M.write(_good(s, d), "json"),
    "word_round_trip": _words,
    "terminal_replay": _recordings,
    "diagram_steps": _steps,
    "diagram_json": _graph_json,
}

_V = " UNION ALL ".join(f"SELECT p_partkey AS doc, CAST(NULL AS VARCHAR) AS error, '{k}' AS name, '{t}' AS type, {_sql(v)} AS value FROM part WHERE p_partkey % 5 > 1" for k, (t, v) in VALUES.items())
_E = " UNION ALL ".join(f"SELECT p_partkey, '{e}', NULL, NULL, NULL FROM part WHERE p_partkey % 5 = {k}" for k, e in ((0, "unknown_type: uri"), (1, "missing_field: done.value")))
_WORDS = " UNION ALL ".join(f"SELECT p_partkey AS doc, CAST({k} AS INTEGER) AS pos, {_sql(t)} AS text, '{m}' AS marks FROM part" for k, t, m in ((0, "{p_name}", "bold"), (1, "{p_type} & {p_brand}\nx", "bold;;italic;;"), (2, "last {p_size}", "")))

ORACLE = {
    "typed_properties": f"{_V} UNION ALL {_E}",
    "properties_yaml": f"SELECT p_partkey AS doc, {_sql(YAML.replace('{p_size}', '{p_size}.0'))} AS text FROM part",
    "properties_json": f"SELECT p_partkey AS doc, {_sql(JSON)} AS text FROM part",
    "word_round_trip": _WORDS,
    "terminal_replay": """SELECT p_partkey AS doc, 'Xest ' || p_size || chr(10) || '  late' AS screen, p_name AS history, false AS truncated FROM part""",
    "diagram_steps": """SELECT p_partkey AS doc, CAST(3 AS INTEGER) AS pos, p_name AS source, 'second ' || p_size AS target, 'next_step' AS label FROM part
      UNION ALL SELECT p_partkey, 6, 'second ' || p_size, 'third', 'next_step' FROM part""",
    "diagram_json": """SELECT p_partkey AS doc, '{"nodes":[{"id":"start","label":"start"},{"id":"' || lower(regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g')) || '","label":"' || p_brand || '"}],"edges":[{"key":0,"source":"start","target":"'
      || lower(regexp_replace(p_brand, '[^A-Za-z0-9_]', '', 'g')) || '"}]}' AS text FROM part""",
}

"""Queries of the tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import files as S
from lodestone.operators import tools as T
from lodestone.plans.blocks import _made, _sql
from lodestone.plans.files import DOCS
from lodestone.session import table

CSV = 'name,brand\n"{p_name}, new","say ""{p_size}"""\n{p_type},\n'
PIPE = "| name | brand |\n| --- | --- |\n| {p_name}, new | say \"{p_size}\" |\n| {p_type} |  |"
LEFT = "# {p_name}\nsame\n\n- {p_size}\n- gone\n"
RIGHT = "# {p_brand}\nsame\n\n- {p_size}\n"


def _documents(spark, sf):
    d = S.of_documents(spark, sf).withColumn("extension", F.when(F.col("extension") == "en", "md").otherwise(F.col("extension")))
    return T.TOOLS["search_documents"](d, "SRC1", 7).select("path", "extension")


def _tables(spark, sf):
    left = _made(spark, sf, "| a | b |\n| --- | --- |\n| {p_name} | 1 |\n| x | {p_size} |")
    right = _made(spark, sf, "| a | b |\n| --- | --- |\n| {p_brand} | 1 |\n| x | {p_size} |\n| more | 2 |").filter("doc % 2 = 0")
    return T.TOOLS["diff_table"](left, right).select("doc", "line", "op", F.array_join("cells", "|").alias("cells"))


QUERIES = {
    "tool_find_documents": _documents,
    "tool_csv_to_pipe": lambda s, d: T.TOOLS["csv_to_ir"](_made(s, d, CSV)),
    "tool_pipe_to_csv": lambda s, d: T.TOOLS["ir_to_csv"](_made(s, d, PIPE)),
    "tool_convert_document": lambda s, d: T.TOOLS["convert_document"](_made(s, d, "# {p_name}\n1. **{p_type}**\n"), "markdown", "tagged"),
    "tool_diff_document": lambda s, d: T.TOOLS["diff_document"](_made(s, d, LEFT), _made(s, d, RIGHT)),
    "tool_diff_table": _tables,
    "tool_status": lambda s, d: T.TOOLS["filesystem_status"](S.of_parts(s, d)),
    "tool_platforms": lambda s, d: T.TOOLS["list_platforms"](s),
}
ORACLE = {
    "tool_find_documents": f"SELECT path, 'md' AS extension FROM {DOCS} WHERE extension = 'en' AND lower(path) LIKE '%src1%' ORDER BY path LIMIT 7",
    "tool_csv_to_pipe": f"SELECT p_partkey AS doc, {_sql(PIPE)} AS text FROM part",
    "tool_pipe_to_csv": f"SELECT p_partkey AS doc, {_sql(CSV[:-1])} AS text FROM part",
    "tool_convert_document": f"SELECT p_partkey AS doc, {_sql('# {p_name}' + chr(10) + '1. **{p_type}**' + chr(10))} AS text FROM part",
    "tool_diff_document": """SELECT p_partkey AS doc, CAST(0 AS INTEGER) AS pos, 'update' AS op, 'heading' AS type, p_brand AS content FROM part UNION ALL SELECT p_partkey, 3, 'delete', NULL, NULL FROM part""",
    "tool_diff_table": """SELECT p_partkey AS doc, CAST(1 AS INTEGER) AS line, 'update' AS op, p_brand || '|1' AS cells FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 3, 'insert', 'more|2' FROM part WHERE p_partkey % 2 = 0
      UNION ALL SELECT p_partkey, l, 'delete', NULL FROM part, (VALUES (0), (1), (2)) v(l) WHERE p_partkey % 2 = 1""",
    "tool_status": "SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS issues, true AS ready FROM part",
    "tool_platforms": "SELECT * FROM (VALUES ('tagged', 'prose'), ('markdown', 'prose'), ('gfm', 'prose'), ('rest', 'prose'), ('pipe', 'table'), ('csv', 'table')) v(form, kind)",
}

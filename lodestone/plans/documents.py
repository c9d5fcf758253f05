"""Queries of naming and document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import documents as D
from lodestone.operators import files as S
from lodestone.operators import naming as N
from lodestone.session import table

RULES = N.Rules(case="upper", separator="_", replacements=(("green", "verdant"),), shortcuts={"gear": "cog"}, prefix="P", pattern="^[a-z ]+$", max_length=12, max_words=1)


def _scopes(spark):
    rows = [("src1", "one", True, 1, []), ("src2", "two", True, 0, ["src2/2.en"]), ("src2", "deux", True, 0, []), ("src3", "three", False, 5, [])]
    return spark.createDataFrame(rows, "scope string, profile string, recursive boolean, priority int, exceptions array<string>")


def _tables(spark, sf):
    p = table(spark, sf, "part")
    row = F.concat(F.lit("| "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" |"))
    return p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit("intro\n| name | brand |\n| :--- | ---: |\n"), row, F.lit("\nend")).alias("text"))


def _read(spark, sf):
    t = D.read_table(_tables(spark, sf))
    return t.select("doc", F.array_join("header", ",").alias("header"), F.array_join("alignments", ",").alias("alignments"), F.array_join(F.flatten("rows"), ",").alias("cells"))


def _write(spark, sf):
    t = D.read_table(_tables(spark, sf))
    return t.select("doc", D.write_table(F.col("header"), F.col("rows")).alias("text"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def _changed(spark, sf):
    t = F.when(F.col("doc") % 3 == 0, F.concat("text", F.lit("\nmore"))).when(F.col("doc") % 3 == 1, F.regexp_replace("text", r"\n[^\n]*$", "")).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc", t.alias("text"))


def _front(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: '"), F.col("source"), F.lit("'\n---\n"), F.col("text"))).otherwise(F.col("text"))
    m = d.select(F.col("doc_id").alias("doc"), D.front_matter(t).alias("m"))
    props = D.properties(F.col("m.yaml"))
    return m.select("doc", F.try_element_at(props, F.lit("lang")).alias("lang"), F.try_element_at(props, F.lit("source")).alias("source"), F.md5("m.body").alias("body"))


def _flow(spark, sf):
    o = table(spark, sf, "nation").select((F.col("n_regionkey").cast("bigint")).alias("doc"), "n_nationkey", "n_name")
    line = F.concat(F.lit("- "), F.col("n_name"), F.lit(" -> Hub "), F.col("n_nationkey").cast("string"), F.lit(": ships"))
    g = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("x"))
    return g.select("doc", F.concat(F.lit("# Flow\n"), F.array_join(F.transform("x", lambda x: x.l), "\n")).alias("text"))


QUERIES = {
    "naming_findings": lambda s, d: N.findings(S.of_parts(s, d), RULES).select("path", F.array_join("issues", ",").alias("issues"), "target", "blocked"),
    "naming_scopes": lambda s, d: N.governing(S.of_documents(s, d), _scopes(s)),
    "read_tables": _read,
    "write_tables": _write,
    "markdown_blocks": lambda s, d: D.blocks(_docs(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars")),
    "markdown_write": lambda s, d: D.write_markdown(D.blocks(_docs(s, d))).select("doc", F.length("text").alias("n")),
    "block_diff": lambda s, d: D.diff(D.blocks(_docs(s, d)), D.blocks(_changed(s, d))),
    "front_matter": _front,
    "page_outline": lambda s, d: D.outline(table(s, d, "pages").select(F.col("page_id").alias("doc"), "html")),
    "diagram_edges": lambda s, d: D.diagram_edges(_flow(s, d)),
    "diagram_nodes": lambda s, d: D.diagram_nodes(D.diagram_edges(_flow(s, d))).select("doc", "id", "label"),
    "diagram_text": lambda s, d: D.mermaid(D.diagram_edges(_flow(s, d))),
}

_P = "(SELECT p_brand || '/' || p_partkey AS path, p_brand || '/' AS folder, p_name AS name FROM part)"
_LINES = "l AS (SELECT doc_id AS doc, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), b AS (SELECT doc, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM l)"

ORACLE = {
    "naming_findings": f"""WITH f AS (SELECT path, folder, name, replace(name, 'green', 'verdant') AS r FROM {_P}),
      g AS (SELECT path, folder, name, array_to_string(list_transform(string_split(r, ' '), lambda w: CASE WHEN w = 'gear' THEN 'cog' ELSE w END), ' ') AS r FROM f)
      SELECT path, array_to_string(list_filter([CASE WHEN NOT starts_with(name, 'P') THEN 'prefix' END, CASE WHEN upper(name) <> name THEN 'case' END, CASE WHEN name LIKE '% %' THEN 'separator' END,
        CASE WHEN NOT regexp_full_match(name, '[a-z ]+') THEN 'stem_regex' END, CASE WHEN length(name) > 12 THEN 'length' END, CASE WHEN name LIKE '% %' THEN 'word_count' END], lambda x: x IS NOT NULL), ',') AS issues,
        folder || replace(upper('P ' || r), ' ', '_') AS target, false AS blocked FROM g""",
    "naming_scopes": """WITH f AS (SELECT source || '/' || doc_id || '.' || lang AS path, source FROM documents)
      SELECT path, CASE source WHEN 'src1' THEN 'one' WHEN 'src3' THEN 'three' ELSE 'deux' END AS profile, source = 'src2' AND path <> 'src2/2.en' AS ambiguous FROM f WHERE source IN ('src1', 'src2', 'src3')""",
    "read_tables": "SELECT p_partkey AS doc, 'name,brand' AS header, 'left,right' AS alignments, p_name || ',' || p_brand AS cells FROM part",
    "write_tables": "SELECT p_partkey AS doc, '| name | brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' AS text FROM part",
    "markdown_blocks": f"""WITH {_LINES}, t AS (SELECT CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' || length(regexp_extract(line, '^(#+)', 1)) WHEN regexp_matches(line, '^\\s*[-*+]\\s+\\[[ xX]\\]\\s') THEN 'task'
      WHEN regexp_matches(line, '^\\s*[-*+]\\s+') THEN 'bullet' WHEN regexp_matches(line, '^\\s*[0-9]+[.)]\\s+') THEN 'numbered' WHEN line LIKE '>%' THEN 'quote' WHEN regexp_matches(line, '^(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') THEN 'divider'
      WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table_row' ELSE 'paragraph' END AS type, regexp_replace(line, '^\\s*(#{{1,6}}\\s+|[-*+]\\s+\\[[ xX]\\]\\s+|[-*+]\\s+|[0-9]+[.)]\\s+|>\\s?)', '') AS content FROM b)
      SELECT type, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM t GROUP BY 1""",
    "markdown_write": "SELECT doc_id AS doc, CAST(length(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))) AS INTEGER) AS n FROM documents",
    "block_diff": """WITH a AS (SELECT doc_id AS doc, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n, text, string_split(text, chr(10)) AS s FROM documents)
      SELECT doc, CAST(n AS INTEGER) AS pos, 'insert' AS op FROM a WHERE doc % 3 = 0 UNION ALL SELECT doc, CAST(n - 1 AS INTEGER), 'delete' FROM a WHERE doc % 3 = 1 AND len(s) > 1 AND trim(s[-1]) <> ''""",
    "front_matter": "SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source, md5(text) AS body FROM documents",
    "page_outline": """WITH h AS (SELECT page_id AS doc, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]\\s*>') AS l FROM pages), u AS (SELECT doc, unnest(l) AS h, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM h)
      SELECT doc, pos, CAST(substr(h, 3, 1) AS INTEGER) AS level, trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM u""",
    "diagram_edges": "SELECT CAST(n_regionkey AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS pos, n_name AS source, 'Hub ' || n_nationkey AS target, 'ships' AS label FROM nation",
    "diagram_nodes": "SELECT CAST(n_regionkey AS BIGINT) AS doc, lower(n_name) AS id, n_name AS label FROM nation UNION ALL SELECT n_regionkey, 'hub_' || n_nationkey, 'Hub ' || n_nationkey FROM nation",
    "diagram_text": "SELECT CAST(n_regionkey AS BIGINT) AS doc, 'flowchart TD' || chr(10) || string_agg('  ' || lower(n_name) || ' -->|ships| hub_' || n_nationkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1",
}

"""Queries of the file operators: filters, grep, duplicates, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import duplicates as D
from lodestone.operators import files as S
from lodestone.operators import filters as L
from lodestone.operators import grep as G
from lodestone.operators import snapshots as P
from lodestone.session import table

DOCS = """(SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, CAST(doc_id AS VARCHAR) || '.' || lang AS name,
  lang AS extension, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id * 86400 AS modified, 'file' AS kind, text AS content FROM documents)"""
PARTS = """(SELECT p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, p_name AS name, p_type AS extension,
  CAST(p_size AS BIGINT) AS size, p_partkey AS modified, 'file' AS kind FROM part)"""
META = ("path", "name", "extension", "size", "modified", "kind")
PATTERNS = ["License", "All rights", "example.com"]


def _find(query):
    return lambda spark, sf: L.find(S.of_documents(spark, sf), query).select(*META)


def _filter_set(spark, sf):
    f = L.FilterSet(
        all=(F.col("size") >= 10,),
        any=(L.contains("name", "green"), L.contains("path", "brand#1")),
        custom=(L.parse_custom("name:contains:A"), L.Custom("size", "le", "45"), L.Custom("path", "starts_with", "brand")),
    )
    return f.apply(S.of_parts(spark, sf)).select(*META)


def _custom(spark, sf):
    ops = [("name", "eq", "12.EN"), ("name", "starts_with", "12"), ("path", "ends_with", "7.fr"), ("size", "ge", "5000"), ("size", "le", "300"), ("size", "ge", "x"), ("owner", "eq", "me"), ("kind", "eq", "FILE")]
    d = S.of_documents(spark, sf)
    return d.agg(*[F.count_if(L.Custom(*o).column()).alias(f"c{i}") for i, o in enumerate(ops)])


def _orders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("extension"))
    key = F.col("path").try_cast("bigint")
    now = o.filter(key % 97 != 0).withColumn("size", F.when(key % 89 == 0, F.col("size") + 1).otherwise(F.col("size")))
    more = o.filter(key % 101 == 0).withColumn("path", F.concat(F.lit("new"), F.col("path")))
    return o, now.unionByName(more)


ORDERS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_totalprice AS size, CAST(epoch(o_orderdate) AS BIGINT) AS modified, o_orderstatus AS kind, o_orderpriority AS extension FROM orders),
n AS (SELECT path, CASE WHEN CAST(path AS BIGINT) % 89 = 0 THEN size + 1 ELSE size END AS size, modified, kind, extension FROM o WHERE CAST(path AS BIGINT) % 97 <> 0
  UNION ALL SELECT 'new' || path, size, modified, kind, extension FROM o WHERE CAST(path AS BIGINT) % 101 = 0),
d AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.size <> n.size OR o.modified <> n.modified OR o.kind <> n.kind OR o.extension <> n.extension THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL OUTER JOIN n ON o.path = n.path)"""


def _apply(spark, sf):
    o, n = _orders(spark, sf)
    return P.apply(o, P.diff(o, n), n).select("path", "size", "modified", "kind", "extension")


def _integrity_of_names(spark, sf):
    p = S.of_parts(spark, sf).select("path", F.concat("name", F.lit(".V2.TXT")).alias("name"))
    n = F.col("name")
    return p.select("path", names.stem(n).alias("stem"), names.extension(n).alias("ext"), names.separators(n).alias("joined"), F.size(names.tokens(n)).alias("n_tokens"), names.slug(n).alias("slug"), names.portable(n).alias("portable"))


def _plan(spark, sf):
    d = S.of_documents(spark, sf)
    return D.simulate(D.plan(D.by_content(d), d), d, "src1", protected=("src13",))


QUERIES = {
    "find_ext_size": _find("ext:en size>2KB size<=9000"),
    "find_name_path": _find("path:SRC1 name:7 .fr after:86400 before:60480000"),
    "find_duplicates": _find("dup:content kind:FILE"),
    "filter_any_custom": _filter_set,
    "filter_custom_counts": _custom,
    "find_paths": lambda s, d: G.find_paths(S.of_documents(s, d), "Src12/"),
    "grep_context": lambda s, d: G.grep(S.of_documents(s, d), ["License"]),
    "grep_many": lambda s, d: G.grep(S.of_documents(s, d), PATTERNS, 1),
    "exact_names": lambda s, d: D.by_name(S.of_parts(s, d)),
    "content_duplicates": lambda s, d: D.by_content(S.of_documents(s, d)),
    "content_members": lambda s, d: D.content_members(S.of_documents(s, d)),
    "name_members": lambda s, d: D.name_members(S.of_parts(s, d)),
    "content_stage_counts": lambda s, d: D.stage_counts(S.of_documents(s, d)),
    "allowed_duplicates": lambda s, d: D.without_allowed(D.by_content(S.of_documents(s, d)), globs=["src1"]),
    "near_names": lambda s, d: D.near_names(S.of_parts(s, d), threshold=0.6),
    "duplicate_plan": _plan,
    "treemap": lambda s, d: D.treemap(S.of_documents(s, d)),
    "largest_space": lambda s, d: D.treemap(S.of_parts(s, d)).limit(20),
    "scan_totals": lambda s, d: P.totals(S.of_documents(s, d)),
    "snapshot_diff": lambda s, d: P.diff(*_orders(s, d)),
    "snapshot_apply": _apply,
    "name_functions": _integrity_of_names,
}

_WHERE = f"SELECT path, name, extension, size, modified, kind FROM {DOCS} WHERE "
_GROUPS = f"""SELECT size, sha256(content) AS partial_sha256, sha256(content) AS sha256, list_sort(list(path)) AS items, count(*) AS n
  FROM {DOCS} GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def _grep_sql(patterns, context):
    hit = " OR ".join(f"contains(text, '{p}')" for p in patterns)
    col = "coalesce(" + ", ".join(f"CASE WHEN contains(text, '{p}') THEN octet_length(encode(split_part(text, '{p}', 1))) + 1 END" for p in patterns) + ")"
    return f"""WITH a AS (SELECT path, string_split(content, chr(10)) AS l FROM {DOCS}), b AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM a),
    c AS (SELECT path, l, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM b)
    SELECT path, CAST(i AS INTEGER) AS line, CAST({col} AS INTEGER) AS col, text, l[greatest(i - {context}, 1):i - 1] AS before, l[i + 1:i + {context}] AS after FROM c WHERE {hit}"""


ORACLE = {
    "find_ext_size": _WHERE + "extension = 'en' AND size >= 2048 AND size <= 9000",
    "find_name_path": _WHERE + "lower(path) LIKE '%src1%' AND name LIKE '%7%' AND name LIKE '%.fr%' AND modified >= 86400 AND modified <= 60480000",
    "find_duplicates": _WHERE + "content IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "filter_any_custom": f"SELECT * FROM {PARTS} WHERE size >= 10 AND size <= 45 AND lower(name) LIKE '%a%' AND lower(path) LIKE 'brand%' AND (lower(name) LIKE '%green%' OR lower(path) LIKE '%brand#1%')",
    "filter_custom_counts": f"""SELECT count(*) FILTER (name = '12.en') AS c0, count(*) FILTER (name LIKE '12%') AS c1, count(*) FILTER (path LIKE '%7.fr') AS c2,
      count(*) FILTER (size >= 5000) AS c3, count(*) FILTER (size <= 300) AS c4, CAST(0 AS BIGINT) AS c5, CAST(0 AS BIGINT) AS c6, count(*) AS c7 FROM {DOCS}""",
    "find_paths": f"SELECT path, 100 AS score FROM {DOCS} WHERE lower(path) LIKE '%src12/%'",
    "grep_context": _grep_sql(["License"], 2),
    "grep_many": _grep_sql(PATTERNS, 1),
    "exact_names": f"SELECT regexp_replace(lower(name), '(.)[.][^.]*$', '\\1') AS key, list_sort(list(path)) AS items, count(*) AS n, CAST(1.0 AS DOUBLE) AS similarity FROM {PARTS} GROUP BY 1 HAVING count(*) > 1",
    "content_duplicates": _GROUPS,
    "content_members": f"SELECT size, sha256(content) AS sha256, path, n FROM (SELECT *, count(*) OVER (PARTITION BY content) AS n FROM {DOCS}) WHERE n > 1",
    "name_members": f"SELECT lower(name) AS key, path, n FROM (SELECT *, count(*) OVER (PARTITION BY lower(name)) AS n FROM {PARTS}) WHERE n > 1",
    "content_stage_counts": f"""WITH f AS (SELECT size, content, count(*) OVER (PARTITION BY size) AS ns, count(*) OVER (PARTITION BY content) AS nc FROM {DOCS})
      SELECT count(*) AS files, count(*) FILTER (ns > 1) AS size_candidates, count(*) FILTER (nc > 1) AS partial_candidates, count(*) FILTER (nc > 1) AS full_candidates, CAST(0 AS BIGINT) AS unreadable FROM f""",
    "allowed_duplicates": f"SELECT * FROM ({_GROUPS}) WHERE len(list_filter(items, lambda p: NOT contains(p, 'src1'))) > 0",
    "near_names": f"""WITH e AS (SELECT DISTINCT size // 4096 AS bucket, lower(name) AS name FROM {PARTS}),
      g AS (SELECT DISTINCT bucket, name, unnest(CASE WHEN length(name) <= 3 THEN [name] ELSE list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)) END) AS gram FROM e),
      c AS (SELECT bucket, gram FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 256), h AS (SELECT g.* FROM g JOIN c USING (bucket, gram)),
      p AS (SELECT DISTINCT a.bucket, a.name AS left_name, b.name AS right_name FROM h a JOIN h b ON a.bucket = b.bucket AND a.gram = b.gram AND a.name < b.name)
      SELECT bucket, left_name, right_name, 1 - levenshtein(left_name, right_name) / CAST(greatest(length(left_name), length(right_name)) AS DOUBLE) AS similarity FROM p
      WHERE 1 - levenshtein(left_name, right_name) / CAST(greatest(length(left_name), length(right_name)) AS DOUBLE) >= 0.6""",
    "duplicate_plan": f"""WITH g AS ({_GROUPS}), a AS (SELECT items[1] AS canonical, unnest(items[2:]) AS path FROM g)
      SELECT a.path, a.canonical, f.size, CASE WHEN NOT (a.path LIKE 'src1/%') THEN 'outside root' END AS rejection FROM a JOIN {DOCS} f ON f.path = a.path""",
    "treemap": f"SELECT split_part(path, '/', 1) AS name, CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM {DOCS} GROUP BY 1",
    "largest_space": f"SELECT split_part(path, '/', 1) AS name, CAST(sum(size) AS BIGINT) AS total, count(*) AS n FROM {PARTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "scan_totals": f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {DOCS}",
    "snapshot_diff": f"WITH {ORDERS} SELECT * FROM d",
    "snapshot_apply": f"""WITH {ORDERS} SELECT o.* FROM o JOIN d USING (path) WHERE status = 'unchanged'
      UNION ALL SELECT n.* FROM n JOIN d USING (path) WHERE status IN ('added', 'modified')""",
    "name_functions": f"""SELECT path, name || '.V2' AS stem, 'txt' AS ext, regexp_replace(name || '.V2.TXT', '[ _-]+', '-', 'g') AS joined,
      CAST(len(regexp_split_to_array(name || '.V2.TXT', '[ _-]+')) AS INTEGER) AS n_tokens, lower(regexp_replace(replace(name, ' ', '_'), '[^A-Za-z0-9_]', '', 'g')) || 'v2txt' AS slug, true AS portable FROM {PARTS}""",
}

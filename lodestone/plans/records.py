"""Queries of small relational operators, guards and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import admission as A
from lodestone.operators import duplicates as D
from lodestone.operators import evidence as E
from lodestone.operators import records as R
from lodestone.operators import routing as G
from lodestone.session import table


def _levels(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("base").alias("case_"), F.col("c_mktsegment").alias("mark"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("upper").alias("case_"), F.lit(None).cast("string").alias("mark"))
    return R.overlay([c, s], "k", ["case_", "mark"])


def _first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return R.first_of(e, ["user_id", "event_type"], "event_id")


def _without(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return R.without(o, gone, "o_custkey").select("o_orderkey", "o_custkey")


def _blocks(spark, sf):
    line = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "N", "table_row").otherwise("paragraph")
    pos = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("pos")
    # of rows that share doc and pos, the first in the table's order counts, in every run
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    rows = line.select(F.col("l_orderkey").alias("doc"), pos, kind.alias("type"), place)
    return rows.groupBy("doc", "pos").agg(F.min_by("type", "place").alias("type"))


def _evaluate(spark, sf):
    o = table(spark, sf, "orders")
    seen = o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    want = o.filter("o_orderstatus <> 'F' or o_orderkey % 3 = 0").groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    out = R.evaluate(seen, want.withColumn("n", F.col("n") * 2), "k")
    return out.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _observed(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("role").alias("target"), F.length("text").cast("string").alias("digest"), F.col("turn").alias("seen"))


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    sha = F.when(F.col("doc_id") % 10 == 3, "bad").otherwise(F.sha2("text", 256))
    split = F.element_at(F.array(*[F.lit(x) for x in ("train", "validation", "test", "build")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select((F.col("doc_id") % 990).cast("string").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source_uri"), F.col("lang").alias("license"), sha.alias("content_sha256"), split.alias("split"))


def _integrity(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit("%PDF-"), "text")).when(k == 1, F.concat(F.lit("GIF89a"), "text")).when(k == 2, F.lit("")).otherwise(F.col("text")).cast("binary")
    return d.select(F.col("doc_id").alias("doc"), X.integrity(content, F.when(F.col("doc_id") % 8 < 4, "pdf").otherwise("gif")).alias("state"))


def _glossary(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    terms = n.select(F.col("n_name").alias("id"), F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("normalized"), F.col("n_regionkey").cast("string").alias("provenance_id"), (F.col("n_nationkey") / 20.0).alias("confidence"))
    p = r.filter("r_regionkey < 4").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("source_uri"), F.when(F.col("r_regionkey") == 1, " ").otherwise("CC0").alias("license"), F.sha2("r_name", 256).alias("content_sha256"))
    return E.glossary_errors(terms, p, X.normalise)


def _guards(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        G.output_guard(F.col("text"), F.col("turn") % 2, ("error",)).alias("verbose"),
        G.dispatch_guard(F.concat(F.when(F.col("turn") % 3 == 0, "explain ").otherwise("do "), "role"), F.col("role"), ("user", "tool")).alias("sprawl"),
        G.scope_guard(F.when(F.col("turn") % 4 == 0, " . ").otherwise(F.col("role"))).alias("wide"),
    )


QUERIES = {
    "settings_overlay": _levels,
    "first_of_each": _first,
    "remove_partition": _without,
    "regroup_rows": lambda s, d: R.regroup(_blocks(s, d)).groupBy("type").agg(F.count("parent").alias("inside"), F.count(F.lit(1)).alias("n"), F.sum("parent").alias("parents")),
    "evaluate_counts": _evaluate,
    "wasted_reads": lambda s, d: R.wasted(_observed(s, d)),
    "evicted_entries": lambda s, d: R.evicted(_observed(s, d).groupBy("session", F.col("target").alias("key")).agg(F.max("seen").alias("seen")), 1),
    "quiet_periods": lambda s, d: R.quiet_periods(table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")), "6 hours").groupBy("key").agg(F.count(F.lit(1)).alias("periods"), F.max("n").alias("longest")),
    "manifest_errors": lambda s, d: E.manifest_errors(_manifest(s, d)),
    "glossary_errors": _glossary,
    "content_integrity": _integrity,
    "guards": _guards,
    "override_rate": lambda s, d: A.override_rate(table(s, d, "conversations").select((F.col("role") == "assistant").alias("overridden"))).select(F.round("rate", 9).alias("rate")),
    "name_grams": lambda s, d: table(s, d, "part").select(F.explode(D.char_grams(F.lower("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")),
}

ORACLE = {
    "settings_overlay": "SELECT c_custkey AS k, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 2 = 1 THEN 'upper' ELSE 'base' END AS case_, c_mktsegment AS mark FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "first_of_each": "SELECT user_id, event_type, min(event_id) AS event_id, round(arg_min(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
    "remove_partition": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
    "regroup_rows": """WITH b AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + l_partkey AS pos, any_value(CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'table_row' ELSE 'paragraph' END) AS type FROM lineitem GROUP BY 1, 2),
      w AS (SELECT type, max(CASE WHEN type <> 'table_row' THEN pos END) OVER o AS l, max(CASE WHEN type = 'table' THEN pos END) OVER o AS t FROM b WINDOW o AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT type, count(*) FILTER (type = 'table_row' AND l = t) AS inside, count(*) AS n, CAST(sum(CASE WHEN type = 'table_row' AND l = t THEN t END) AS BIGINT) AS parents FROM w GROUP BY 1""",
    "evaluate_counts": """WITH a AS (SELECT o_orderpriority AS k, count(*) AS o FROM orders GROUP BY 1), b AS (SELECT k, 2 * max(n) AS e FROM (SELECT o_orderstatus, o_orderpriority AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 = 0 GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT CAST(sum(least(coalesce(o, 0), coalesce(e, 0))) AS BIGINT) AS tp, CAST(sum(greatest(coalesce(o, 0) - coalesce(e, 0), 0)) AS BIGINT) AS fp, CAST(sum(greatest(coalesce(e, 0) - coalesce(o, 0), 0)) AS BIGINT) AS fn FROM a FULL JOIN b USING (k))
      SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall FROM s""",
    "wasted_reads": "SELECT CAST(conv_id AS VARCHAR) AS session, count(*) - count(DISTINCT role || '-' || length(text)) AS wasted FROM conversations GROUP BY 1",
    "evicted_entries": """WITH e AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY max(turn) DESC, role) AS r FROM conversations GROUP BY 1, 2)
      SELECT CAST(conv_id AS VARCHAR) AS session, role AS key FROM e WHERE r > 1""",
    "quiet_periods": """WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
      g AS (SELECT key, sum(s) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS p FROM e), c AS (SELECT key, p, count(*) AS n FROM g GROUP BY 1, 2) SELECT key, count(*) AS periods, max(n) AS longest FROM c GROUP BY 1""",
    "manifest_errors": """WITH m AS (SELECT CAST(doc_id % 990 AS VARCHAR) AS id, doc_id FROM documents)
      SELECT id, 'blank source_uri' AS error FROM m WHERE doc_id % 7 = 0 UNION ALL SELECT id, 'checksum' FROM m WHERE doc_id % 10 = 3 UNION ALL SELECT id, 'split' FROM m WHERE doc_id % 4 = 3
      UNION ALL SELECT id, 'repeated id' FROM m GROUP BY id HAVING count(*) > 1""",
    "glossary_errors": """SELECT n_name AS id, CASE WHEN n_nationkey > 20 THEN 'confidence' WHEN n_nationkey % 3 = 0 THEN 'normalization' WHEN n_regionkey = 4 THEN 'missing provenance' ELSE 'invalid provenance' END AS error
      FROM nation WHERE n_nationkey > 20 OR n_nationkey % 3 = 0 OR n_regionkey IN (1, 4)""",
    "content_integrity": "SELECT doc_id AS doc, CASE doc_id % 8 WHEN 0 THEN 'valid' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'corrupt' WHEN 4 THEN 'mismatch' WHEN 5 THEN 'valid' WHEN 6 THEN 'corrupt' ELSE 'unknown' END AS state FROM documents",
    "guards": """SELECT conv_id, turn, turn % 2 = 0 AND length(text) > 120 AND (contains(text, 'error') OR octet_length(encode(text)) > 200) AS verbose, turn % 3 = 0 AND role IN ('user', 'tool') AS sprawl, turn % 4 = 0 AS wide FROM conversations""",
    "override_rate": "SELECT round(count(*) FILTER (role = 'assistant') / CAST(count(*) AS DOUBLE), 9) AS rate FROM conversations",
    "name_grams": "WITH g AS (SELECT unnest(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3)))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY 1",
}

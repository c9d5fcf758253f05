"""Queries of evidence, routing, ledger, admission and registry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import admission as A
from lodestone.operators import evidence as E
from lodestone.operators import ledger as L
from lodestone.operators import registry as G
from lodestone.operators import routing as R
from lodestone.session import table


def _measured(spark, sf):
    one = F.lit(1).cast("bigint")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("stratum"),
        F.col("l_extendedprice").alias("latency"),
        F.col("l_quantity").cast("bigint").alias("candidates"),
        (F.col("l_linenumber") * one).alias("tp"),
        F.when(F.col("l_discount") > 0.08, one).otherwise(one - 1).alias("fp"),
        F.when(F.col("l_tax") > 0.06, one).otherwise(one - 1).alias("fn"),
    )


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _summary(spark, sf):
    return _rounded(E.summary(_measured(spark, sf), ["stratum"], "latency", "candidates", "tp", "fp", "fn"))


def _select(spark, sf):
    s = E.summary(_measured(spark, sf), ["stratum"], "latency", "candidates", "tp", "fp", "fn")
    c = s.select(F.col("stratum").alias("id"), F.round("f1", 4).alias("f1"), F.col("max_fp").alias("fp"), "p95", F.round("mean_candidates", 4).alias("candidates"), F.array(F.lit("x"), F.col("stratum")).alias("strata"))
    return E.select_default(c, 1, 1e9, ["x"]).drop("strata")


def _evidence(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("subject"), F.length("text").alias("n"), "source")
    lab = table(spark, sf, "labels")
    kinds = d.select("subject", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.pmod(F.col("subject") * (i + 3), F.lit(5)) / 5 + 0.2).alias("weight")) for i, k in enumerate(E.QUALITY)])).alias("e")).select("subject", "e.*")
    risk = lab.select(F.col("doc_id").alias("subject"), F.lit(E.RISK).alias("kind"), (F.col("toxic") * 0.5).alias("weight"))
    rows = kinds.unionByName(risk)
    return rows.select("subject", F.concat("kind", F.lit(":"), F.col("subject").cast("string")).alias("id"), "kind", "weight", (F.pmod("subject", F.lit(50)) != 49).alias("verified"))


def _classify(spark, sf):
    out = E.classify(_evidence(spark, sf), 0.6, 0.4)
    return out.select("subject", F.round("aggregate", 6).alias("aggregate"), "decision", F.size("reasons").alias("n_reasons"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))


def _text(spark, sf):
    t = F.col("content")
    return _docs(spark, sf).select("doc", X.token_estimate(t).alias("tokens"), X.reference_tag(t).alias("tag"), F.sha2(X.normalise(t), 256).alias("normal"), F.md5(X.escape_marks(t)).alias("escaped"), (X.unescape_marks(X.escape_marks(t)) == t).alias("round_trip"), F.size(X.terms(t)).alias("terms"))


def _ledger(spark, sf):
    c = table(spark, sf, "conversations")
    row = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    return c.select(
        row(F.col("turn")).alias("correction_id"),
        F.col("conv_id").cast("string").alias("subject"),
        F.col("text").alias("assertion"),
        F.md5("role").alias("rejected_assertion"),
        F.when(F.pmod("turn", F.lit(3)) == 2, row(F.col("turn") - 1)).alias("supersedes"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


def _conflicts(spark, sf):
    led = _ledger(spark, sf)
    claims = led.select("subject", F.md5(F.lit("user")).alias("assertion")).distinct()
    return L.conflicts(claims, led)


def _supersede(spark, sf):
    led = _ledger(spark, sf)
    new = led.filter("seq % 4 = 1").select(F.concat("correction_id", F.lit("r")).alias("correction_id"), "subject", "assertion", "rejected_assertion", F.col("correction_id").alias("supersedes"), (F.col("seq") + 500).alias("seq"))
    return L.active(L.supersede(led, new)).select("correction_id", "subject")


def _observations(spark, sf):
    c = table(spark, sf, "conversations")
    target = F.when(F.pmod("turn", F.lit(7)) != 6, F.concat("role", (F.col("turn") % 2).cast("string")))
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), target.alias("target"), F.lit("x").alias("digest"))


def _events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(F.lit("created"), F.lit("modified"), F.lit("deleted")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), F.col("event_id").alias("seq"), kind.alias("kind"))


def _levels(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, -0.15).otherwise(0.02).alias("delta"))
    return A.aggressiveness(e).select("key", F.round("level", 6).alias("level"))


def _entries(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("r_name").alias("group"),
        F.col("n_nationkey").alias("pos"),
        F.col("n_name").alias("id"),
        F.array(F.lower("n_name"), F.substring("n_name", 1, 1)).alias("aliases"),
        F.array(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit("?")))).alias("related"),
        F.col("n_name").alias("description"),
    )


RULES = {"id": {"required": True, "pattern": "^[A-Z_0-9]+$", "max": 8}, "description": {"min": 8, "enum": ["NATION_1", "NATION_12", "NATION_20"]}}

QUERIES = {
    "measurement_summary": _summary,
    "select_default": _select,
    "classify_evidence": _classify,
    "pii_mask": lambda s, d: _docs(s, d).select("doc", X.mask(F.col("content")).alias("masked")),
    "text_functions": _text,
    "route_content": lambda s, d: R.route(_docs(s, d)),
    "byte_entropy": lambda s, d: R.entropies(_docs(s, d)).select("doc", F.round("entropy", 6).alias("entropy")),
    "ledger_active": lambda s, d: L.active(_ledger(s, d)).select("correction_id", "subject", "seq"),
    "ledger_history": lambda s, d: L.history(_ledger(s, d), "3").select("correction_id", "status"),
    "ledger_conflicts": _conflicts,
    "ledger_supersede": _supersede,
    "admission": lambda s, d: A.admit(_observations(s, d)),
    "event_coalesce": lambda s, d: A.coalesce_events(_events(s, d)),
    "aggressiveness": _levels,
    "registry_relations": lambda s, d: G.broken_relations(_entries(s, d)),
    "registry_collisions": lambda s, d: G.alias_collisions(_entries(s, d)),
    "registry_alias_map": lambda s, d: G.alias_map(_entries(s, d)),
    "registry_statistics": lambda s, d: G.group_statistics(_entries(s, d)),
    "registry_field_errors": lambda s, d: G.field_errors(_entries(s, d), RULES),
    "registry_markdown": lambda s, d: G.to_markdown(_entries(s, d)),
}

_M = """m AS (SELECT l_returnflag AS stratum, l_extendedprice AS latency, CAST(l_quantity AS BIGINT) AS candidates, l_linenumber AS tp,
  CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS fp, CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END AS fn FROM lineitem),
s AS (SELECT stratum, count(*) AS n, min(latency) AS least, max(latency) AS most, avg(latency) AS mean, quantile_disc(latency, 0.5) AS median, quantile_disc(latency, 0.95) AS p95,
  quantile_disc(latency, 0.99) AS p99, stddev_pop(latency) AS stddev, avg(candidates) AS mean_candidates, CAST(max(fp) AS BIGINT) AS max_fp,
  sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) AS precision, sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE) AS recall FROM m GROUP BY 1)"""
_LED = """led AS (SELECT conv_id || '-' || turn AS correction_id, CAST(conv_id AS VARCHAR) AS subject, md5(role) AS rejected, CASE WHEN turn % 3 = 2 THEN conv_id || '-' || (turn - 1) END AS supersedes, conv_id * 1000 + turn AS seq FROM conversations)"""
_ENT = "ent AS (SELECT r_name AS grp, n_nationkey AS pos, n_name AS id FROM nation JOIN region ON n_regionkey = r_regionkey)"

ORACLE = {
    "measurement_summary": f"WITH {_M} SELECT stratum, n, round(least, 6) AS least, round(most, 6) AS most, round(mean, 6) AS mean, median, p95, p99, round(stddev, 6) AS stddev, round(mean_candidates, 6) AS mean_candidates, max_fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s",
    "select_default": f"WITH {_M} SELECT stratum AS id, round(2 * precision * recall / (precision + recall), 4) AS f1, max_fp AS fp, p95, round(mean_candidates, 4) AS candidates FROM s ORDER BY 2 DESC, 5, 4, 1 LIMIT 1",
    "classify_evidence": """WITH k AS (SELECT doc_id AS subject, ((doc_id * 3) % 5) / 5.0e0 + 0.2e0 AS a, ((doc_id * 4) % 5) / 5.0e0 + 0.2e0 AS b, ((doc_id * 5) % 5) / 5.0e0 + 0.2e0 AS c, ((doc_id * 6) % 5) / 5.0e0 + 0.2e0 AS d FROM documents),
      r AS (SELECT doc_id AS subject, max(toxic * 0.5e0) AS risk FROM labels GROUP BY 1), g AS (SELECT k.subject, (a + b + c + d) / 4 * (1 - coalesce(risk, 0)) AS aggregate, CASE WHEN risk IS NULL THEN 4 ELSE 5 END AS n_reasons FROM k LEFT JOIN r USING (subject))
      SELECT subject, round(aggregate, 6) AS aggregate, CASE WHEN subject % 50 = 49 THEN 'invalid' WHEN aggregate >= 0.6 THEN 'eligible' WHEN aggregate >= 0.4 THEN 'review' ELSE 'reject' END AS decision, CAST(n_reasons AS INTEGER) AS n_reasons FROM g""",
    "pii_mask": """SELECT doc_id AS doc, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\\b([0-9]{1,3}\\.){3}[0-9]{1,3}\\b', '[IP_ADDRESS]', 'g'), '\\b(\\+66|0)[0-9]{8,9}\\b', '[PHONE]', 'g') AS masked FROM documents""",
    "text_functions": """SELECT doc_id AS doc, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens, '§ref:' || substr(sha256(text), 1, 8) || '§' AS tag,
      sha256(lower(nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) AS normal, md5(regexp_replace(text, '([\\\\*~`$\\[\\]<>{}|^])', '\\\\\\1', 'g')) AS escaped, true AS round_trip,
      CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS terms FROM documents""",
    "byte_entropy": """WITH b AS (SELECT doc_id AS doc, unnest(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: substr(hex(encode(text)), 2 * i - 1, 2))) AS x FROM documents),
      c AS (SELECT doc, x, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT doc, sum(n) AS s FROM c GROUP BY 1)
      SELECT doc, round(-sum(n / CAST(s AS DOUBLE) * log2(n / CAST(s AS DOUBLE))), 6) AS entropy FROM c JOIN t USING (doc) GROUP BY doc""",
    "route_content": """WITH b AS (SELECT doc_id AS doc, unnest(list_transform(range(1, octet_length(encode(text)) + 1), lambda i: substr(hex(encode(text)), 2 * i - 1, 2))) AS x FROM documents),
      c AS (SELECT doc, x, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT doc, sum(n) AS s FROM c GROUP BY 1), e AS (SELECT doc, -sum(n / CAST(s AS DOUBLE) * log2(n / CAST(s AS DOUBLE))) AS entropy FROM c JOIN t USING (doc) GROUP BY doc)
      SELECT doc_id AS doc, CASE WHEN octet_length(encode(text)) < 100 THEN 'default' WHEN regexp_matches(lower(text), 'terms of service|privacy policy|license agreement|gdpr|-----begin')
        OR regexp_matches(lower(text), '(private_key|secret_key|api_key).*[=:]|[=:].*(private_key|secret_key|api_key)', 's') OR regexp_matches(lower(text), 'password[:=]|password "') THEN 'safe'
        WHEN entropy < 2.5 THEN 'aggressive' ELSE 'default' END AS mode FROM documents LEFT JOIN e ON doc = doc_id""",
    "ledger_active": f"WITH {_LED} SELECT correction_id, subject, seq FROM led WHERE correction_id NOT IN (SELECT supersedes FROM led WHERE supersedes IS NOT NULL)",
    "ledger_history": f"WITH {_LED} SELECT correction_id, CASE WHEN correction_id IN (SELECT supersedes FROM led WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE 'active' END AS status FROM led WHERE subject = '3'",
    "ledger_conflicts": f"""WITH {_LED} SELECT subject, md5('user') AS assertion, arg_min(correction_id, seq) AS correction_id FROM led WHERE rejected = md5('user')
      AND correction_id NOT IN (SELECT supersedes FROM led WHERE supersedes IS NOT NULL) GROUP BY 1""",
    "ledger_supersede": f"""WITH {_LED}, a AS (SELECT * FROM led WHERE correction_id NOT IN (SELECT supersedes FROM led WHERE supersedes IS NOT NULL)), n AS (SELECT * FROM a WHERE seq % 4 = 1)
      SELECT correction_id, subject FROM a WHERE seq % 4 <> 1 UNION ALL SELECT correction_id || 'r', subject FROM n""",
    "admission": """WITH RECURSIVE o AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS seq, CASE WHEN turn % 7 <> 6 THEN role || CAST(turn % 2 AS VARCHAR) END AS target, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      f AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS target, CAST([] AS VARCHAR[]) AS seen, 0 AS run, CAST(NULL AS VARCHAR) AS action FROM o
        UNION ALL SELECT session, i, seq, target, CASE WHEN action IN ('pass', 'reference') THEN list_append(seen, target) ELSE seen END, CASE WHEN target IS NULL THEN 0 WHEN action IN ('pass', 'block') THEN run + 1 ELSE run END, action
        FROM (SELECT o.session, o.i, o.seq, o.target, seen, run, CASE WHEN o.target IS NULL THEN 'outcome' WHEN len(list_filter(seen, lambda x: x = o.target)) >= 3 THEN 'warn' WHEN list_contains(seen, o.target) THEN 'reference' WHEN run >= 2 THEN 'block' ELSE 'pass' END AS action
          FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1))
      SELECT session, seq, action FROM f WHERE i > 0""",
    "event_coalesce": """WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS path, event_id AS seq, ['created', 'modified', 'deleted'][event_id % 3 + 1] AS kind, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
      f AS (SELECT path, i, kind AS change FROM e WHERE i = 1 UNION ALL SELECT e.path, e.i, CASE WHEN change = '' THEN kind WHEN change = 'created' AND kind = 'deleted' THEN '' WHEN change = 'created' AND kind = 'modified' THEN 'created' ELSE kind END FROM f JOIN e ON e.path = f.path AND e.i = f.i + 1)
      SELECT path, arg_max(change, i) AS change FROM f GROUP BY 1 HAVING arg_max(change, i) <> ''""",
    "aggressiveness": """WITH RECURSIVE e AS (SELECT user_id AS key, CASE WHEN value > 50 THEN -0.15e0 ELSE 0.02e0 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      f AS (SELECT key, i, least(greatest(0.5e0 + d, 0.1e0), 1.0e0) AS level FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, least(greatest(level + d, 0.1e0), 1.0e0) FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
      SELECT key, round(arg_max(level, i), 6) AS level FROM f GROUP BY 1""",
    "registry_relations": f"WITH {_ENT} SELECT id, id || '?' AS related FROM ent WHERE pos % 2 = 1",
    "registry_collisions": f"WITH {_ENT} SELECT lower(substr(id, 1, 1)) AS alias, list_sort(list(id)) AS ids FROM ent GROUP BY 1 HAVING count(*) > 1",
    "registry_alias_map": f"WITH {_ENT}, a AS (SELECT pos, id, lower(id) AS alias FROM ent UNION ALL SELECT pos, id, lower(substr(id, 1, 1)) FROM ent) SELECT alias, arg_max(id, pos) AS id FROM a GROUP BY 1",
    "registry_statistics": f'WITH {_ENT} SELECT grp AS "group", count(*) AS entries, CAST(0 AS BIGINT) AS repeated, 2 * count(*) AS aliases FROM ent GROUP BY 1',
    "registry_field_errors": f"""WITH {_ENT} SELECT id, 'id' AS field, 'long' AS error FROM ent WHERE length(id) > 8 UNION ALL SELECT id, 'description', 'enum' FROM ent WHERE id NOT IN ('NATION_1', 'NATION_12', 'NATION_20')
      UNION ALL SELECT id, 'description', 'short' FROM ent WHERE length(id) < 8 UNION ALL SELECT id, 'id', 'pattern' FROM ent WHERE NOT regexp_full_match(id, '[A-Z_0-9]+')""",
    "registry_markdown": f"""WITH {_ENT} SELECT grp AS "group", '## ' || grp || chr(10) || chr(10) || '| id | aliases |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || id || ' | ' || lower(id) || ', ' || substr(id, 1, 1) || ' |', chr(10) ORDER BY pos) AS text FROM ent GROUP BY 1""",
}

"""Queries of guards, contracts, checks of entries and regrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import admission as A
from lodestone.operators import contracts as C
from lodestone.session import table

GROUPS = {
    "BUILDING": {"required": ["name", "phone"], "fields": ["name", "phone"], "custom": False},
    "MACHINERY": {"required": ["name"], "fields": ["name"], "custom": True, "most": 1},
    "FURNITURE": {"required": [], "fields": ["name", "phone", "note", "extra"], "custom": True, "most": 3},
}


def _claims(spark, sf):
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" We Assume so."))).otherwise(F.col("text"))
    sources = F.when(F.col("doc_id") % 3 != 0, F.array("source"))
    return d.select(F.col("doc_id").alias("doc"), C.provenance_guard(text, sources).alias("g")).select("doc", "g.decision", "g.confidence")


def _ledger(spark, sf):
    c = table(spark, sf, "conversations")
    row = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    return c.select(row(F.col("turn")).alias("correction_id"), "role", F.col("conv_id").cast("string").alias("subject"), F.md5("role").alias("rejected_assertion"), F.when(F.col("turn") % 3 == 2, row(F.col("turn") - 1)).alias("supersedes"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))


def _guarded(spark, sf):
    led = _ledger(spark, sf)
    seen = led.select(F.col("subject").alias("target"), F.md5(F.when(F.col("seq") % 2 == 0, F.lit("user")).otherwise(F.lit("nobody"))).alias("content"), F.col("correction_id").alias("observation"))
    return C.ledger_guard(seen, led).select("observation", "correction_id")


def _events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("dedup_re_read", "verifier_fallback", "information_loss", "success")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"))


def _regretted(spark, sf):
    events = _events(spark, sf)
    top = C.most_regretted(events, A.aggressiveness(C.regret_deltas(events)))
    return top.select("key", "regrets", F.round("level", 6).alias("level"))


def _report(spark, sf):
    events = _events(spark, sf)
    return C.regret_report(events, A.aggressiveness(C.regret_deltas(events)))


def _recommended(spark, sf):
    events = _events(spark, sf).filter("key < '5'")
    keys = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return C.recommended(keys, A.aggressiveness(C.regret_deltas(events))).select("key", F.round("level", 6).alias("level"))


def _seen(spark, sf):
    c = table(spark, sf, "conversations")
    seen = c.select(F.md5("text").alias("digest"), F.concat("role", F.col("conv_id").cast("string")).alias("target"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    rows = c.filter("turn % 2 = 0").select(F.col("conv_id").alias("conv"), "turn", F.md5("text").alias("digest"))
    return C.seen_content(rows, seen).select("conv", "turn", "seen_as")


def _ids(spark, sf):
    o = table(spark, sf, "orders")
    return C.id_map(o.select(F.col("o_custkey").cast("string").alias("remote"), (F.col("o_orderkey") % 40).cast("string").alias("local"), F.col("o_orderkey").alias("seq")))


def _states(spark, sf):
    c = table(spark, sf, "customer")
    some = lambda n: F.when(F.col("c_custkey") % n == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return C.judgment(c.select(F.col("c_custkey").alias("state"), some(4).alias("duplicates"), some(3).alias("naming_issues"))).select("state", "effect", "confidence")


def _contracts(spark, sf):
    line = table(spark, sf, "lineitem")
    effect = F.element_at(F.array(*[F.lit(x) for x in ("duplicate_removal", "rename", "move", "no_op")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    expected = line.select(F.col("l_orderkey").alias("contract"), effect.alias("effect"), F.col("l_partkey").cast("string").alias("path")).distinct()
    return C.contract_errors(expected, expected.filter("path % 5 <> 0").select("contract", "path"))


def _entries(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    have = lambda name, when: F.when(when, F.struct(F.lit(name).alias("key"), F.lit("v").alias("value")))
    fields = F.map_from_entries(F.array_compact(F.array(have("name", k % 2 == 0), have("phone", k % 3 == 0), have("note", k % 5 == 0), have("extra", k % 7 == 0))))
    return C.entry_errors(c.select(k.alias("id"), F.col("c_mktsegment").alias("group"), fields.alias("fields")), GROUPS)


def _changes(spark, sf):
    op = F.element_at(F.array(*[F.lit(x) for x in ("insert", "update", "delete", "move")]), (F.col("event_id") % 4 + 1).cast("int"))
    return C.change_summary(table(spark, sf, "events").select(op.alias("op")))


QUERIES = {
    "provenance_guard": _claims,
    "ledger_guard": _guarded,
    "most_regretted": _regretted,
    "regret_report": _report,
    "recommended_levels": _recommended,
    "seen_content": _seen,
    "id_map": _ids,
    "judgment": _states,
    "contract_errors": _contracts,
    "entry_errors": _entries,
    "change_summary": _changes,
}

_FOLD = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id % 4 <> 3 AS bad, [-0.075e0, -0.15e0, -0.3e0, 0.02e0][event_id % 4 + 1] AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events {where}),
  f AS (SELECT key, i, least(greatest(0.5e0 + d, 0.1e0), 1.0e0) AS level FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, least(greatest(level + d, 0.1e0), 1.0e0) FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1),
  l AS (SELECT key, arg_max(level, i) AS level FROM f GROUP BY 1), n AS (SELECT key, count(*) AS regrets FROM e WHERE bad GROUP BY 1)"""
_LED = "led AS (SELECT conv_id || '-' || turn AS correction_id, CAST(conv_id AS VARCHAR) AS subject, md5(role) AS rejected, CASE WHEN turn % 3 = 2 THEN conv_id || '-' || (turn - 1) END AS supersedes, conv_id * 1000 + turn AS seq FROM conversations)"
_F = "k % 2 = 0 AS name, k % 3 = 0 AS phone, k % 5 = 0 AS note, k % 7 = 0 AS extra"

ORACLE = {
    "provenance_guard": """SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 OR regexp_matches(lower(text), 'extrapolate|assume|conclude that the team|cultural dysfunction') THEN 'block' ELSE 'allow' END AS decision,
      CASE WHEN doc_id % 3 <> 0 AND (doc_id % 4 = 0 OR regexp_matches(lower(text), 'extrapolate|assume|conclude that the team|cultural dysfunction')) THEN 0.98e0 ELSE 0.95e0 END AS confidence FROM documents""",
    "ledger_guard": f"""WITH {_LED}, a AS (SELECT subject, rejected, arg_min(correction_id, seq) AS hit FROM led WHERE correction_id NOT IN (SELECT supersedes FROM led WHERE supersedes IS NOT NULL) GROUP BY 1, 2)
      SELECT led.correction_id AS observation, hit AS correction_id FROM led LEFT JOIN a ON a.subject = led.subject AND a.rejected = md5(CASE WHEN seq % 2 = 0 THEN 'user' ELSE 'nobody' END)""",
    "most_regretted": _FOLD.format(where="") + " SELECT key, regrets, round(level, 6) AS level FROM n JOIN l USING (key) ORDER BY regrets DESC, key LIMIT 5",
    "regret_report": _FOLD.format(where="")
    + """, t AS (SELECT * FROM n JOIN l USING (key) ORDER BY regrets DESC, key LIMIT 5)
      SELECT 'regrets: ' || (SELECT sum(regrets) FROM n) || ' events' || chr(10) || '  Most regretted:' || chr(10) || string_agg('  ' || key || ' — ' || regrets || ' regrets, aggressiveness: ' || printf('%.2f', level), chr(10) ORDER BY regrets DESC, key) AS text FROM t""",
    "recommended_levels": _FOLD.format(where="WHERE CAST(user_id AS VARCHAR) < '5'") + " SELECT CAST(c_custkey AS VARCHAR) AS key, round(coalesce(level, 0.5e0), 6) AS level FROM customer LEFT JOIN l ON key = CAST(c_custkey AS VARCHAR)",
    "seen_content": """WITH s AS (SELECT md5(text) AS digest, arg_min(role || conv_id, conv_id * 1000 + turn) AS seen_as FROM conversations GROUP BY 1)
      SELECT conv_id AS conv, turn, seen_as FROM conversations JOIN s ON digest = md5(text) WHERE turn % 2 = 0""",
    "id_map": """WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS remote, CAST(o_orderkey % 40 AS VARCHAR) AS local, o_orderkey AS seq FROM orders),
      a AS (SELECT remote, arg_max(local, seq) AS local, max(seq) AS seq FROM p GROUP BY 1), b AS (SELECT local, max(seq) AS last FROM p GROUP BY 1) SELECT remote, local FROM a JOIN b USING (local) WHERE seq = last""",
    "judgment": """SELECT c_custkey AS state, CASE WHEN c_custkey % 4 = 0 THEN 'duplicate_removal' WHEN c_custkey % 3 = 0 THEN 'rename' ELSE 'no_op' END AS effect,
      CASE WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 THEN 0.9e0 ELSE 1.0e0 END AS confidence FROM customer""",
    "contract_errors": """SELECT DISTINCT l_orderkey AS contract, CAST(l_partkey AS VARCHAR) AS path, ['invalid_path', 'invalid_rename', 'invalid_move'][l_linenumber % 4 + 1] AS error
      FROM lineitem WHERE l_linenumber % 4 < 3 AND l_partkey % 5 = 0""",
    "entry_errors": f"""WITH c AS (SELECT c_custkey AS id, c_custkey AS k, c_mktsegment AS g FROM customer), f AS (SELECT id, g, {_F} FROM c)
      SELECT id, g AS "group", 'MISSING_REQUIRED_FIELD' AS code, 'name' AS field FROM f WHERE g IN ('BUILDING', 'MACHINERY') AND NOT name
      UNION ALL SELECT id, g, 'MISSING_REQUIRED_FIELD', 'phone' FROM f WHERE g = 'BUILDING' AND NOT phone
      UNION ALL SELECT id, g, 'CUSTOM_FIELDS_DISABLED', NULL FROM f WHERE g = 'BUILDING' AND (note OR extra)
      UNION ALL SELECT id, g, 'TOO_MANY_CUSTOM_FIELDS', NULL FROM f WHERE g = 'MACHINERY' AND CAST(phone AS INT) + CAST(note AS INT) + CAST(extra AS INT) > 1
      UNION ALL SELECT id, g, 'GROUP_NOT_FOUND', NULL FROM f WHERE g NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')""",
    "change_summary": "SELECT 'Sync Plan: ' || count(*) FILTER (event_id % 4 = 0) || ' inserts, ' || count(*) FILTER (event_id % 4 = 1) || ' updates, ' || count(*) FILTER (event_id % 4 = 2) || ' deletes, ' || count(*) FILTER (event_id % 4 = 3) || ' moves' AS text FROM events",
}

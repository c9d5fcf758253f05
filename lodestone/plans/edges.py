"""Queries that meet what the tables alone don't show: every rejection, rule and branch, by rows made of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions import text as X
from lodestone.operators import duplicates as D
from lodestone.operators import naming as N
from lodestone.operators import registry as G
from lodestone.session import table

NAMES = ("con.txt", "a?b.md", "fine.txt", "LPT1", "end.", "trail ", ".bashrc", "a.tar.gz")
THAI = ("โค้ด", "รายงาน", "ก", "สวัสดีx", "plain", "")
RULES = N.Rules(case="upper", separator="_", portable=False)


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _edges(spark, sf):
    """Contents of equal edges and, by size, different middles; a tenth have another length."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    content = F.concat(F.lit("head" * 4), (F.col("p_size") % 3).cast("string"), F.when(k % 10 == 0, "xx").otherwise(""), F.lit("tail" * 4))
    return p.select(k.cast("string").alias("path"), F.octet_length(content).cast("bigint").alias("size"), content.alias("content"))


def _actions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("bigint").alias("size"))
    path = F.when(F.col("k") % 6 == 0, F.concat(F.lit("other/"), "k")).when(F.col("k") % 6 == 1, F.concat(F.lit("root/.git/"), "k")).when(F.col("k") % 6 == 2, F.lit("root/kept")).otherwise(F.concat(F.lit("root/"), "k"))
    actions = p.select(F.lit("c").alias("canonical"), path.alias("path"), "size", "k")
    files = actions.filter("k % 6 <> 3 and k % 6 <> 2").select("path", F.when(F.col("k") % 6 == 4, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return D.simulate(actions, files, "root", allowed=["root/kept"]).select("k", "path", "rejection")


def _allowed(spark, sf):
    groups = D.by_content(_edges(spark, sf), 8)
    first = "4a7e"  # no group has it
    rules = dict(sha256=[first, _sha(0).upper()], globs=["no such part"], pairs=[("none", "1")])
    return D.without_allowed(groups, **rules).select("size", "sha256", "n")


def _sha(rest: int) -> str:
    import hashlib

    return hashlib.sha256(f"{'head' * 4}{rest}{'tail' * 4}".encode()).hexdigest()


def _blocked(spark, sf):
    """Files whose target another file has: every third name is there in its target's form too."""
    p = table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("name"), F.col("p_partkey").alias("k"))
    there = p.filter("k % 3 = 0").select(F.concat(F.upper(F.regexp_replace(F.regexp_replace("name", ".txt$", ""), " ", "_")), F.lit(".txt")).alias("name"), "k")
    files = p.unionByName(there).select(F.concat(F.lit("d/"), "name").alias("path"), "name")
    return N.ordered(N.findings(files, RULES)).select("path", F.array_join("issues", ",").alias("issues"), "target", "blocked")


def _names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), _pick(NAMES, F.col("p_partkey")).alias("name"))
    n = F.col("name")
    return p.select("id", names.portable(n).alias("portable"), names.stem(n).alias("stem"), names.extension(n).alias("ext"))


def _terms(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", _pick(THAI, F.col("p_partkey")), "p_name").alias("t"))
    return p.select("id", F.array_join(X.terms(F.col("t")), "|").alias("terms"), X.query_form(F.col("t")).alias("query"))


def _repeated(spark, sf):
    n = table(spark, sf, "nation")
    name = F.when(F.col("n_nationkey") % 4 == 0, F.lower(F.concat(F.lit("same"), F.col("n_regionkey").cast("string")))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("SAME"), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name"))
    return n.select(F.col("n_regionkey").cast("string").alias("group"), name.alias("id"), F.array("n_name", F.lit("x")).alias("aliases"))


QUERIES = {
    "edge_duplicates": lambda s, d: D.by_content(_edges(s, d), 8).select("size", "partial_sha256", "sha256", F.size("items").alias("items"), "n"),
    "edge_stage_counts": lambda s, d: D.stage_counts(_edges(s, d), 8),
    "plan_rejections": _actions,
    "allowed_by_rules": _allowed,
    "naming_blocked": _blocked,
    "portable_names": _names,
    "thai_terms": _terms,
    "repeated_ids": lambda s, d: G.repeated_ids(_repeated(s, d)),
    "repeated_statistics": lambda s, d: G.group_statistics(_repeated(s, d)),
}

_E = "e AS (SELECT p_partkey AS k, 'headheadheadhead' || (p_size % 3) || CASE WHEN p_partkey % 10 = 0 THEN 'xx' ELSE '' END || 'tailtailtailtail' AS c FROM part)"
_PARTIAL = "sha256('headhead' || 'tailtail')"
_AT = lambda values, key: "[" + ", ".join("'" + v + "'" for v in values) + f"][{key} % {len(values)} + 1]"
_TARGET = "upper(replace(p_name, ' ', '_')) || '_' || p_partkey || '.txt'"

ORACLE = {
    "edge_duplicates": f"WITH {_E} SELECT CAST(length(c) AS BIGINT) AS size, {_PARTIAL} AS partial_sha256, sha256(c) AS sha256, CAST(count(*) AS INTEGER) AS items, count(*) AS n FROM e GROUP BY c HAVING count(*) > 1",
    "edge_stage_counts": f"""WITH {_E}, f AS (SELECT count(*) OVER (PARTITION BY length(c)) AS s, count(*) OVER (PARTITION BY c) AS n FROM e)
      SELECT count(*) AS files, count(*) FILTER (s > 1) AS size_candidates, count(*) FILTER (s > 1) AS partial_candidates, count(*) FILTER (n > 1) AS full_candidates, CAST(0 AS BIGINT) AS unreadable FROM f""",
    "plan_rejections": """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'other/' || p_partkey WHEN 1 THEN 'root/.git/' || p_partkey WHEN 2 THEN 'root/kept' ELSE 'root/' || p_partkey END AS path,
      ['outside root', 'protected', 'allowed', 'missing', 'size changed', NULL][p_partkey % 6 + 1] AS rejection FROM part""",
    "allowed_by_rules": f"WITH {_E} SELECT CAST(length(c) AS BIGINT) AS size, sha256(c) AS sha256, count(*) AS n FROM e GROUP BY c HAVING count(*) > 1 AND c <> 'headheadheadhead0tailtailtailtail'",
    "naming_blocked": f"SELECT 'd/' || p_name || ' ' || p_partkey || '.txt' AS path, 'case,separator' AS issues, 'd/' || {_TARGET} AS target, p_partkey % 3 = 0 AS blocked FROM part ORDER BY 1",
    "portable_names": f"""WITH n AS (SELECT p_partkey AS id, {_AT(NAMES, 'p_partkey')} AS name FROM part)
      SELECT id, name IN ('fine.txt', '.bashrc', 'a.tar.gz') AS portable, CASE name WHEN 'con.txt' THEN 'con' WHEN 'a?b.md' THEN 'a?b' WHEN 'fine.txt' THEN 'fine' WHEN 'end.' THEN 'end' WHEN 'a.tar.gz' THEN 'a.tar' ELSE name END AS stem,
      CASE name WHEN 'con.txt' THEN 'txt' WHEN 'a?b.md' THEN 'md' WHEN 'fine.txt' THEN 'txt' WHEN 'a.tar.gz' THEN 'gz' ELSE '' END AS ext FROM n""",
    "thai_terms": f"""SELECT p_partkey AS id, {_AT(('โค|ค้|้ด|', 'รา|าย|ยง|งา|าน|', 'ก|', 'สว|วั|ัส|สด|ดี|ีx|', 'plain|', ''), 'p_partkey')} || replace(p_name, ' ', '|') AS terms,
      trim({_AT(('โคด', 'รายงาน', 'ก', 'สวสดx', 'plain', ''), 'p_partkey')} || ' ' || lower(p_name)) AS query FROM part""",
    "repeated_ids": """WITH r AS (SELECT CAST(n_regionkey AS VARCHAR) AS "group", CASE n_nationkey % 4 WHEN 0 THEN 'same' || n_regionkey WHEN 1 THEN 'SAME' || n_regionkey ELSE n_name END AS id FROM nation)
      SELECT "group", id, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1""",
    "repeated_statistics": """WITH r AS (SELECT CAST(n_regionkey AS VARCHAR) AS "group", CASE n_nationkey % 4 WHEN 0 THEN 'same' || n_regionkey WHEN 1 THEN 'SAME' || n_regionkey ELSE n_name END AS id FROM nation)
      SELECT "group", count(*) AS entries, count(*) - count(DISTINCT lower(id)) AS repeated, 2 * count(*) AS aliases FROM r GROUP BY 1""",
}

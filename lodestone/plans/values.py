"""Queries of functions on single values: layouts, names, languages, messages, webhooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import layout as K
from lodestone.functions import values as V
from lodestone.operators import duplicates as D
from lodestone.operators import files as S
from lodestone.operators import naming as N
from lodestone.session import table

RULES = N.Rules(
    unicode="nfc",
    replacements=(("GREEN", "{{colour}}"),),
    variables={"colour": "verdant", "end": "zz"},
    shortcuts={"Blue": "azure"},
    aliases={"WIDGET": "w-{{end}}", "red": "crimson"},
    reposition=(("azure", "back"), ("crimson", "front")),
    separator="-",
    case="lower",
)
ENDINGS = ("rs", "pyi", "JSX", ".mdx", "tsx", "py", "xyz", "toml", "md", "markdown")
MESSAGES = ("Permission denied (os error 13)", "No such file or directory", "Resource BUSY", "stream was not Invalid UTF-8", "disk is on fire")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _layouts(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name")).alias("t"))
    t = F.col("t")
    return p.select("id", K.to_thai(t).alias("thai"), K.to_latin(K.to_thai(t)).alias("latin"), K.wrong_layout(t).alias("wrong"), F.element_at(K.query_forms(t), -1).alias("last_form"))


def _stems(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), N.target_stem(F.col("p_name"), RULES).alias("stem"))


def _values(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"), _pick(ENDINGS, F.col("p_partkey")).alias("ending"), _pick(MESSAGES, F.col("p_partkey")).alias("message"), F.col("p_size").cast("double").alias("size"))
    t = F.col("t")
    return n.select(
        "id",
        V.identity(t).digest.alias("digest"),
        V.hash_hex(t).alias("hex"),
        V.base64_text(t).alias("b64"),
        (V.base64_bytes(F.concat(F.lit("data:text/plain;base64,"), V.base64_text(t))) == t.cast("binary")).alias("round_trip"),
        V.verified(t, F.upper(F.sha2(t, 256))).alias("verified"),
        V.configured_language(F.col("ending")).alias("configured"),
        V.parsed_language(F.col("ending")).alias("parsed"),
        V.comment_mark(V.configured_language(F.col("ending"))).alias("mark"),
        V.issue(F.col("message")).kind.alias("issue"),
        F.array_join(V.listed(F.replace(t, F.lit(" "), F.lit(" ,, "))), "|").alias("listed"),
        V.rerank_text(t, F.lit("about"), F.array(F.lit("a"), F.lit("b"))).alias("rerank"),
        F.size(V.entry_terms(t, F.array(F.lit("a")))).alias("n_terms"),
        V.number(F.when(F.col("size") > 25, F.col("size")).otherwise(F.lit(float("nan")))).alias("number"),
    )


def _dates(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T00:00:00"))).otherwise(F.lit(" "))
    props = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("title"), F.lit("x"))).otherwise(F.create_map(F.lit("due"), F.lit("x")))
    return o.select("o_orderkey", V.is_date(text).alias("date"), V.is_datetime(text, F.lit(None).cast("string")).alias("datetime"), V.timestamp_or_epoch(text).alias("stamp"), F.array_join(V.missing_properties(props, ["title", "due", "tags"]), ",").alias("missing"), V.to_unix(F.col("o_orderdate").cast("timestamp")).alias("unix"))


def _webhooks(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    kind = F.when(k % 5 == 4, "page.renamed").otherwise(_pick(V.EVENTS, k))
    event = F.to_json(F.struct(k.cast("string").alias("id"), kind.alias("type"), F.struct(F.col("user_id").cast("string").alias("id"), F.lit("page").alias("type")).alias("entity")))
    body = F.when(k % 7 == 0, F.concat(F.lit('{"verification_token":"t'), k.cast("string"), F.lit('"}'))).when(k % 7 == 1, F.lit("{}")).otherwise(event)
    w = V.webhook(body)
    return e.select("event_id", w.verification_token.alias("token"), w.kind.alias("kind"), w.entity_id.alias("entity"))


QUERIES = {
    "keyboard_layouts": _layouts,
    "renamed_stems": _stems,
    "single_values": _values,
    "date_properties": _dates,
    "webhook_events": _webhooks,
    "near_name_counters": lambda s, d: D.name_counters(S.of_parts(s, d), threshold=0.6),
}

_T = "CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END"
_QUOTED = K.LATIN_KEYS.replace("'", "''")
_BACK = dict(reversed(list(zip(K.THAI_KEYS, K.LATIN_KEYS, strict=True))))
_TO_THAI = f"translate(lower(t), '{_QUOTED}', '{K.THAI_KEYS}')"
_LATIN = "".join(_BACK.values()).replace("'", "''")


def _at(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][p_partkey % {len(values)} + 1]"


def _case(pairs, column):
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in pairs) + " END"


_CONFIGURED = _case([(e, f"'{n}'") for n, (ends, _) in V.LANGUAGES.items() for e in ends], "lower(ltrim(ending, '.'))")
_PARSED = _case([(e, f"'{n}'") for n in V.PARSED for e in V.LANGUAGES[n][0] if e not in V.SETTINGS_ONLY], "ending")
_MARKS = _case([(n, f"'{m}'") for n, (_, m) in V.LANGUAGES.items() if m], "configured")

ORACLE = {
    "keyboard_layouts": f"""WITH p AS (SELECT p_partkey AS id, {_T} AS t FROM part), q AS (SELECT id, t, {_TO_THAI} AS thai FROM p)
      SELECT id, thai, translate(thai, '{''.join(_BACK)}', '{_LATIN}') AS latin, regexp_full_match(t, '[A-Za-z]+') AS wrong,
      CASE WHEN regexp_full_match(t, '[A-Za-z]+') THEN regexp_replace(thai, '[ัิ-ฺ็-๎]', '', 'g') ELSE lower(t) END AS last_form FROM q""",
    "renamed_stems": """WITH p AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(regexp_replace(p_name, 'green', 'verdant', 'gi'), '[\\s_-]+'), lambda x: x <> '') AS a FROM part),
      q AS (SELECT id, list_transform(a, lambda w: CASE lower(w) WHEN 'blue' THEN 'azure' WHEN 'widget' THEN 'w-zz' WHEN 'red' THEN 'crimson' ELSE w END) AS a FROM p),
      r AS (SELECT id, list_filter(regexp_split_to_array(array_to_string(a, ' '), '[\\s_-]+'), lambda x: x <> '') AS a FROM q),
      b AS (SELECT id, CASE WHEN list_contains(a, 'azure') THEN list_append(list_concat(a[:list_position(a, 'azure') - 1], a[list_position(a, 'azure') + 1:]), 'azure') ELSE a END AS a FROM r),
      f AS (SELECT id, CASE WHEN list_contains(a, 'crimson') THEN list_prepend('crimson', list_concat(a[:list_position(a, 'crimson') - 1], a[list_position(a, 'crimson') + 1:])) ELSE a END AS a FROM b)
      SELECT id, lower(array_to_string(a, '-')) AS stem FROM f""",
    "single_values": f"""WITH n AS (SELECT p_partkey AS id, p_partkey, p_name AS t, {_at(ENDINGS)} AS ending, CAST(p_size AS DOUBLE) AS size FROM part), l AS (SELECT *, {_CONFIGURED} AS configured FROM n)
      SELECT id, sha256(t) AS digest, lower(hex(encode(t))) AS hex, base64(encode(t)) AS b64, true AS round_trip, true AS verified, configured, {_PARSED} AS parsed, {_MARKS} AS mark,
      ['permission_denied', 'not_found', 'locked_or_busy', 'invalid_encoding', 'generic_io'][p_partkey % 5 + 1] AS issue, replace(t, ' ', '|') AS listed, t || ' about a b' AS rerank, CAST(2 AS INTEGER) AS n_terms, CASE WHEN size > 25 THEN size END AS number FROM l""",
    "date_properties": """SELECT o_orderkey, o_orderkey % 3 = 0 AS "date", o_orderkey % 3 = 1 AS "datetime", CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' ELSE '1970-01-01T00:00:00Z' END AS stamp,
      CASE WHEN o_orderkey % 2 = 0 THEN 'due,tags' ELSE 'tags,title' END AS missing, CAST(greatest(epoch(o_orderdate), 0) AS BIGINT) AS unix FROM orders""",
    "webhook_events": f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 't' || event_id END AS token,
      CASE WHEN event_id % 7 < 2 THEN NULL WHEN event_id % 5 = 4 THEN 'other:page.renamed' ELSE {_at(V.EVENTS).replace('p_partkey', 'event_id')} END AS kind, CASE WHEN event_id % 7 >= 2 THEN CAST(user_id AS VARCHAR) END AS entity FROM events""",
    "near_name_counters": """WITH e AS (SELECT DISTINCT lower(p_name) AS name, p_size // 4096 AS bucket FROM part),
      g AS (SELECT DISTINCT bucket, name, unnest(CASE WHEN length(name) <= 3 THEN [name] ELSE list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)) END) AS gram FROM e),
      c AS (SELECT bucket, gram, count(*) AS m FROM g GROUP BY 1, 2), h AS (SELECT g.* FROM g JOIN c USING (bucket, gram) WHERE m BETWEEN 2 AND 256),
      p AS (SELECT DISTINCT a.bucket, a.name AS x, b.name AS y FROM h a JOIN h b ON a.bucket = b.bucket AND a.gram = b.gram AND a.name < b.name)
      SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM e GROUP BY bucket)) AS possible, (SELECT count(*) FROM p) AS candidates,
      (SELECT count(*) FROM p WHERE 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) >= 0.6) AS matches, (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) FROM c WHERE m > 256) AS skipped""",
}

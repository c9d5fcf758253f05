"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import search as S
from lodestone.operators.postings import Index
from lodestone.session import kept_dir, table

WORDS = ["license", "apache", "the", "qui"]
SYNONYMS = {"license": ["licensed", "rights"], "apache": ["gnu"]}


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("text"))


_indexes: dict = {}


def _index(spark, sf) -> Index:
    """The index of a folder's documents, built by the first query of a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("text"), "lang")
        _indexes[key] = Index(spark, kept_dir(spark, "index")).build(docs, X.terms(F.col("text")), "lang")
    return _indexes[key]


def _bm25(spark, sf):
    found = _index(spark, sf).bm25([(w, 1.0) for w in WORDS])
    return S.top(found).select("doc", F.round("score", 6).alias("score"), F.round(S.confidence(F.col("score")), 6).alias("confidence"))


def _scan(spark, sf):
    found = S.bm25(_docs(spark, sf), X.terms(F.col("text")), [(w, 1.0) for w in WORDS])
    return S.top(found).select("doc", F.round("score", 6).alias("score"))


def _grouped(spark, sf):
    return S.top(_index(spark, sf).bm25([(w, 1.0) for w in WORDS], ["en", "fr"])).select("doc", F.round("score", 6).alias("score"))


def _changed(spark, sf):
    """The index after a tenth of the documents left and another tenth came back twice as long."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("text"), "lang")
    index = Index(spark, kept_dir(spark, "index")).build(docs, X.terms(F.col("text")), "lang")
    twice = docs.filter("doc % 10 = 1").withColumn("text", F.concat_ws(" ", "text", "text"))
    index.apply(twice, docs.filter("doc % 10 = 0"), X.terms(F.col("text")), "lang")
    left = index.compact(kept_dir(spark, "index"))
    return S.top(left.bm25([(w, 1.0) for w in WORDS])).select("doc", F.round("score", 6).alias("score"))


def _synonyms(spark, sf):
    found = _index(spark, sf).bm25(S.expand(["license", "apache"], SYNONYMS))
    return S.top(found).select("doc", F.round("score", 6).alias("score"))


def _entries(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.lower("p_name").alias("name"))


def _merged(spark, sf):
    index = _index(spark, sf)
    return S.best_of(("first", index.bm25([("license", 1.0)])), ("second", index.bm25([("licensed", 2.0)]))).select("doc", F.round("score", 6).alias("score"), "match")


def _rerank(spark, sf):
    a = _index(spark, sf).bm25([("licensed", 1.0)])
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").cast("double").alias("relevance"))
    return S.rerank(a, r).select("doc", F.round("score", 6).alias("score"))


def _nearest(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return S.nearest(v, _query_of(v)).select("doc", F.round("score", 5).alias("score"))


def _query_of(v):
    return list(v.filter("doc = 0").first()["embedding"])


QUERIES = {
    "bm25_search": _bm25,
    "bm25_scan": _scan,
    "bm25_groups": _grouped,
    "bm25_changed": _changed,
    "synonym_search": _synonyms,
    "index_statistics": lambda s, d: _index(s, d).totals(),
    "fuzzy_candidates": lambda s, d: S.fuzzy_candidates(_entries(s, d), "green widgit"),
    "fuzzy_search": lambda s, d: S.fuzzy(_entries(s, d), "green widgit", 2, 4096, 1024, 0.5).select("doc", "name", F.round("score", 6).alias("score")),
    "best_match": _merged,
    "rerank": _rerank,
    "nearest_vectors": _nearest,
}

_T = "t AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(trim(lower(text), ' ' || chr(10) || chr(9) || chr(13)), '\\s+'), lambda x: x <> '') AS t FROM documents)"


def _score(terms, name="s", t="t"):
    values = ", ".join(f"('{w}', CAST({x} AS DOUBLE))" for w, x in terms)
    return f"""{name}_q(w, weight) AS (VALUES {values}),
    {name}_n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {t}),
    {name}_c AS (SELECT doc, len(t) AS length, w, weight, len(list_filter(t, lambda x: x = w)) AS tf FROM {t}, {name}_q),
    {name}_d AS (SELECT w, count(*) AS df FROM {name}_c WHERE tf > 0 GROUP BY w),
    {name} AS (SELECT doc, sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM {name}_c JOIN {name}_d USING (w), {name}_n WHERE tf > 0 GROUP BY doc)"""


_E = "e AS (SELECT p_partkey AS doc, lower(p_name) AS name FROM part)"


def _grams(text, n):
    return f"CASE WHEN length({text}) <= {n} THEN [{text}] ELSE list_transform(range(1, length({text}) - {n} + 2), lambda i: substr({text}, i, {n})) END"


def _fuzzy(n, cap, take):
    return f"""{_E}, a AS (SELECT gram, count(*) AS times FROM (SELECT unnest({_grams("'green widgit'", n)}) AS gram) GROUP BY 1),
    h AS (SELECT doc, name, unnest(list_distinct({_grams("name", n)})) AS gram FROM e), m AS (SELECT h.*, times FROM h JOIN a USING (gram)),
    f AS (SELECT gram FROM m GROUP BY 1 HAVING count(*) <= {cap}),
    c AS (SELECT doc, name, CAST(sum(times) AS BIGINT) AS hits FROM m JOIN f USING (gram) GROUP BY 1, 2 ORDER BY hits DESC, doc LIMIT {take})"""


ORACLE = {
    "bm25_search": f"WITH {_T}, {_score([(w, 1.0) for w in WORDS])} SELECT doc, round(score, 6) AS score, round(least(score, 10) / 10, 6) AS confidence FROM s ORDER BY s.score DESC, doc LIMIT 20",
    "bm25_scan": f"WITH {_T}, {_score([(w, 1.0) for w in WORDS])} SELECT doc, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 20",
    "bm25_groups": f"WITH {_T}, {_score([(w, 1.0) for w in WORDS])} SELECT doc, round(score, 6) AS score FROM s JOIN documents ON doc_id = doc WHERE lang IN ('en', 'fr') ORDER BY s.score DESC, doc LIMIT 20",
    "bm25_changed": f"""WITH {_T}, u AS (SELECT doc, CASE WHEN doc % 10 = 1 THEN list_concat(t, t) ELSE t END AS t FROM t WHERE doc % 10 <> 0),
      {_score([(w, 1.0) for w in WORDS], "s", "u")} SELECT doc, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 20""",
    "synonym_search": f"WITH {_T}, {_score([('license', 1.0), ('apache', 1.0), ('licensed', 0.8), ('rights', 0.8), ('gnu', 0.8)])} SELECT doc, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 20",
    "index_statistics": f"WITH {_T}, p AS (SELECT doc, unnest(t) AS term FROM t), c AS (SELECT doc, term, count(*) AS tf FROM p GROUP BY 1, 2) SELECT count(DISTINCT doc) AS docs, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM c",
    "fuzzy_candidates": f"WITH {_fuzzy(2, 4096, 1024)} SELECT * FROM c",
    "fuzzy_search": f"""WITH {_fuzzy(2, 4096, 1024)}, s AS (SELECT doc, name, 1 - levenshtein(name, 'green widgit') / CAST(greatest(length(name), 12) AS DOUBLE) AS score FROM c)
      SELECT doc, name, round(score, 6) AS score FROM s WHERE s.score >= 0.5""",
    "best_match": f"""WITH {_T}, {_score([("license", 1.0)], "a")}, {_score([("licensed", 2.0)], "b")}
      SELECT doc, round(greatest(coalesce(a.score, 0), coalesce(b.score, 0)), 6) AS score, CASE WHEN coalesce(a.score, 0) >= coalesce(b.score, 0) THEN 'first' ELSE 'second' END AS match FROM a FULL JOIN b USING (doc)""",
    "rerank": f"WITH {_T}, {_score([('licensed', 1.0)])} SELECT doc, round(0.4 * score + 6 * CAST(quality AS DOUBLE), 6) AS score FROM s JOIN labels ON doc_id = doc",
    "nearest_vectors": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
      SELECT vec_id AS doc, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, doc LIMIT 10""",
}

"""Keyword search: BM25 over postings, synonyms, fuzzy candidates.

A query meets the postings of its own terms only: the postings are pruned by a broadcast of
the query terms (a query is short by contract) before anything is grouped, and ranking
keeps the best of each task before the exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.duplicates import similarity
from lodestone.session import spread

K1, B = 1.2, 0.75
SYNONYM_WEIGHT = 0.8


def postings(docs: DataFrame, tokens: Column, *more: str) -> DataFrame:
    """doc, more, term, tf, length of docs (doc, more, ...): counted inside each document's sorted terms, without a shuffle."""
    d = docs.select("doc", *more, F.sort_array(tokens).alias("t")).withColumn("length", F.size("t"))
    t = F.col("t")
    d = d.filter("length > 0").withColumn("heads", F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))))
    heads = F.col("heads")
    runs = F.transform(heads, lambda h, k: F.struct(F.get(t, h).alias("term"), (F.coalesce(F.get(heads, k + 1), F.col("length")) - h).cast("bigint").alias("tf")))
    return d.select("doc", *more, "length", F.explode(runs).alias("r")).select("doc", *more, "r.term", "length", "r.tf")


def bm25(docs: DataFrame, tokens: Column, query: list[tuple[str, float]]) -> DataFrame:
    """doc, score of the documents that hold a query term (term, weight); a repeated term adds again.

    The scan keeps (doc, length, counts of the query's terms); the statistics are one row of an
    aggregate over it, read first. Nothing but hits goes further, and nothing is joined.
    """
    terms = sorted({t for t, _ in query})
    t = F.col("t")
    counts = F.array(*[_count(t, w) for w in terms])
    split = spread(docs).select("doc", tokens.alias("t"))
    rows = split.select("doc", F.size("t").alias("length"), counts.alias("tf"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        weight, df, tf = sum(x for t2, x in query if t2 == w), stats[f"df{i}"], F.col("tf")[i]
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        score = score + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    # a filter on counts or scores would be pushed below the projections and split the text anew for each of them
    hits = split.filter(F.arrays_overlap("t", F.array(*map(F.lit, terms)))).select("doc", F.size("t").alias("length"), counts.alias("tf"))
    scored = hits.select("doc", score.alias("score"))
    return scored if all(w > 0 for _, w in query) else scored.filter("score > 0")


def _count(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def top(scored: DataFrame, k: int = 20, *more: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc", *more).limit(k)


def index_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    p = postings(docs, tokens)
    return p.agg(F.count_distinct("doc").alias("docs"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))


def expand(query: list[str], synonyms: dict[str, list[str]]) -> list[tuple[str, float]]:
    """The query's terms at weight 1 and their synonyms at 0.8; the heavier wins."""
    found = {t: 1.0 for t in query}
    for t in query:
        for s in synonyms.get(t, []):
            found.setdefault(s, SYNONYM_WEIGHT)
    return [(t, w) for t, w in found.items()]


def grams(text: Column, n: int) -> Column:
    """Windows of n characters of the query form, repeated ones kept; a short text is one."""
    t = X.query_form(text)
    size = F.char_length(t)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(t)).otherwise(many)


def fuzzy_candidates(entries: DataFrame, query: str, n: int = 2, cap: int = 4096, take: int = 1024) -> DataFrame:
    """doc, name, hits: entries (doc, name) that share grams with the query; grams of over cap entries don't count."""
    spark: SparkSession = entries.sparkSession
    asked = spark.range(1).select(F.explode(grams(F.lit(query), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    held = entries.select("doc", "name", F.explode(F.array_distinct(grams(F.col("name"), n))).alias("gram"))
    met = held.join(F.broadcast(asked), "gram")
    few = met.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") <= cap).select("gram")
    hits = met.join(few, "gram").groupBy("doc", "name").agg(F.sum("times").alias("hits"))
    return hits.orderBy(F.desc("hits"), "doc").limit(take)


def fuzzy(entries: DataFrame, query: str, n: int = 2, cap: int = 4096, take: int = 1024, least: float = 0.6) -> DataFrame:
    found = fuzzy_candidates(entries, query, n, cap, take)
    s = similarity(X.query_form(F.col("name")), F.lit(query.strip().lower()))
    return found.select("doc", "name", s.alias("score")).filter(F.col("score") >= least)


def best_of(*scored: DataFrame) -> DataFrame:
    """doc, score, match: each document's highest score; on a tie the earlier list names the match."""
    rows = None
    for i, (name, df) in enumerate(scored):
        part = df.select("doc", "score", F.lit(name).alias("match"), F.lit(-i).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("doc").agg(F.max(F.struct("score", "rank", "match")).alias("b"))
    return best.select("doc", "b.score", "b.match")


def confidence(score: Column) -> Column:
    return F.least(score, F.lit(10.0)) / 10


def rerank(scored: DataFrame, reranked: DataFrame, hybrid: bool = True) -> DataFrame:
    """doc, score from a reranker's (doc, relevance); documents that it leaves out are dropped."""
    met = scored.join(reranked, "doc")
    new = 0.4 * F.col("score") + 0.6 * 10 * F.col("relevance") if hybrid else 10 * F.col("relevance")
    return met.select("doc", new.alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """doc, score: the k rows (doc, embedding) of highest cosine similarity with query."""
    v = F.col("embedding").cast("array<double>")
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.select("doc", (dot / (norm * length)).alias("score")).orderBy(F.desc("score"), "doc").limit(k)

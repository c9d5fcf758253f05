"""Small relational operators: overlays, compaction, partitions, regrouping, evaluation, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(levels: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """key and fields: for each field the value of the last level that has one that is neither null nor blank."""
    out = levels[0].select(key, *fields)
    for level in levels[1:]:
        upper = level.select(key, *[F.when(F.trim(f) != "", F.col(f)).alias(f"_{f}") for f in fields])
        out = out.join(upper, key, "left").select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])
    return out


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per keys: that of the least order. Partial minima keep hot keys small."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(order, *[c for c in rest if c != order]).alias("_s")
    return rows.select(*keys, packed).groupBy(*keys).agg(F.min("_s").alias("_s")).select(*keys, *[F.col(f"_s.{c}") for c in rest]).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows less those of the keys in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def regroup(blocks: DataFrame, opens: str = "table", inside: str = "table_row") -> DataFrame:
    """blocks (doc, pos, type, ...) with parent: an inside row's last opening block before it, else null.

    A running maximum over each document; a document's blocks are ordered in one task.
    """
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("type") != inside, F.col("pos"))).over(w)
    open_ = F.max(F.when(F.col("type") == opens, F.col("pos"))).over(w)
    return blocks.withColumn("parent", F.when((F.col("type") == inside) & (last == open_), open_))


def evaluate(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """tp, fp, fn, precision, recall of counts (key, n) against expected ones."""
    zero = F.lit(0).cast("bigint")
    j = observed.select(key, F.col("n").alias("o")).join(expected.select(key, F.col("n").alias("e")), key, "full_outer")
    o, e = F.coalesce("o", zero), F.coalesce("e", zero)
    s = j.agg(F.coalesce(F.sum(F.least(o, e)), zero).alias("tp"), F.coalesce(F.sum(F.greatest(o - e, zero)), zero).alias("fp"), F.coalesce(F.sum(F.greatest(e - o, zero)), zero).alias("fn"))
    share = lambda d: F.when(F.col("tp") + d > 0, F.col("tp") / (F.col("tp") + d)).otherwise(0.0)
    return s.select("*", share(F.col("fp")).alias("precision"), share(F.col("fn")).alias("recall"))


def wasted(observations: DataFrame) -> DataFrame:
    """session, wasted: observations of (session, target, digest) beyond the first of each target and digest."""
    same = observations.groupBy("session", "target", "digest").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("session").agg(F.sum(F.col("n") - 1).alias("wasted"))


def evicted(entries: DataFrame, capacity: int) -> DataFrame:
    """session, key of entries (session, key, seen) beyond the capacity last seen."""
    w = Window.partitionBy("session").orderBy(F.desc("seen"), "key")
    return entries.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") > capacity).select("session", "key")


def quiet_periods(events: DataFrame, gap: str) -> DataFrame:
    """key, begin, n: runs of events (key, ts) without a gap between them."""
    g = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("key", F.col("w.start").alias("begin"), "n")


def resolve_terms(queries: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """query, choices of the queries that are an ambiguous term."""
    spark = queries.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in terms.items()], "query string, choices array<string>")
    return queries.join(F.broadcast(table), "query")

"""A kept BM25 index: postings by term in pruned files, documents and what was removed beside them.

``postings`` holds (term, doc, group, tf, length), partitioned by a bucket of the term and sorted
by term inside, so a query reads the row groups of its own terms only. Rows are dealt by ranges
of (bucket, term, doc): a term that most documents hold spreads over many files. ``documents``
holds (doc, group, length). Every build or change is a segment of its own; ``removed`` names the
documents that a segment takes out of those before it. ``compact`` writes what is left anew.

Defined results: a document without terms counts for the statistics and is never found; adding a
document again replaces it; an empty query or an index of no documents finds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.session import spread

BUCKETS = 64
#: Rows of postings in a file, about.
FILE_ROWS = 4_000_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._stats: tuple[int, float] | None = None

    # --- writing ---

    def build(self, docs: DataFrame, tokens: Column, group: str | None = None) -> Index:
        """The first segment, of docs (doc, ...); group names a column to filter by."""
        return self._segment(0, docs, tokens, group)

    def apply(self, docs: DataFrame | None, removed: DataFrame | None, tokens: Column, group: str | None = None) -> Index:
        """A segment that takes out removed (doc) and adds docs; a doc of both is replaced."""
        k = self._documents().agg(F.max("segment")).first()[0] + 1
        out = None if removed is None else removed.select("doc")
        if docs is not None:
            again = docs.select("doc")
            out = again if out is None else out.unionByName(again)
        if out is not None:
            out.distinct().write.parquet(f"{self.path}/removed/segment={k}")
        return self._segment(k, docs, tokens, group) if docs is not None else self._touched(k)

    def _segment(self, k: int, docs: DataFrame, tokens: Column, group: str | None) -> Index:
        named = spread(docs).select("*", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("_group"))
        lengths = named.select("doc", F.col("_group").alias("group"), F.size(tokens).alias("length"), F.lit(k).alias("segment"))
        lengths.write.mode("append").parquet(f"{self.path}/documents")
        rows = S.postings(named, tokens, "_group").withColumnRenamed("_group", "group").withColumn("bucket", _bucket(F.col("term")))
        words = self.spark.read.parquet(f"{self.path}/documents").filter(F.col("segment") == k).agg(F.sum("length")).first()[0] or 0
        files = self._files(words)
        dealt = rows.repartitionByRange(files, "bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc")
        dealt.select("term", "doc", "group", "tf", "length", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={k}")
        return self._touched(k)

    def _files(self, words: int) -> int:
        """Ranges that postings are dealt to: as many as fill files, and enough for all cores; a bucket is in few of them."""
        return max(math.ceil(words / FILE_ROWS), min(self.spark.sparkContext.defaultParallelism, BUCKETS), 1)

    def _touched(self, k: int) -> Index:
        self._stats = None
        return self

    def compact(self, path: str) -> Index:
        """The documents that are left, as one segment in path."""
        new = Index(self.spark, path)
        self._documents().select("doc", "group", "length", F.lit(0).alias("segment")).write.parquet(f"{new.path}/documents")
        rows = self._live(self._all_postings()).drop("segment")
        words = new.spark.read.parquet(f"{new.path}/documents").agg(F.sum("length")).first()[0] or 0
        rows.repartitionByRange(self._files(words), "bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{new.path}/postings/segment=0")
        return new

    # --- reading ---

    def _read(self, part: str) -> DataFrame | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}") if place.getFileSystem(conf).exists(place) else None

    def _all_postings(self) -> DataFrame:
        return self._read("postings")

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("removed")
        if gone is None:
            return rows
        last = gone.groupBy("doc").agg(F.max("segment").alias("until"))
        return rows.join(last, "doc", "left").filter(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def _documents(self) -> DataFrame:
        return self._live(self.spark.read.parquet(f"{self.path}/documents"))

    def statistics(self) -> tuple[int, float]:
        """(documents, mean length), read once."""
        if self._stats is None:
            r = self._documents().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
            self._stats = (r["n"], r["mean"] or 1.0)
        return self._stats

    def postings(self, terms: list[str]) -> DataFrame:
        """term, doc, group, tf, length of some terms: partitions and row groups of other terms aren't read."""
        buckets = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(_bucket(F.col("t")).alias("b")).distinct().collect()
        rows = self._all_postings().filter(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("term").isin(terms))
        return self._live(rows).select("term", "doc", "group", "tf", "length")

    def bm25(self, query: list[tuple[str, float]], groups: list[str] | None = None) -> DataFrame:
        """doc, score of the documents that hold a query term (term, weight), of some groups if given; statistics are of all."""
        weights: dict[str, float] = {}
        for t, w in query:
            weights[t] = weights.get(t, 0.0) + w
        n, mean = self.statistics()
        if not weights or not n:
            return self._documents().select("doc", F.lit(0.0).alias("score")).limit(0)
        rows = self.postings(sorted(weights))
        held = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        if not held:
            return rows.select("doc", F.lit(0.0).alias("score")).limit(0)
        idf = F.create_map(*[x for t, df in held.items() for x in (F.lit(t), F.lit(weights[t] * math.log((n - df + 0.5) / (df + 0.5) + 1)))])
        tf = F.col("tf")
        part = F.element_at(idf, F.col("term")) * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * F.col("length") / mean))
        if groups is not None:
            rows = rows.filter(F.col("group").isin(groups))
        return rows.groupBy("doc").agg(F.sum(part).alias("score")).filter("score > 0")

    def totals(self) -> DataFrame:
        """docs, terms, postings, tokens of the index in one row."""
        p = self._live(self._all_postings())
        return p.agg(F.count_distinct("doc").alias("docs"), F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))

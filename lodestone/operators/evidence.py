"""Measurements, evidence, glossaries: summaries, classification, selection, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of evidence that make up quality, and the one that lowers it.
QUALITY = ("encoding_valid", "lexical_valid", "glossary_exact", "provenance_complete")
RISK = "pattern_risk"
SPLITS = ("train", "validation", "test")
REQUIRED = ("raw_text", "source_ref", "observed_at", "language", "source_kind")


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def nearest_rank(column: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def summary(measured: DataFrame, by: list[str], latency: str, candidates: str, tp: str, fp: str, fn: str) -> DataFrame:
    """Per group: n, min, max, mean, median, p95, p99, stddev, candidates and the scores of the summed counts."""
    x = F.col(latency)
    g = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.avg(x).alias("mean"),
        nearest_rank(latency, 0.5).alias("median"),
        nearest_rank(latency, 0.95).alias("p95"),
        nearest_rank(latency, 0.99).alias("p99"),
        F.stddev_pop(x).alias("stddev"),
        F.avg(candidates).alias("mean_candidates"),
        F.max(fp).alias("max_fp"),
        F.sum(tp).alias("_tp"),
        F.sum(fp).alias("_fp"),
        F.sum(fn).alias("_fn"),
    )
    g = g.withColumn("precision", ratio(F.col("_tp"), F.col("_tp") + F.col("_fp"))).withColumn("recall", ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")))
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("_tp", "_fp", "_fn")


def select_default(candidates: DataFrame, max_fp: int, max_p95: float, strata: list[str]) -> DataFrame:
    """The candidate within the bounds that covers strata: highest f1, then fewest candidates, least p95, least id."""
    asked = F.array(*[F.lit(s) for s in strata]) if strata else F.array().cast("array<string>")
    ok = candidates.filter((F.col("fp") <= max_fp) & (F.col("p95") <= max_p95) & (F.size(F.array_except(asked, "strata")) == 0))
    return ok.orderBy(F.desc("f1"), "candidates", "p95", "id").limit(1)


def classify(evidence: DataFrame, eligible: float = 0.9, review: float = 0.5) -> DataFrame:
    """Per subject of (subject, id, kind, weight, verified): dimensions, aggregate, decision, reasons.

    Unverified evidence or a weight outside 0 to 1 makes the decision 'invalid'.
    """
    if not 0 <= review <= eligible <= 1:
        raise ValueError("thresholds must be 0 <= review <= eligible <= 1")
    best = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0.0)).alias(k) for k in (*QUALITY, RISK)]
    bad = F.bool_or(~F.col("verified") | ~F.col("weight").between(0, 1)).alias("bad")
    g = evidence.groupBy("subject").agg(*best, F.array_sort(F.collect_set("id")).alias("reasons"), bad)
    quality = sum((F.col(k) for k in QUALITY[1:]), F.col(QUALITY[0])) / 4
    g = g.withColumn("aggregate", quality * (1 - F.col(RISK)))
    decision = F.when(F.col("bad"), "invalid").when(F.col("aggregate") >= eligible, "eligible").when(F.col("aggregate") >= review, "review").otherwise("reject")
    return g.withColumn("decision", decision).drop("bad")


def import_rows(lines: DataFrame, mask, normalise) -> DataFrame:
    """lines (line, value) of JSON: line, code (null if accepted) and the fields, text masked and normalised."""
    schema = ", ".join(f"{c} string" for c in REQUIRED) + ", _bad string"
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    blank = F.array_compact(F.array(*[F.when(F.trim(f"r.{c}") == "", F.lit(c)) for c in REQUIRED]))
    code = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "INVALID_JSONL").when(F.size(missing) > 0, "MISSING_REQUIRED_FIELD").when(F.size(blank) > 0, "EMPTY_REQUIRED_FIELD")
    out = parsed.select("line", code.alias("code"), *[F.col(f"r.{c}").alias(c) for c in REQUIRED])
    text = F.when(F.col("code").isNull(), mask(F.col("raw_text")))
    return out.withColumn("raw_text", text).withColumn("normalized_text", normalise(F.col("raw_text")))


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """id, error of (id, source_uri, license, content_sha256, split): blanks, checksums, splits, repeated ids."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    errors = F.array_compact(
        F.array(
            *[F.when(blank(c), F.lit(f"blank {c}")) for c in ("id", "source_uri", "license")],
            F.when(~F.coalesce(F.col("content_sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "checksum"),
            F.when(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split"),
        )
    )
    own = manifest.select("id", F.explode(errors).alias("error"))
    twice = manifest.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated id").alias("error"))
    return own.unionByName(twice)


def glossary_errors(terms: DataFrame, provenance: DataFrame, normalise) -> DataFrame:
    """id, error of (id, term, normalized, provenance_id, confidence): the first check that fails, or none."""
    p = provenance.select(F.col("id").alias("provenance_id"), F.struct("source_uri", "license", "content_sha256").alias("p"))
    met = terms.join(p, "provenance_id", "left")
    incomplete = (F.trim("p.source_uri") == "") | (F.trim("p.license") == "") | ~F.col("p.content_sha256").rlike("^[0-9A-Fa-f]{64}$")
    error = (
        F.when(~F.col("confidence").between(0, 1), "confidence")
        .when(normalise(F.col("term")) != F.col("normalized"), "normalization")
        .when(F.col("p").isNull(), "missing provenance")
        .when(incomplete, "invalid provenance")
    )
    return met.select("id", error.alias("error")).filter("error is not null")

"""An append-only ledger of corrections: what is active follows from what supersedes what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(ledger: DataFrame) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = ledger.filter("supersedes is not null").select(F.col("supersedes").alias("correction_id")).distinct()
    return ledger.join(gone, "correction_id", "left_anti")


def history(ledger: DataFrame, subject: str) -> DataFrame:
    """All rows of a subject with their status, in order."""
    gone = ledger.filter("supersedes is not null").select(F.col("supersedes").alias("correction_id")).distinct().withColumn("gone", F.lit(True))
    rows = ledger.filter(F.col("subject") == subject).join(gone, "correction_id", "left")
    return rows.withColumn("status", F.when(F.col("gone"), "superseded").otherwise("active")).drop("gone").orderBy("seq")


def conflicts(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """claims (subject, assertion) that an active correction rejects, with its first correction_id."""
    bad = active(ledger).groupBy("subject", F.col("rejected_assertion").alias("assertion")).agg(F.min_by("correction_id", "seq").alias("correction_id"))
    return claims.join(bad, ["subject", "assertion"])


def supersede(ledger: DataFrame, replacements: DataFrame) -> DataFrame:
    """The ledger with replacements appended; each has to supersede an active row."""
    ok = replacements.join(active(ledger).select(F.col("correction_id").alias("supersedes")), "supersedes", "left_semi")
    return ledger.unionByName(ok)

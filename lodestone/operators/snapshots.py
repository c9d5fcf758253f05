"""Snapshots of file rows: differences, application, fingerprints, versions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "1.2.0"
#: Columns whose change makes a file modified.
CHANGING = ("size", "modified", "kind", "extension")


def diff(before: DataFrame, after: DataFrame, key: str = "path", changing=CHANGING) -> DataFrame:
    """(key, status) with status added, modified, removed or unchanged. One shuffle of each side by key."""
    sides = [d.select(key, F.struct(*changing).alias(s), F.lit(True).alias(f"in_{s}")) for d, s in ((before, "old"), (after, "new"))]
    joined = sides[0].join(sides[1], key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    return joined.select(key, status.alias("status"))


def apply(before: DataFrame, changes: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """before with the removed rows gone and the modified and added ones taken from after."""
    touched = changes.filter("status != 'unchanged'").select(key)
    fresh = after.join(changes.filter("status in ('added', 'modified')").select(key), key, "left_semi")
    return before.join(touched, key, "left_anti").unionByName(fresh)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("bytes"))


def fingerprint(root: Column, hidden: Column, depth: Column) -> Column:
    """SHA-256 of the scan's root, hidden flag and depth, parted by zero bytes; no depth is the largest."""
    zero = F.lit(bytes(1))
    flag = F.when(hidden, F.lit(b"\x01")).otherwise(F.lit(bytes(1)))
    deep = F.coalesce(F.reverse(F.unhex(F.lpad(F.hex(depth), 16, "0"))), F.lit(b"\xff" * 8))
    return F.sha2(F.concat(root.cast("binary"), zero, flag, zero, deep.cast("binary")), 256)


def save(files: DataFrame, path: str, root: str, hidden: bool = False, depth: int | None = None) -> None:
    """The rows as Parquet and one row of metadata beside them."""
    files.write.mode("overwrite").parquet(f"{path}/files")
    spark = files.sparkSession
    meta = spark.createDataFrame([(VERSION, root, hidden, depth)], "version string, root string, hidden boolean, depth bigint")
    meta = meta.withColumn("fingerprint", fingerprint(F.col("root"), F.col("hidden"), F.col("depth")))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> tuple[DataFrame, dict]:
    """(rows, metadata) of a saved snapshot; earlier versions get what they lack, unknown ones are refused."""
    meta = spark.read.parquet(f"{path}/meta")
    if "fingerprint" not in meta.columns:
        meta = meta.withColumn("fingerprint", fingerprint(F.col("root"), F.col("hidden"), F.col("depth")))
    row = meta.first().asDict()
    if row["version"] not in ("1.1.0", VERSION):
        raise ValueError(f"unknown snapshot version {row['version']}")
    return spark.read.parquet(f"{path}/files"), json.loads(json.dumps(row)) | {"version": VERSION}


def refresh(files: DataFrame, path: str, root: str, version: int, hidden: bool = False, depth: int | None = None) -> DataFrame:
    """Saves files as snapshot ``version`` below path and returns the changes against the one before.

    Without one, or if that had other scan settings, every file is added. Versions have folders
    of their own, so the older one can still be read while the changes are worked out.
    """
    from pyspark.errors import AnalysisException

    save(files, f"{path}/{version}", root, hidden, depth)
    try:
        old, meta = load(files.sparkSession, f"{path}/{version - 1}")
    except AnalysisException:
        old, meta = None, {}
    if (meta.get("root"), meta.get("hidden"), meta.get("depth")) != (root, hidden, depth):
        return files.select("path", F.lit("added").alias("status"))
    return diff(old, load(files.sparkSession, f"{path}/{version}")[0])

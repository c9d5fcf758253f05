"""File rows: path, name, extension, size, modified, kind, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: source/id.lang. Unused columns never leave the scan."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return d.select(
        F.concat("source", F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.col("lang").alias("extension"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.col("doc_id") * 86_400).alias("modified"),
        F.lit("file").alias("kind"),
        F.col("text").alias("content"),
    )


def of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as files: brand/key, named by the part."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("extension"),
        F.col("p_size").cast("bigint").alias("size"),
        F.col("p_partkey").alias("modified"),
        F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("content"),
    )

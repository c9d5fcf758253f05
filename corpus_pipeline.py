"""A corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ngram_join, pii, sentencepiece_codec, toxicity
from lodestone.llm.common import fresh_dir, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out fold, doesn't reject.

    A null or empty text matches nothing and stays; without labels, or without one of toxicity,
    all stay; repeated rows stay or go together. Columns beyond those of documents are dropped.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.fit(toxicity.sample(docs, labels))
    scored = toxicity.score(docs.select(*COLUMNS), lexicon, keep_text=True)
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: the one of the least id, a null id last.

    Rows without words link with nothing and all stay; of equal rows with words one stays.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars is that of the new text.

    A null text stays null, with a null n_chars. No row goes.
    """
    masked = pii.find(docs.select(*COLUMNS), mask=True)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, twice at most.

    A null source is a source of its own; documents without words count as of no size; equal
    rows are taken one by one. An empty table stays empty.
    """
    return mixing.apply(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document; a null or empty text has no ids."""
    return sentencepiece_codec.token_ids(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: No stage but the fourth can be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Language identification by compression.

A raw-content zstandard dictionary is built for every label from a bounded sample of
labelled texts. A text is compressed in pieces with each dictionary and gets the label whose
total is smallest; the margin to the second smallest gives the score, and a margin below
``min_margin`` marks the prediction as rejected.

Fitting reads ``SAMPLE_TEXTS`` distinct whole texts per label at most, chosen by hash, and takes
them as long as they sum to ``SAMPLE_CHARS`` characters (the first one always), so copies count
once and reruns agree; the number of labels is taken to be
small, as each is a dictionary in every worker. Prediction reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected;
with no labels learned every text is. Ties go to the first label in order. Rows are judged
alone: no shuffle, and a lost task is run again. Extra columns pass through, but those named
like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import held_out, read, tidied

#: Distinct texts of a label that are sampled, and the characters that they sum to, at most.
SAMPLE_TEXTS = 128
SAMPLE_CHARS = 200_000
#: Texts are compressed this many bytes at a time, so that a long text keeps leaning on the dictionary.
PIECE = 4096
LEVEL = 6
MIN_MARGIN = 0.01
#: The margin at which the score is 1 - 1/e.
MARGIN_SCALE = 0.05
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def fit(rows: DataFrame, text: str = "text", label: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A dictionary's content for every label of rows."""
    known = rows.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.col(text).alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    # about eight times the sample passes by hash, the first of which are taken
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 8 * texts / max(1, n))))])
    near = known.filter(F.pmod("h", F.lit(1_000_003)) <= F.element_at(share, F.col("label")) * 1_000_003)
    by_hash = Window.partitionBy("label").orderBy("h", "text")
    first = near.dropDuplicates(["label", "h", "text"]).withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= texts)
    first = first.withColumn("chars", F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("k") == 1) | (F.col("chars") <= chars))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("label", "k").collect():
        found.setdefault(r["label"], []).append(r["text"])
    return {k: "\n".join(v).encode() for k, v in sorted(found.items())}


class Predictor:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.labels = sorted(dictionaries)
        self.compress = []
        for k in self.labels:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(map(len, map(c, pieces))) for c in self.compress]

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        import math

        if not self.labels or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, True
        if len(self.labels) == 1:
            return self.labels[0], 1.0, False
        ranked = sorted(zip(self.sizes(text), self.labels, strict=True))
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], 1 - math.exp(-margin / MARGIN_SCALE), margin < min_margin


_predictors: dict[int, Predictor] = {}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without text, with lang_pred string, score double and rejected boolean."""
    outs = ["lang_pred", "score", "rejected"]
    rest = [c for c in docs.columns if c != text and c not in outs]
    src = docs.select(*rest, text)
    dictionaries = {k: v.decode().lower().encode() for k, v in dictionaries.items()}
    key = hash(tuple(sorted(dictionaries.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _predictors:
            _predictors.clear()
            _predictors[key] = Predictor(dictionaries)
        predict = _predictors[key].predict
        for batch in batches:
            got = [predict(t.as_py(), min_margin) for t in batch.column(len(rest))]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=[*rest, *outs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in rest)
    return src.mapInArrow(tidied("langid", run), (schema + ", " if rest else "") + "lang_pred string, score double, rejected boolean")


def op8_langid(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out: Column = held_out("doc_id")
    learned = fit(docs.filter(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), learned).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op8_langid": op8_langid}

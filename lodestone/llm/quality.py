"""Quality rules: line-first cleaning, then rules on the whole text. DataFrame functions only.

Every line of a text is judged on its own (punctuation, navigation, boilerplate);
lines that fail go, and a document that loses too much of its text goes with them.
The base statistics are of the whole text: words, characters in words, symbols,
repeated lines and words inside repeated three-word windows.

Defined results: a null or empty text has no words, fails the base rules and is not
kept; its cleaned text is empty. Lines without a word are neither judged nor counted as
lost. Repeated rows get equal results each. Columns named like an output are replaced,
all others pass. Nothing is shuffled: each row is judged alone, so skewed keys don't matter.
A very long text costs n log n in its words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_SEPARATORS, let, read


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the document rules."""

    #: A line of this many words or more has to end like a sentence...
    long_line_words: int = 40
    #: ...and any line may have at most this share of marks among its visible characters.
    max_mark_share: float = 0.15
    #: A line is navigation if it holds this many separators and few words between them.
    min_separators: int = 2
    max_words_per_part: float = 3.0
    #: A document stays if it loses at most this share of its characters in words.
    max_lost_share: float = 0.5
    min_words: int = 50
    #: Percent of words inside repeated three-word windows above which a text fails.
    max_repeat_percent: int = 50


#: Phrases that mark a line as boilerplate when the line is short.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "is licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "enable javascript",
    "requires javascript",
    "lorem ipsum",
    "click here",
    "sign in to",
    "subscribe to our newsletter",
)
BOILERPLATE_MAX_CHARS = 120
#: Symbols that the base statistics count.
SYMBOLS = "[#*$%&|<>]"
#: Marks that prose uses rarely, and the ends of a sentence.
MARKS = r"[!#$%&*+/<=>@\\^_`{|}~\[\]»›•·→]"
SENTENCE_END = tuple(".!?:;…。！？)\"'”’»]")
SEPARATORS = r"[|»›•·>→]"
VISIBLE = r"[^ \t-\r]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SEPARATORS), "")


def _line_ok(rules: LineRules):
    """Cheap tests come first: each later one is reached by few lines."""

    def ok(line: Column) -> Column:
        def judge(s: Column) -> Column:
            marks, blanks = F.regexp_count(s, F.lit(MARKS)), F.regexp_count(s, F.lit(" "))
            parts = F.regexp_count(s, F.lit(SEPARATORS))
            dense = marks > F.length(s) * rules.max_mark_share
            open_end = ~F.right(s, F.lit(1)).isin(*SENTENCE_END) & (blanks + 1 >= rules.long_line_words)
            navigation = (parts >= rules.min_separators) & (blanks + 1 <= (parts * 2 + 1) * rules.max_words_per_part)
            boilerplate = (F.length(s) <= BOILERPLATE_MAX_CHARS) & s.rlike("(?i)" + "|".join(BOILERPLATE))
            return ~(boilerplate | open_end | dense | (s.rlike(SEPARATORS) & navigation))

        return let(F.rtrim(line), judge)

    return ok


def _from(array: str, start: int) -> Column:
    return F.slice(array, F.lit(start), F.greatest(F.size(array), F.lit(1)))


def _repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside three-word windows that occur at least twice.

    The windows' hashes are sorted with their place in the low bits, so that equal ones
    become neighbours; neighbours count only if their words agree.
    """
    w = F.col(words)
    # the mask covers a place; the other bits but the sign keep the hash
    df = df.withColumn("_mask", F.expr(f"shiftleft(1L, length(bin(size({words})))) - 1"))
    df = df.withColumn("_high", F.lit(2**63 - 1).bitwiseXOR(F.col("_mask")))
    df = df.withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn("_h", F.zip_with(F.zip_with("_h", _from("_h", 2), lambda a, b: F.xxhash64(a, b)), _from("_h", 3), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.col("_high")).bitwiseOR(i.cast("bigint")))))
    mask = F.col("_mask")
    near = F.zip_with("_s", _from("_s", 2), lambda a, b: F.when(a.bitwiseXOR(b) <= mask, F.struct(a.bitwiseAND(mask).cast("int").alias("a"), b.bitwiseAND(mask).cast("int").alias("b"))))
    agree = lambda x: reduce(and_, (F.get(w, x.a + k) == F.get(w, x.b + k) for k in range(3)))
    df = df.withColumn("_n", F.filter(F.filter(near, lambda x: x.isNotNull()), agree))
    df = df.withColumn("_p", F.sort_array(F.array_union(F.transform("_n", lambda x: x.a), F.transform("_n", lambda x: x.b))))
    p = F.col("_p")
    gaps = F.zip_with(p, _from("_p", 2), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("bigint"))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return df.withColumn(out, F.when(F.size(p) > 0, covered).otherwise(F.lit(0).cast("bigint"))).drop("_mask", "_high", "_h", "_s", "_n", "_p")


OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_dup_lines", "n_bad_lines", "lost_share", "cleaned_text", "base_failed", "kept"]


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with cleaned_text, lost_share and the base statistics and verdicts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines (long),
    base_failed, kept (boolean), lost_share (double) and cleaned_text (string).
    """
    # the caller's columns wait in one struct, so that no helper takes the place of one
    passed = [c for c in docs.columns if c not in OUTPUTS]
    df = docs.select(F.struct(*[docs[c] for c in passed]).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_t"))
    df = df.withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("n_words", F.size("_w").cast("bigint"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
    df = df.withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint"))
    df = _repeats(df, "_w", "n_repeat_words").drop("_w")
    df = df.withColumn("_lines", F.split("_t", "\n"))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(VISIBLE)))
    df = df.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint"))
    df = df.withColumn("_bad", F.filter("_full", lambda x: ~_line_ok(rules)(x)))
    df = df.withColumn("n_bad_lines", F.size("_bad").cast("bigint"))
    lost = F.length(F.array_join(F.flatten(F.transform("_bad", words_of)), ""))
    df = df.withColumn("lost_share", F.when(F.col("word_chars") > 0, lost / F.col("word_chars")).otherwise(F.lit(0.0)))
    good = F.filter("_lines", lambda x: ~x.rlike(VISIBLE) | _line_ok(rules)(x))
    df = df.withColumn("cleaned_text", F.when(F.size("_bad") == 0, F.col("_t")).otherwise(F.array_join(good, "\n")))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost_share))
    return df.select(*[F.col("_row").getField(c).alias(c) for c in passed], *OUTPUTS)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "lost_share"]


def op6_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select(*COLUMNS)


QUERIES = {"op6_quality": op6_quality}

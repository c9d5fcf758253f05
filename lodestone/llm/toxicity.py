"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding removes invisible characters, lower-cases, and maps look-alike letters of other
scripts, accents and digit substitutions to plain letters, one character to one, so that
matches can be checked for word ends in the unfolded text. The lexicon's entries are words
and word beginnings with their log-odds, learned from labelled texts; a match covered by an
exception phrase does not count. The matched weight, normalised by length, gives the score
by a logistic curve fitted to the same sample.

Fitting reads ``SAMPLE`` labelled rows at most, chosen by a hash of the id, and each distinct
text once; the lexicon holds ``TERMS`` entries at most. Scoring reads whole texts.

Defined results: a null or empty text matches nothing and gets the curve's lowest score;
without labels, or without a label 1, every score is 0. Several labels of one id count as
toxic if one is. Scoring shuffles nothing; fitting joins against a sample of bounded size.
Extra columns pass, those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, held_out, read, tidied

#: Labelled rows that a fit reads, and entries of the lexicon.
SAMPLE = 20_000
TERMS = 4_000
#: Texts of label 1 that an entry must occur in, the least log-odds, and the least likelihood
#: ratio (G) against chance: among a million candidates few reach it without meaning.
MIN_TEXTS = 4
MIN_ODDS = 1.5
MIN_RATIO = 25.0
#: Clean texts that a phrase around an entry must occur in, and none of label 1, to be an exception; and their number.
EXCEPTION_TEXTS = 8
EXCEPTIONS = 1_000
#: Characters of the beginnings that stand for a family of words.
STEMS = range(4, 11)
#: Share of the sample's texts, in thousandths, on which the curve is fitted; the lexicon learns from the rest.
CURVE_SHARE = 300

#: Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ո": "n", "α": "a", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs written for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"}
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
WORD = re.compile(r"[^\W_]+(?:[@$!|+€£]+[^\W_]+)*")


_BEFORE = re.compile(r"[^\W_]+ [^\W_]+\Z")
_AFTER = re.compile(r"[^\W_]+ [^\W_]+")
_WORD_END = re.compile(r"[^\W_]*")


class _Fold(dict):
    """A translation table that works out each character once."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)[:1].lower()
        c = plain if len(plain) == 1 and plain.isalnum() else c
        c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
        self[code] = ord(c)
        return self[code]


_table = _Fold()


def fold(text: str) -> tuple[str, str]:
    """(lower-cased text without invisible characters, the same folded, of equal length)."""
    low = text.lower()
    if not low.isascii():
        low = INVISIBLE.sub("", low)
    return low, low.translate(_table)


@dataclass(frozen=True)
class Lexicon:
    """weights: entry -> weight; an entry ending in * is a word's beginning. curve: of score()."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        # a word, the family of its beginning and an exception may share a key
        kinds: dict[str, list[tuple[int, float | None, bool]]] = {}
        for entry, w in lexicon.weights.items():
            if key := entry.rstrip("*"):
                kinds.setdefault(key, []).append((len(key), w, not entry.endswith("*")))
        for phrase in lexicon.exceptions:
            f = fold(phrase)[1]
            if f:
                kinds.setdefault(f, []).append((len(f), None, True))
        for key, values in kinds.items():
            self.automaton.add_word(key, values)
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in the folded text, without those inside an exception phrase."""
        if not len(self.automaton):
            return []
        low, folded = fold(text)
        hits, spared = [], []
        n = len(low)
        for last, values in self.automaton.iter(folded):
            size = values[0][0]
            begin, end = last + 1 - size, last + 1
            if begin and (low[begin - 1].isalnum() or low[begin - 1] in "@$" and begin > 1 and low[begin - 2].isalnum()):
                continue
            for _, weight, whole in values:
                if whole and end < n and low[end].isalnum():
                    continue
                (spared if weight is None else hits).append((begin, end, weight))
        if spared:
            # the furthest end of the exceptions that begin at or before a hit covers it, or none does
            spared.sort(key=lambda x: x[0])
            begins, ends = [x[0] for x in spared], list(accumulate((x[1] for x in spared), max))
            hits = [h for h in hits if not ((k := bisect_right(begins, h[0])) and ends[k - 1] >= h[1])]
        # overlapping entries of one word count once, by the heaviest
        best: dict[int, tuple[int, int, float]] = {}
        for h in hits:
            if h[0] not in best or h[2] > best[h[0]][2]:
                best[h[0]] = h
        return list(best.values())

    def features(self, text: str) -> tuple[float, float]:
        """(matched weight, by the logarithm of the length: what stands against it, and the length itself)."""
        mass = sum(h[2] for h in self.matches(text))
        return math.log1p(mass), math.log1p(text.count(" "))

    def score(self, text: str) -> float:
        a, b, c = self.lexicon.curve
        mass, length = self.features(text)
        z = a * mass - b * length + c if self.lexicon.weights else -math.inf
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, label = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {fold(w)[1] for w in set(WORD.findall(fold(t)[0]))}
            word += found
            label += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(label, pa.int32())], names=["word", "y"])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Distinct (text, y) of at most ``most`` labelled ids that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return rows.select("text", "y").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.max("y").alias("y"), F.first("text").alias("text")).select("text", "y")


def fit(rows: DataFrame, exceptions: tuple[str, ...] = (), terms: int = TERMS) -> Lexicon:
    """A lexicon from rows (text string, y int) of bounded number."""
    rows = checkpointed(rows.select("text", "y", (F.pmod(F.xxhash64("text"), F.lit(1000)) < CURVE_SHARE).alias("later")))
    total = {r["y"]: r["n"] for r in rows.filter("not later").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad:
        return Lexicon({}, exceptions)
    words = checkpointed(rows.filter("not later").select("text", "y").mapInArrow(tidied("toxicity", _words), "word string, y int").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")))
    starts = words.select(F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS])).alias("stem"), "bad", "good").filter("stem is not null")
    families = starts.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    found = words.select(F.col("word").alias("entry"), "bad", "good").unionAll(families.select(F.concat("stem", F.lit("*")), "bad", "good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    by_chance = (F.col("bad") + F.col("good")) / (bad + good)
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (by_chance * bad)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (by_chance * max(good, 1)))).otherwise(0.0))
    found = found.filter(F.col("bad") >= MIN_TEXTS).select("entry", odds.alias("w"), ratio.alias("g"))
    top = found.filter((F.col("w") >= MIN_ODDS) & (F.col("g") >= MIN_RATIO)).orderBy(F.desc("g"), "entry").limit(terms).collect()
    lexicon = Lexicon({r["entry"]: r["w"] for r in top}, exceptions)
    exceptions = (*exceptions, *_exceptions(rows.filter("not later").select("text", "y"), lexicon))
    return Lexicon(lexicon.weights, exceptions, _curve(rows.filter("later").select("text", "y"), Lexicon(lexicon.weights, exceptions)))


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of two words around a match that clean texts have and texts of label 1 don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for batch in batches:
            phrase, label = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, found = fold(t)[1], set()
                for begin, end, _ in m.matches(t):
                    if before := _BEFORE.search(folded, max(0, begin - 40), end):
                        found.add(before.group() + _WORD_END.match(folded, end).group())
                    if after := _AFTER.match(folded, begin):
                        found.add(after.group())
                phrase += found
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.string()), pa.array(label, pa.int32())], names=["phrase", "y"])

    seen = rows.mapInArrow(tidied("toxicity", run), "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    clean = seen.filter((F.col("bad") == 0) & (F.col("n") >= EXCEPTION_TEXTS)).orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS)
    return [r["phrase"] for r in clean.collect()]


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic weights of matched weight and length, by Newton's method on the sample's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for batch in batches:
            f = [m.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), batch.column(1)], names=["mass", "length", "y"])

    data = np.array([(0.0, 0.0, 0.0), *(tuple(r) for r in rows.mapInArrow(tidied("toxicity", run), "mass double, length double, y int").collect())], float)
    x = np.column_stack([data[:, 0], -data[:, 1], np.ones(len(data))])
    y, w = data[:, 2], np.zeros(3)
    penalty = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


_matchers: dict[int, Matcher] = {}


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score double and predicted int; without text unless keep_text."""
    outs = ["score", "predicted"]
    rest = [c for c in docs.columns if c not in outs and (c != text or keep_text)]
    src = docs.select(*rest, F.col(text).alias("_scored"))
    key = hash((tuple(lexicon.weights.items()), lexicon.exceptions, lexicon.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(lexicon)
        m = _matchers[key]
        for batch in batches:
            s = [m.score(t.as_py() or "") for t in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*rest, *outs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(tidied("toxicity", run), (schema + ", " if rest else "") + "score double, predicted int")


def op9_toxicity(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(sample(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), lexicon)


QUERIES = {"op9_toxicity": op9_toxicity}

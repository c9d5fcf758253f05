"""Quality, SentencePiece, personal data, language, toxicity, licenses: brute force and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, licenses, pii, quality, sentencepiece_codec, toxicity


def repeats(w):
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    return len(covered)


def base(t):
    w = re.findall(r"[^ \t-\r]+", t or "")
    full = [s for s in (t or "").split("\n") if re.search(r"[^ \t-\r]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), repeats(w)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_base(spark, docs, odd):
    for rows in (docs, odd):
        out = quality.clean_lines(rows.select("doc_id", "text")).collect()
        assert len(out) == rows.count()
        for r in out:
            assert tuple(r[c] for c in BASE) == base(r["text"])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_quality_lines(spark):
    good = "This is a fine line of ordinary words, as prose has them. " * 6
    text = "\n".join([good, "Home | News | Sport | About", "All rights reserved.", "BUY!! NOW!! CHEAP!! ###"])
    row = quality.clean_lines(spark.createDataFrame([(1, text)], "_t int, text string").withColumnRenamed("_t", "kept")).first()
    assert (row["cleaned_text"], row["n_bad_lines"], row["base_failed"]) == (good, 3, True)


def test_quality_empty(none):
    assert quality.clean_lines(none).count() == 0


def test_sentencepiece_equals_library():
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    rnd = random.Random(4)
    odd = ["", " ", "  a", "a  ", "\n", "\0x", "日本語 ①ﬁ", "▁▁a▁", "<s> </s> <unk> <0x41>", "😀😀 a", "x" * 5000, "  " * 50 + "x"]
    odd += ["".join(rnd.choice(" ab▁\n日é😀<0x41>~") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    for t, (ids, begins, ends) in zip(odd, c.encode_many(odd), strict=True):
        want = c.sp.encode(t)
        assert ids.tolist() == want
        assert c.decode(ids) == c.sp.decode(want)
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all()


def test_character_map():
    """A map made by hand: 'ab' -> 'X', 'a' -> 'yy', in the double-array format."""
    units = {}

    def node(offset, label=0, leaf=False):
        return (offset << 10) | (0x100 if leaf else 0) | label

    units[0] = node(1)
    a = 1 ^ ord("a")
    units[a] = node(a ^ 256, ord("a"), True)
    units[256] = 0 | (1 << 31)
    b = 256 ^ ord("b")
    units[b] = node(b ^ 600, ord("b"), True)
    units[600] = 3 | (1 << 31)
    import struct

    array = struct.pack(f"<{1024}I", *[units.get(i, 0) for i in range(1024)])
    m = sentencepiece_codec.CharMap(struct.pack("<I", len(array)) + array + b"yy\0X\0")
    assert m.longest(b"abc", 0) == (2, b"X")
    assert m.longest(b"ac", 0) == (1, b"yy")
    assert m.longest(b"c", 0) is None


def test_sentencepiece_digests(docs, odd, none):
    c = sentencepiece_codec.codec(sentencepiece_codec.default_model())
    for rows in (docs.limit(60), odd, none):
        rows = rows.withColumn("n_tokens", F.lit("clash"))
        for r in sentencepiece_codec.digests(rows.select("doc_id", "n_tokens", "text", F.col("text").alias("own")), sentencepiece_codec.default_model()).collect():
            ids = c.sp.encode(r["own"] or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(c.sp.decode(ids).encode()).hexdigest()
    out = sentencepiece_codec.encode(odd.select("doc_id", "text"), sentencepiece_codec.default_model()).collect()
    assert all(r["ids"] == c.sp.encode(r["text"] or "") for r in out)


EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(PHONE, t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans(docs):
    rnd = random.Random(2)
    parts = ["a", "b.", "@", "@", "1", "22", "255", ".", " ", "-", "+", "(", ")", "4111111111111111", "é", "\n"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30)))
        assert pii.base_spans(t) == brute_spans(t)
    for r in docs.select("text").collect():
        assert pii.base_spans(r["text"]) == brute_spans(r["text"])


def test_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "1 " * 150_000):
        pii.base_spans(t)


def test_field(docs):
    field = pii.train()
    rows = pii.labelled_rows()
    assert all(field.viterbi([field.emissions(t)])[0].tolist() == y for t, y in rows)
    assert field.islands
    t = "ring (988) 555-2485 or 988-555-2485. Not 12-14 or 2021-03-14; bob [at] site [dot] example [dot] net"
    assert [t[a:b] for _, a, b in pii.added_spans([t], [[]], field)[0]] == ["(988) 555-2485", "988-555-2485", "bob [at] site [dot] example [dot] net"]
    texts = [r["text"] for r in docs.select("text").limit(50).collect()] + [t, "", "x (1) y 2 z [a] b"]
    bases = [pii.base_spans(x) for x in texts]
    whole = pii.Field(field.weights, field.transitions)
    whole.islands = False
    assert pii.added_spans(texts, bases, field) == pii.added_spans(texts, bases, whole)


def test_viterbi_brute():
    import itertools

    import numpy as np

    field = pii.train(steps=60)
    rnd = np.random.default_rng(1)
    for _ in range(5):
        e = rnd.normal(size=(4, len(pii.LABELS))) * 3
        score = lambda y: field.transitions[0, y[0]] + e[0, y[0]] + sum(field.transitions[a, b] + e[k + 1, b] for k, (a, b) in enumerate(zip(y, y[1:])))  # noqa: E731, B023
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
        assert field.viterbi([e])[0].tolist() == list(best)


def test_pii_rows(odd, none):
    out = pii.find(odd.withColumn("spans", F.lit(1)), mask=True)
    assert out.count() == odd.count() and out.columns.count("spans") == 1
    assert [r["text"] for r in out.filter("doc_id = 1").collect()] == [None]
    assert pii.find(none).count() == 0
    assert pii.masked("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"


def test_langid(docs, odd, none):
    from lodestone.llm.common import held_out

    learned = langid.fit(docs.filter(~held_out("doc_id")))
    out = langid.identify(docs.filter(held_out("doc_id")).select("doc_id", "lang", "text"), learned).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in out)
    assert right >= 0.9 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd.select("doc_id", "text"), learned).collect()}
    assert got[1] == got[2] == got[4] == "und" and got[5] in learned
    assert langid.fit(none) == {}
    assert {r["lang_pred"] for r in langid.identify(odd.select("doc_id", "text"), {}).collect()} == {"und"}


def test_folding():
    assert toxicity.fold("IDI0T іdіоt 1d!ot İ")[1][:17] == "idiot idiot idiot"
    low, folded = toxicity.fold("zero​width É")
    assert low == "zerowidth é" and folded == "zerowidth e"


def test_toxicity_matches():
    m = toxicity.Matcher(toxicity.Lexicon({"scum": 2.0, "lowe*": 1.0}, ("pond scum",), (1.0, 0.1, -0.5)))
    found = lambda t: [t[a:b] for a, b, _ in m.matches(t)]
    assert found("you $cum, loweitat!") == ["$cum", "lowe"]
    assert found("pond scum and scummy flower") == []
    assert m.score("") < m.score("scum scum scum")


def test_toxicity_learns(spark):
    import zlib

    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = [rnd.choice(words) for _ in range(40)]
        for _ in range(3 * toxic):
            t.insert(rnd.randrange(40), rnd.choice(["blorg", "blorgish", "blorger"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    lexicon = toxicity.fit(toxicity.sample(docs, lab))
    out = toxicity.score(docs, lexicon).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)


def test_toxicity_odd(odd, none, spark):
    lab = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    for d in (odd, none):
        lexicon = toxicity.fit(toxicity.sample(d, lab))
        out = toxicity.score(d.withColumn("score", F.lit("clash")), lexicon).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(odd, toxicity.Lexicon({})).agg(F.max("score")).first()[0] == 0


def brute_licenses(t):
    out = []
    for a, b in licenses.segments(t):
        g = licenses.bigrams(licenses.words(t[a:b]))
        out += [(n, a, b) for n, x in licenses.TEMPLATES if g and licenses.dice(g, licenses.bigrams(licenses.words(x))) >= licenses.THRESHOLD]
    return sorted(out)


def test_licenses(docs, odd, none):
    s = licenses.Scanner()
    texts = [r["text"] for r in docs.select("text").collect()] + [t for _, t in licenses.TEMPLATES] + ["", "a", "x\n\nAll rights reserved!\n\ny"]
    for t in texts:
        assert sorted((n, a, b) for _, _, n, a, b in s.matches(t)) == brute_licenses(t)
    assert all(any(m[2] == name for m in s.matches(text)) for name, text in licenses.TEMPLATES)
    out = licenses.scan(odd.withColumn("dice", F.lit("x")))
    assert out.count() == odd.count() and out.filter("license is not null").count() == 0
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("text", ["", "only one line.", "\n\n\n"])
def test_segments(text):
    assert all(text[a:b].strip() == text[a:b] for a, b in licenses.segments(text))


def test_exceptions_are_learned(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, labels = [], []
    for i in range(800):
        t = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            t[5:5] = ["blorg"]
            t[20:20] = ["blorg"]
        elif i % 16 == 1:
            t[9:9] = ["saint", "blorg"]
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = toxicity.fit(toxicity.sample(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")))
    assert "saint blorg" in lexicon.exceptions
    m = toxicity.Matcher(lexicon)
    assert m.score(rows[1][1]) < 0.5 < m.score(rows[0][1])

"""The methods against plain ways: normalisation by the library's own maps, naive matching, naive compression, texts beyond old bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, pii, quality, sentencepiece_codec, toxicity


def normaliser(rule, squeeze):
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    n = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    proto = pb.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    c = object.__new__(sentencepiece_codec.Codec)
    c.map = sentencepiece_codec.CharMap(proto.normalizer_spec.precompiled_charsmap)
    c.dummy, c.squeeze, c.escape = True, squeeze, True
    return n, c


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_normalisation_equals_library(rule, squeeze):
    n, c = normaliser(rule, squeeze)
    rnd = random.Random(8)
    texts = ["", "a", "①ﬁ Ａ", "éx", "  a  b ", "　x　", "ﷺ", "ÀÉ ㎏", "ｶﾞ", "日本"]
    texts += ["".join(rnd.choice("aB 　①ﬁéＡｶﾞ日é㎏\t\n") for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    for t in texts:
        got, came = c.normalise(t)
        assert got == n.normalize(t), t
        data = got.encode()
        assert len(came) == len(data) + 1 if data else True
        assert (np.diff(came) >= 0).all() and (not data or came[-1] <= len(t.encode()))
        # a stretch of the source between two borders normalises to what lies between them
        if not squeeze and data:
            cuts = [k for k in range(3, len(data)) if came[k] > came[k - 1] and (data[k] & 0xC0) != 0x80]
            for a, b in zip([3, *cuts], [*cuts, len(data)], strict=True):
                piece = t.encode()[came[a] : came[b] if b < len(data) else len(t.encode())].decode()
                assert c.normalise(piece)[0].encode()[3:] == data[a:b]


def naive_matches(lexicon, text):
    low, folded = toxicity.fold(text)
    inside = lambda i: 0 <= i < len(low) and low[i].isalnum()
    begins = lambda i: not i or not (inside(i - 1) or low[i - 1] in "@$" and inside(i - 2))

    def places(key, whole):
        return [(i, i + len(key)) for i in range(len(folded)) if key and folded.startswith(key, i) and begins(i) and not (whole and inside(i + len(key)))]

    spared = [p for e in lexicon.exceptions for p in places(toxicity.fold(e)[1], True)]
    best = {}
    for entry, w in lexicon.weights.items():
        for a, b in places(entry.rstrip("*"), not entry.endswith("*")):
            if not any(c <= a and b <= d for c, d in spared) and (a not in best or w > best[a][2]):
                best[a] = (a, b, w)
    return sorted(best.values())


def test_matches_equal_naive_ones():
    rnd = random.Random(6)
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc*": 2.0, "b": 3.0, "ca b": 1.5, "a*": 0.5}, ("ab c", "b ab", "c"), (1.0, 0.1, -0.5))
    m = toxicity.Matcher(lexicon)
    for _ in range(3000):
        t = "".join(rnd.choice("aAbc  4@$.é​") for _ in range(rnd.randint(0, 40)))
        assert sorted(m.matches(t)) == naive_matches(lexicon, t), t


def test_many_hits_and_exceptions():
    lexicon = toxicity.Lexicon({"scum": 2.0}, ("pond scum",), (1.0, 0.1, -0.5))
    assert len(toxicity.Matcher(lexicon).matches("pond scum scum " * 30_000)) == 30_000


def test_language_by_plain_compression():
    import zstandard

    rnd = random.Random(3)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zug um zug fahren wir".split(), "cc": "uno dos tres cuatro".split()}
    learned = {k: " ".join(rnd.choice(w) for _ in range(3000)).encode() for k, w in words.items()}
    p = langid.Predictor(learned)
    for k, w in words.items():
        text = " ".join(rnd.choice(w) for _ in range(3000))
        data = text.encode()
        plain = []
        for name in sorted(learned):
            d = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False)
            plain.append(sum(len(c.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)))
        assert np.allclose(p.sizes(text), plain, rtol=0.1)
        assert p.predict(text)[0] == sorted(learned)[int(np.argmin(plain))] == k


def test_language_samples_are_whole_texts(spark):
    rows = [("x", f"{'word ' * 2000}{i}") for i in range(40)] + [("y", "kurz " * 90_000)]
    learned = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert all(t in {x for _, x in rows} for v in learned.values() for t in v.decode().split("\n"))
    assert len(learned["x"]) <= langid.SAMPLE_CHARS + 100 and len(learned["y"]) == 450_000


def test_shapes_of_long_tokens():
    assert pii.shape("a1" * 100 + "@" + "b" * 500) == "a91" * 100 + "@a"
    assert pii.shape("é" * 5000) == "a"


def test_spelt_address_needs_a_domain():
    assert not pii.plausible("email", "was [at] home") and pii.plausible("email", "bob (at) home (dot) org") and pii.plausible("email", "bob at site dot example dot net")


def test_quality_columns_that_clash(spark):
    names = ["_t", "_w", "_lines", "_row", "_bad", "_h", "n_words"]
    df = spark.createDataFrame([(1, "a fine line.\n" * 60, *names)], ", ".join(["doc_id int, text string", *(f"`{n}` string" for n in names)]))
    row = quality.clean_lines(df).first().asDict()
    assert [row[n] for n in names[:-1]] == names[:-1] and row["n_words"] == 180


def test_quality_of_many_lines(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("Home | News | "), i.cast("string"))), "\n").alias("text"))
    row = quality.clean_lines(df).select("n_bad_lines", F.length("cleaned_text").alias("n")).first()
    assert row["n_bad_lines"] == 60_000 and row["n"] == 0


def test_islands_equal_whole_texts():
    field = pii.train()
    whole = pii.Field(field.weights, field.transitions)
    whole.islands = False
    rnd = random.Random(12)
    parts = ["a", "word", "e.g.x", "De%%%", "x:y", "mail", "at", "(at)", "[dot]", "org", "12-14", "(988)", "555-2485", "+1", "bob@site", "é", "3", "tel:", "***", "$$$", "\"q\""]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(800)]
    bases = [pii.base_spans(t) for t in texts]
    assert pii.added_spans(texts, bases, field) == pii.added_spans(texts, bases, whole)

"""Front matter, Word documents, terminals, matcher, token counts, signatures, mutation: shapes that the tables can't show."""

import hashlib
import hmac
import itertools

import pytest
from pyspark.sql import functions as F

from lodestone.functions import layout, subsequence, terminal, tokens, values
from lodestone.operators import contracts, frontmatter, naming
from lodestone.sources import docx, mutation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("yaml", "error"),
    [
        ("a: 1", "wrong_type: a"),
        ("a:\n  value: 1", "missing_field: a.type"),
        ("a:\n  type: 3", "wrong_type: a.type"),
        ("a:\n  type: formula", "unknown_type: formula"),
        ("a:\n  type: number\n  value: x", "wrong_type: a.value"),
        ("a:\n  type: multi_select\n  values:\n  - 1", "wrong_type: a.values"),
        ("a:\n  type: date\n  value: 2024-01-01\n  end: 3", "wrong_type: a.end"),
        ("a:\n  type: title", "missing_field: a.value"),
        ("- a\n- b", "invalid_yaml"),
        ("a b", "invalid_yaml"),
    ],
)
def test_malformed_properties(yaml, error):
    with pytest.raises(frontmatter.Malformed, match=error.replace(".", r"\.")):
        for k, v in frontmatter.parse_yaml(yaml).items():
            frontmatter.decode(k, v)


def test_properties_read_back():
    p = {"a": ("number", None), "b c": ("rich_text", "x: y # z"), "d": ("multi_select", []), "e": ("custom", {"k": [1, "two"]}), "f": ("date", {"start": "2024-01-01"}), "g": ("select", None), "h": ("email", "a@b.c"), "i": ("title", "12"), "j": ("number", 1.5)}
    again = {k: frontmatter.decode(k, v) for k, v in frontmatter.parse_yaml(frontmatter.write_yaml(p)).items()}
    assert again == p and frontmatter.write_yaml({}) == ""
    assert {k: frontmatter.from_json(frontmatter.to_json(*v)) for k, v in p.items() if k not in "eg"} == {k: v for k, v in p.items() if k not in "eg"}
    assert frontmatter.from_json({"type": "formula", "formula": {"number": 3}}) == ("custom", {"type": "formula", "formula": {"number": 3}})


def test_word_documents(spark):
    df = spark.createDataFrame([("a", b"no zip"), ("b", None), ("c", docx.write_bytes([]))], "doc string, content binary")
    got = {r["doc"]: (r["type"], (r["error"] or "")[:10]) for r in docx.read(df).collect()}
    assert got == {"a": (None, "BadZipFile"), "b": (None, "BadZipFile")}


def test_terminal():
    g = terminal.Grid(3, 10, keep=2).feed("".join(f"line {i}\n" for i in range(6)))
    assert g.screen() == "line 4\nline 5" and g.history == ["line 2", "line 3"] and g.truncated
    assert terminal.Grid(2, 4).feed("abcdef").screen() == "abcd\nef"
    assert terminal.Grid(3, 9).feed("one\ntwo\x1b[2Jx\x1b[Hy\tz").screen() == "y       z\n   x"
    assert terminal.Grid(2, 9).feed("abc\x1b[1Kd\x1b]0;title\x07e").screen() == "   de"
    assert terminal.spans("a\x1b[31;1mb\x1b[0mc\x1b[0md\x1b[92me") == [{"text": "a", "color": None, "bold": False}, {"text": "b", "color": "red", "bold": True}, {"text": "cd", "color": None, "bold": False}, {"text": "e", "color": "bright_green", "bold": False}]


def best_alignment(text, pattern):
    s = subsequence
    exact, best = any(c.isupper() for c in pattern), None
    for at in itertools.combinations(range(len(text)), len(pattern)):
        if not all(text[i] == p if exact else text[i].lower() == p.lower() for i, p in zip(at, pattern, strict=True)):
            continue
        total = 0
        for k, i in enumerate(at):
            b = text[i - 1] if i else ""
            bonus = s.HEAD if not i else s.BREAK if b in s._SEPARATORS else s.CAMEL if text[i].isupper() and b.islower() else 0
            total += s.MATCH + bonus * (s.FIRST if not k else 1) + (s.OTHER_CASE if text[i] != pattern[k] else 0)
            if k:
                gap = i - at[k - 1] - 1
                total += s.CONSECUTIVE if not gap else s.GAP_OPEN + (gap - 1) * s.GAP_WIDEN
        best = total if best is None else max(best, total)
    return best


def test_subsequence(spark):
    for text in ("fooBar_baz", "a b ab", "AAbbAab", "", "keyWordKey"):
        for pattern in ("ab", "fb", "Ab", "b", "key", "abab", "kk"):
            assert subsequence.score(text, pattern) == best_alignment(text, pattern), (text, pattern)
    assert subsequence.score("x", "") == 0
    assert one(spark, subsequence.best_score(F.array(F.lit("zzz"), F.lit("abc"), F.lit("a_b_c")), "abc")) == subsequence.score("abc", "abc")
    assert one(spark, subsequence.best_score(F.lit(None).cast("array<string>"), "abc")) is None


def test_token_count(spark):
    vocabulary = pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.tiktoken")
    texts = ["hello world", "", "<|endoftext|>", "ภาษา " * 50]
    want = [len(tokens.encoding(path, vocabulary.PATTERN).encode_ordinary(t)) for t in texts]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(tokens.token_count(F.col("t"), path, vocabulary.PATTERN).alias("n"))
    assert [r["n"] for r in df.collect()] == [*want, None]


def test_signatures(spark):
    good = "sha256=" + hmac.new(b"token", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("token", b"body", good), ("token", b"bodi", good), ("token", b"body", good[7:]), ("token", b"body", "sha256=zz"), (None, b"body", good)], "t string, b binary, h string")
    assert [r["x"] for r in df.select(values.signed(F.col("t"), F.col("b"), F.col("h")).alias("x")).collect()] == [True, False, False, False, False]


def test_layouts(spark):
    assert one(spark, layout.to_thai(F.lit("Kok"))) == "สนส"
    assert one(spark, layout.to_latin(F.lit("ำุน"))) == "e6o"
    assert one(spark, layout.wrong_layout(F.lit("api-docs"))) is False


def test_base64(spark):
    assert one(spark, values.base64_bytes(F.lit("data:image/png;base64,aGk"))) == b"hi"
    assert one(spark, values.base64_bytes(F.lit("a"))) is None and one(spark, values.base64_bytes(F.lit("é!"))) is None


def test_settings():
    assert naming.settings_errors({"unicode": "nfd", "case": "lower", "separator": "dot", "words": {"min": 3, "max": 1}, "stemRegex": "(", "extensions": [".md"], "similarity": {"name": {"threshold": 2}}, "length": {"stem": {"min": 2, "max": 2}}}) == [
        "unsupported unicode value nfd", "unsupported separator value dot", "similarity threshold must be between 0 and 1: 2", "words min cannot exceed max", "invalid stemRegex (: missing ), unterminated subpattern at position 0", "extensions must be non-empty values without a leading dot or blank",
    ]
    assert naming.settings_errors({}) == []
    policy = {"fuzzyMinSimilarity": 0.5, "fuzzyCandidateLimit": 1, "fuzzyNgramSize": 2, "maxFuzzyNgramPostings": 3}
    assert contracts.search_policy_errors(policy) == [] and contracts.search_policy_errors({**policy, "fuzzyNgramSize": 0}) == contracts.search_policy_errors({**policy, "fuzzyMinSimilarity": float("nan")}) == ["INVALID_SEARCH_POLICY"]
    assert contracts.normal_profile(dict(contracts.NORMAL_PROFILE)) and not contracts.normal_profile({})


@pytest.mark.parametrize("action", mutation.ACTIONS)
def test_mutation(tmp_path, action):
    root, backup = tmp_path / "root", tmp_path / "backup"
    (root / "d").mkdir(parents=True)
    for name in ("a", "d/b"):
        (root / name).write_bytes(b"same")
    plan = [{"path": "d/b", "canonical": "a", "sha256": hashlib.sha256(b"same").hexdigest(), "rejection": None}, {"path": "gone", "canonical": "a", "sha256": None, "rejection": None}]
    journal = mutation.execute(plan, str(root), str(backup), action)
    assert len(journal.entries) == 1 and (root / "d/b").exists() == (action == "hard_link")
    assert action != "hard_link" or (root / "d/b").samefile(root / "a")
    assert mutation.rollback(journal) == 1 and mutation.rollback(journal) == 0
    assert (root / "d/b").read_bytes() == b"same" and not (root / "d/b").samefile(root / "a")


def test_mutation_refuses(tmp_path):
    (tmp_path / "a").write_bytes(b"new")
    with pytest.raises(PermissionError):
        mutation.execute([{"path": "a", "rejection": "protected"}], str(tmp_path), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="changed"):
        mutation.execute([{"path": "a", "canonical": "c", "sha256": "0" * 64}], str(tmp_path), str(tmp_path / "b"), "delete")
    assert (tmp_path / "a").exists()


def test_ignore_files_and_hard_links(spark, tmp_path):
    import os

    from lodestone.operators import duplicates
    from lodestone.sources import inventory

    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/top.txt\nbuild/\n# note\ndocs/**/draft?.md\n")
    (tmp_path / "sub" / "build").mkdir(parents=True)
    (tmp_path / "docs" / "a" / "b").mkdir(parents=True)
    (tmp_path / "sub" / ".ignore").write_text("local.txt\n!special.log\n[ab]x.txt\n")
    for name in ("a.log", "keep.log", "top.txt", "sub/top.txt", "sub/build/x.txt", "sub/local.txt", "sub/special.log", "sub/ax.txt", "sub/cx.txt", "docs/draft1.md", "docs/a/b/draft2.md", "docs/final.md"):
        (tmp_path / name).write_text(name)
    os.link(tmp_path / "keep.log", tmp_path / "sub" / "linked")
    got = inventory.inventory(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["docs/final.md", "keep.log", "sub/cx.txt", "sub/linked", "sub/special.log", "sub/top.txt"]
    assert inventory.inventory(spark, str(tmp_path), ignore=False).count() == 13
    assert sorted((r["path"], r["n"]) for r in duplicates.hard_links(got).collect()) == [("keep.log", 2), ("sub/linked", 2)]
    content = spark.createDataFrame([("keep.log", b"x"), ("sub/linked", b"x"), ("docs/final.md", b"y"), ("sub/cx.txt", b"y")], "path string, content binary").withColumn("size", F.lit(1))
    kinds = duplicates.content_kinds(duplicates.content_members(content), got).collect()
    assert sorted((r["kind"], r["n"]) for r in kinds) == [("hard_links", 2), ("same_content", 2)]

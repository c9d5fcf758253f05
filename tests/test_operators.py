import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions import text as X
from lodestone.operators import admission, documents, duplicates, evidence, filters, grep, naming, registry, routing, snapshots
from lodestone.sources import inventory


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "bytes_"), [("50MB", 50 << 20), ("1.5k", 1536), ("7", 7), ("2T", 2 << 40)])
def test_size_literal(text, bytes_):
    assert filters.size_literal(text) == bytes_


def test_query_language(spark):
    files = spark.createDataFrame(
        [("one/report.md", "report.md", "md", 1, 10, "file"), ("two/report.txt", "report.txt", "txt", 10000, 20, "file"), ("x/a.MD", "a.MD", "MD", 512, 30, "binary")],
        "path string, name string, extension string, size bigint, modified bigint, kind string",
    )
    ask = lambda q: sorted(r["path"] for r in filters.find(files, q).collect())
    assert ask("ext:.md") == ["one/report.md", "x/a.MD"]
    assert ask("report size>=10000") == ["two/report.txt"]
    assert ask("size<512 after:10") == ["one/report.md", "x/a.MD"]
    assert ask("dup:name") == ["one/report.md", "two/report.txt"]
    assert len(filters.parse("ext:pdf size>50MB dup:content report").explanation) == 4
    with pytest.raises(ValueError):
        filters.parse("size>lots")


def test_content_stages(spark):
    a = bytearray(256 * 1024)
    b = bytearray(a)
    b[102_400] = 1
    rows = [("a", bytes(a)), ("b", bytes(b)), ("c", bytes(a)), ("d", b"x"), ("e", b"y"), ("f", None)]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("size", F.octet_length("content").cast("bigint"))
    assert [r["items"] for r in duplicates.by_content(files).collect()] == [["a", "c"]]
    counts = duplicates.stage_counts(files).first().asDict()
    assert counts == {"files": 6, "size_candidates": 5, "partial_candidates": 3, "full_candidates": 2, "unreadable": 1}


def test_snapshot_round_trip(spark, tmp_path):
    schema = "path string, size bigint, modified bigint, kind string, extension string"
    before = spark.createDataFrame([("a.txt", 1, 1, "file", "txt"), ("gone.txt", 1, 1, "file", "txt"), ("same.txt", 1, 1, "file", "txt")], schema)
    after = spark.createDataFrame([("a.txt", 2, 1, "file", "txt"), ("new.txt", 1, 1, "file", "txt"), ("same.txt", 1, 1, "file", "txt")], schema)
    assert {r["status"] for r in snapshots.refresh(before, str(tmp_path), "/r", 0).collect()} == {"added"}
    changes = snapshots.refresh(after, str(tmp_path), "/r", 1)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"a.txt": "modified", "gone.txt": "removed", "new.txt": "added", "same.txt": "unchanged"}
    assert sorted(snapshots.apply(before, changes, after).collect()) == sorted(after.collect())


def test_grep_lines(spark):
    files = spark.createDataFrame([("f", "one\r\ntwo hit\nthree\nfour\nhit é hit\n"), ("g", "none"), ("h", None)], "path string, content string")
    got = sorted(grep.grep(files, ["hit"], 1).collect(), key=lambda r: r["line"])
    assert [(r["line"], r["col"], r["before"], r["after"]) for r in got] == [(2, 5, ["one"], ["three"]), (5, 1, ["four"], [])]


def test_names(spark):
    assert one(spark, names.stem(F.lit(".bashrc"))) == ".bashrc"
    assert one(spark, names.stem(F.lit("a.tar.gz"))) == "a.tar"
    assert one(spark, names.extension(F.lit("A.PDF"))) == "pdf"
    assert one(spark, names.separators(F.lit(" a_b  c-"))) == "a-b-c"
    assert one(spark, names.portable(F.lit("con.txt"))) is False
    assert one(spark, names.within(F.lit("/root2/x"), ["/root"])) is False


def test_text(spark):
    assert one(spark, X.terms(F.lit("โค้ด Python"))) == ["โค", "ค้", "้ด", "Python"]
    assert one(spark, X.normalise(F.lit("  É́a  B c "))) == "é́a b c"
    assert one(spark, X.mask(F.lit("a@b.co 1.2.3.4 0812345678 /home/me/x"))) == "[EMAIL] [IP_ADDRESS] [PHONE] [HOME]/x"
    assert one(spark, X.integrity(F.lit(b"%PDF-1"), F.lit("txt"))) == "mismatch"
    assert one(spark, X.integrity(F.lit(b"\x89PNG\r\n\x1a\n"), F.lit("png"))) == "valid"
    assert one(spark, X.integrity(F.lit(b""), F.lit("png"))) == "corrupt"
    assert one(spark, X.binary(F.lit(b"a\x00"))) is True
    assert one(spark, X.binary(F.lit(b"\x10\x01"))) is False


def test_admission_session():
    s = admission.Session()
    assert [s.judge("f", "h") for _ in range(4)] == ["pass", "reference", "reference", "warn"]
    assert [s.judge("g", "1"), s.judge("k", "1")] == ["pass", "block"]
    s.outcome()
    assert s.judge("k", "1") == "pass"


def test_events(spark):
    rows = [("a", 1, "created"), ("a", 2, "modified"), ("b", 1, "created"), ("b", 2, "deleted"), ("c", 1, "deleted"), ("c", 2, "created")]
    got = admission.coalesce_events(spark.createDataFrame(rows, "path string, seq bigint, kind string"))
    assert {r["path"]: r["change"] for r in got.collect()} == {"a": "created", "c": "created"}


def test_classify(spark):
    rows = [("s", "1", "encoding_valid", 1.0, True), ("s", "2", "lexical_valid", 0.9, True), ("s", "3", "glossary_exact", 1.0, True), ("s", "4", "provenance_complete", 1.0, True), ("t", "5", "lexical_valid", 0.9, False)]
    got = evidence.classify(spark.createDataFrame(rows, "subject string, id string, kind string, weight double, verified boolean"))
    assert {r["subject"]: r["decision"] for r in got.collect()} == {"s": "eligible", "t": "invalid"}


def test_import_rows(spark):
    good = '{"raw_text": "Mail a@b.co", "source_ref": "s", "observed_at": "t", "language": "en", "source_kind": "k"}'
    lines = spark.createDataFrame([(1, good), (2, "{broken"), (3, '{"raw_text": "x"}'), (4, good.replace('"en"', '" "'))], "line int, value string")
    got = {r["line"]: (r["code"], r["normalized_text"]) for r in evidence.import_rows(lines, X.mask, X.normalise).collect()}
    assert got == {1: (None, "mail [email]"), 2: ("INVALID_JSONL", None), 3: ("MISSING_REQUIRED_FIELD", None), 4: ("EMPTY_REQUIRED_FIELD", None)}


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,aliases,note\nreport, report | รายงาน|,n\n")
    row = registry.from_csv(spark, str(tmp_path / "r.csv"), "g").first()
    assert (row["id"], row["aliases"], row["extra"]) == ("report", ["report", "รายงาน"], '{"note":"n"}')
    proofs = spark.createDataFrame([("a", "^x", ["xy"], ["y"]), ("b", "^x", ["y"], ["z"]), ("c", "^x", [], ["z"])], "id string, pattern string, accepted array<string>, rejected array<string>")
    assert {r["id"]: r["proven"] for r in registry.rule_proofs(proofs).collect()} == {"a": True, "b": False, "c": False}


def test_route(spark):
    rows = [(1, "short"), (2, "a" * 200), (3, "thread panicked at x\nstack backtrace:\n  0: y" + " z" * 50), (4, "ordinary words of many kinds, " * 5), (5, None)]
    got = {r["doc"]: r["mode"] for r in routing.route(spark.createDataFrame(rows, "doc int, content string")).collect()}
    assert got == {1: "default", 2: "aggressive", 3: "safe", 4: "default", 5: "default"}


def test_documents(spark):
    t = one(spark, documents.write_table(F.array(F.lit("a|b")), F.array(F.array(F.lit("1"), F.lit("2")))))
    assert t == "| a\\|b |  |\n| --- | --- |\n| 1 | 2 |"
    m = one(spark, documents.front_matter(F.lit("---\r\na: 1\r\n---\r\nbody")))
    assert (m["yaml"], m["body"]) == ("a: 1\n", "body")
    assert one(spark, documents.front_matter(F.lit("---\nopen"))).yaml is None


def test_naming(spark):
    rules = naming.Rules(case="lower", separator="-", front="b")
    assert one(spark, naming.target(F.lit(" A b.TXT"), rules)) == "b-a.txt"
    assert one(spark, naming.issues(F.lit("con.txt"), rules)) == ["portability"]


def test_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_text("hello")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "y").write_text("y")
    os.symlink(tmp_path / "b.bin", tmp_path / "link")
    got = {r["path"]: (r["extension"], r["size"], r["kind"]) for r in inventory.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a/x.TXT": ("txt", 5, "file"), "b.bin": ("bin", 2, "binary")}
    assert {r["text"] for r in inventory.contents(spark, str(tmp_path / "a")).select("text").collect()} == {"hello"}


def test_streaming_admission(spark, tmp_path):
    from lodestone.streaming import admission as stream

    rows = [("s", i, "f" if i % 2 else "g", "h") for i in range(8)] + [("t", i, f"x{i}", "h") for i in range(4)]
    schema = "session string, seq bigint, target string, digest string"
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate((df.filter("seq < 3"), df.filter("seq >= 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.admit(source).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["session"], r["seq"])
    assert sorted(spark.table("admitted").collect(), key=key) == sorted(admission.admit(df).collect(), key=key)


def test_marks(spark):
    assert one(spark, X.strip_ansi(F.lit("\x1b[31mred\x1b[0m old\rnew"))) == "new"
    assert one(spark, X.alert(F.lit("> [!warning] x"))) == "WARNING"
    assert one(spark, X.alert(F.lit("plain"))) is None
    assert tuple(one(spark, X.target(F.lit("file://a/b")))) == ("file", "a/b")
    assert one(spark, X.target(F.lit("document://a"))) is None
    assert one(spark, X.attribute(F.lit('<x color="red" c="1">'), "color")) == "red"
    assert one(spark, X.to_yaml(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "---\na: 1\nb: 2\n---\n"


def test_table_writers(spark):
    header, rows = F.array(F.lit("a"), F.lit("long")), F.array(F.array(F.lit('x,"y'), F.lit("1")))
    assert one(spark, documents.aligned_table(header, rows)) == '| a    | long |\n| ---- | ---- |\n| x,"y | 1    |'
    assert one(spark, documents.csv_lines(header, rows)) == 'a,long\n"x,""y",1'
    df = spark.createDataFrame([(1, 'a,b\r\n1,"x,y"\n2,z\n')], "doc int, text string")
    assert [tuple(r["row"]) for r in documents.read_csv(df, "a int, b string").orderBy("pos").collect()] == [(1, "x,y"), (2, "z")]


def test_registry_round_trip(spark, tmp_path):
    rows = [("g", 0, "report", ["monthly"], ["hello"], "d"), ("g", 1, "hello", [], [], None)]
    entries = spark.createDataFrame(rows, "group string, pos int, id string, aliases array<string>, related array<string>, description string")
    registry.save(entries, str(tmp_path / "r"))
    assert sorted(registry.load_saved(spark, str(tmp_path / "r")).collect()) == sorted(entries.collect())
    assert registry.json_schema({"id": {"required": True, "max": 3}})["required"] == ["id"]
    assert registry.broken_relations(entries).count() == 0


def test_source_outline(spark):
    code = spark.createDataFrame([("a.py", "import os\ndef go(x):\n  pass\n"), ("b.rs", "use std::fs;\npub async fn run() {}\nstruct S;")], "path string, content string")
    assert sorted((r["path"], r["kind"], r["name"], r["line"]) for r in documents.definitions(code).collect()) == [("a.py", "def", "go", 2), ("b.rs", "fn", "run", 2), ("b.rs", "struct", "S", 3)]
    assert sorted(r["target"] for r in documents.imports(code).collect()) == ["os", "std::fs"]


def test_folds_in_stretches(spark, monkeypatch):
    import random

    from lodestone.operators import admission

    rnd = random.Random(4)
    steps = [(k, i, rnd.choice([-0.3, -0.15, 0.02, 0.5])) for k in "abc" for i in rnd.sample(range(200), 40)]
    events = [(k, i, rnd.choice(["created", "modified", "deleted"])) for k, i, _ in steps]
    want, last = {}, {}
    for k, _, d in sorted(steps):
        want[k] = min(max(want.get(k, 0.5) + d, 0.1), 1.0)
    for k, _, e in sorted(events):
        a = last.get(k, "")
        last[k] = e if not a else "" if (a, e) == ("created", "deleted") else "created" if (a, e) == ("created", "modified") else e
    for size in (1, 7, 4096):
        monkeypatch.setattr(admission, "CHUNK", size)
        got = admission.aggressiveness(spark.createDataFrame(steps, "key string, seq bigint, delta double")).collect()
        assert {r["key"]: round(r["level"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
        got = admission.coalesce_events(spark.createDataFrame(events, "path string, seq bigint, kind string")).collect()
        assert {r["path"]: r["change"] for r in got} == {k: v for k, v in last.items() if v}

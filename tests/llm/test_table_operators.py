"""Media, HTML, mixing, n-gram join, pipeline: brute force, exact round trips and odd rows."""

import hashlib
import html
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, html_extract, media, mixing, ngram_join

# --- media ---


def test_png_round_trip():
    for data in (b"", b"x", b"a" * 576, bytes(range(256)) * 30):
        payload, n = media.decode_png(media.encode_png(data))
        assert payload == media.padded(data) and n == len(data)
        assert len(media.feature(payload)) == 16
    broken = bytearray(media.encode_png(b"abc"))
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(broken))


def test_media_table(spark, docs, odd, none, monkeypatch):
    for marks, rows in ((3_000, docs.limit(80)), (1 << 20, odd), (1 << 20, none)):
        monkeypatch.setattr(media, "MARK_BYTES", marks)
        path = common.fresh_dir(spark, "media-test")
        media.store(rows, path)
        out = media.described(media.load(spark, path, range_bytes=20_000, batch_bytes=5_000)).collect()
        want = []
        for r in rows.select("doc_id", "text").collect():
            p = media.padded((r["text"] or "").encode())
            want.append(("" if r["doc_id"] is None else str(r["doc_id"]), len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        assert sorted(tuple(r)[:5] for r in out) == sorted(want)


def test_media_appends_and_overwrites(spark, docs):
    path = common.fresh_dir(spark, "media-again")
    media.store(docs.limit(2), path)
    media.store(docs.limit(2), path)
    assert media.load(spark, path).count() == 4
    rows = docs.limit(3).select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("payload"))
    rows.write.format("media_archive").mode("overwrite").option("path", path).save()
    out = media.described(media.load(spark, path)).collect()
    want = {str(r["doc_id"]): hashlib.sha256(media.encode_png(r["text"].encode())).hexdigest() for r in docs.limit(3).collect()}
    assert {r["name"]: r["media_sha256"] for r in out} == want
    assert len({r["feature"] for r in out}) >= 1


def test_feature_by_cells():
    payload = media.padded(b"abc" * 700)
    cells = [payload[k * len(payload) // 72 : (k + 1) * len(payload) // 72] for k in range(72)]
    mean = [sum(c) / len(c) for c in cells]
    bits = "".join("1" if mean[9 * r + c + 1] > mean[9 * r + c] else "0" for r in range(8) for c in range(8))
    assert media.feature(payload) == f"{int(bits, 2):016x}"


def test_media_ranges_read_their_entries(tmp_path):
    writer = media._Writer({"path": str(tmp_path)})
    rows = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(300)]), pa.array([bytes([i % 256]) * (i * 37 % 900) for i in range(300)], pa.binary())], names=["name", "payload"])
    for marks in (1, 2_000, 1 << 20):
        media.MARK_BYTES, before = marks, media.MARK_BYTES
        writer.overwrite = True
        writer.commit([writer.write(iter([rows]))])
        media.MARK_BYTES = before
        for size in (500, 7_000, 1 << 20):
            reader = media._Reader({"path": str(tmp_path), "range_bytes": str(size)})
            got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column(0).to_pylist()]
            assert got == [f"m{i}" for i in range(300)]
            spans = [p.last - p.first for p in reader.partitions()]
            assert marks > 1 or sum(spans) < 3 * sum(len(media.entry(media.Member(f"m{i}", 0, 0, 0))) for i in range(300)) + 100 * len(spans)


def test_media_archives_are_zip(spark, docs):
    path = common.fresh_dir(spark, "media-zip")
    media.store(docs.limit(10).coalesce(1), path)
    fs, root = media.filesystem(path)
    names = [n for n in __import__("os").listdir(root) if n.endswith(".zip")]
    with zipfile.ZipFile(f"{root}/{names[0]}") as z:
        assert z.testzip() is None and len(z.namelist()) == 10


def test_media_retries(tmp_path):
    data = media.encode_png(b"hello")
    m = media.Member("1", 0, len(data), zlib.crc32(data))
    head = media.local_header(b"1", m.size, m.crc)
    good = head + data + media.directory([m], len(head) + len(data))
    (tmp_path / "a.zip").write_bytes(good)
    reader = media._Reader({"path": str(tmp_path), "retries": "2"})
    fs, root = media.filesystem(str(tmp_path))
    calls = []

    def flaky(f):
        calls.append(f)
        if len(calls) < 3:
            raise OSError("lost")
        return media.read_member(f, m)

    with fs.open_input_file(f"{root}/a.zip") as f:
        assert reader._try(flaky, f, fs, f"{root}/a.zip") == data and len(calls) == 3
        with pytest.raises(OSError):
            reader._try(lambda g: media.read_member(g, media.Member("1", 0, m.size, 0)), f, fs, f"{root}/a.zip")


# --- HTML ---


def test_pages(spark, sf):
    pages = common.read(spark, sf, "pages")
    out = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.split("</article>|<footer", r["html"].split("<article>")[1])[0]
        want = " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if re.match("</?b>", m[0]) else " ", body)).split())
        assert (out[r["page_id"]]["text"], out[r["page_id"]]["n_chars"]) == (want, len(want))


PAGE = """<html><head><title>T{0}</title></head><body><header>Site</header><div id="menu">Home <ul>{3}</ul></div>
<div class="content"><h2>Head {0}</h2><p>First {1} &amp; in<b>line</b>.</p><p>Second {2}, longer text.</p><div class="comments"><p>Reader says {0}</p></div></div>
<div class="sidebar">More {1}</div><form>Mail <input></form><footer>&copy; us</footer></body></html>"""


def test_template():
    sources = [PAGE.format(i, "alpha " * (i + 3), "beta " * (i + 5), "".join(f"<li>n{i}{k}</li>" for k in range(i + 1))) for i in range(8)]
    pages = [html_extract.Page(s) for s in sources]
    t = html_extract.Template(pages)
    assert t.classes and any(c[2] is not None for c in t.classes)
    assert any(v == "Home" for _, v in t.members)
    for i, got in enumerate(html_extract.extract_chunk(sources)):
        assert got == " ".join(f"Head {i} First {'alpha ' * (i + 3)}& inline. Second {'beta ' * (i + 5)}, longer text.".split()).replace(" ,", " ,")
    assert html_extract.extract_chunk(sources[:1])[0].startswith("Head 0 First")


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (None, "x", "plain"), (3, "http://h/b", "<p>a<p>b<"), (4, "http://h/c", "<script>if (a<b) x()"), (5, "http://h/d", "<article>" + "x " * 50_000), (5, "http://h/d", "<article>" + "x " * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(df).collect()
    assert len(out) == len(rows)
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[1] == texts[2] == texts[4] == "" and texts[None] == "plain" and len(texts[5]) == 99_999
    assert html_extract.extract(df.limit(0)).count() == 0


# --- mixing ---


def shares(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets by repeated sharing, as the words say it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, budget * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            for s in open_:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
        left = budget * sum(sizes.values()) - sum(target[s] for s in names if s not in open_)
    return target


def test_mix(spark, docs, odd, none):
    for rows in (docs, odd):
        out = mixing.mix(rows).collect()
        assert len(out) == rows.count()
        sizes = {}
        for r in rows.select("source", "text").collect():
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^ \t-\r]+", r["text"] or ""))
        want = shares(sizes)
        for s in sizes:
            own = [r for r in out if r["source"] == s]
            assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
            assert abs(sum(r["copies"] * r["size"] for r in own) - want[s]) <= max(r["size"] for r in own) / 2 + 1e-6
            assert all(0 <= r["copies"] <= 2 for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_pivotal_levels(spark):
    """Many small blocks and levels: every row is decided once, sums stay."""
    rng = np.random.default_rng(5)
    rows = [("g", i, i, 1, int(s), float(p)) for i, (s, p) in enumerate(zip(rng.integers(1, 50, 900), rng.uniform(0.05, 0.95, 900), strict=True))]
    items = spark.createDataFrame(rows, "source string, key bigint, doc_id bigint, dup bigint, size bigint, p double")
    out = mixing.pivotal(items, ["source"], 900, 3, block=8, fan_in=4).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900)) and {r["p"] for r in out} == {0.0, 1.0}
    assert abs(sum(r["size"] * r["p"] for r in out) - sum(r[4] * r[5] for r in rows)) <= 25


def test_pivotal_is_fair(spark):
    """Over many seeds a row is taken about as often as its probability says."""
    rows = [("g", i, i, 1, 1 + i % 3, 0.3) for i in range(12)]
    items = spark.createDataFrame(rows, "source string, key bigint, doc_id bigint, dup bigint, size bigint, p double").cache()
    taken = sum(sum(r["p"] for r in mixing.pivotal(items, ["source"], 12, seed).collect()) for seed in range(25))
    assert 0.2 <= taken / (25 * 12) <= 0.4


def test_mix_applied(docs, odd):
    for rows in (docs, odd):
        copies = {}
        for r in mixing.mix(rows).collect():
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
        got = {r["doc_id"]: r["count"] for r in mixing.apply(rows).groupBy("doc_id").count().collect()}
        assert got == {k: v for k, v in copies.items() if v}


def test_mixing_keeps_clashing_columns(docs):
    clash = docs.withColumn("_copies", F.lit(7)).withColumn("copies", F.lit(8)).withColumn("_text_key", F.lit("mine")).withColumn("turn", F.lit(9))
    out = mixing.apply(clash)
    assert out.columns == clash.columns and out.filter("_copies != 7 or copies != 8 or _text_key != 'mine' or turn != 9").count() == 0
    assert out.count() == mixing.apply(docs).count()


# --- n-gram join ---


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k), i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def made_copies():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    rows, seed = [], list(rng.choice(vocabulary, 150))
    for i in range(160):
        if i < 60:  # near copies of one text, a chain of edits among them
            t = list(seed)
            for _ in range(i % 9):
                t[int(rng.integers(len(t)))] = f"e{i}{int(rng.integers(99))}"
        elif i < 100:  # a common passage in different texts
            t = [*rng.choice(vocabulary, 40), *passage, *rng.choice(vocabulary, 20)]
        elif i < 120:  # little but the passage
            t = [*passage, f"tail{i}", *rng.choice(vocabulary, 6)]
        else:
            t = list(rng.choice(vocabulary, int(rng.integers(1, 30))))
        rows.append((i, " ".join(t)))
    # many copies of another text, each with so many edits of its own that few of them link
    other = list(rng.choice(vocabulary, 150))
    for i in range(160, 230):
        t = list(other)
        for k in rng.choice(len(t), 1 + i % 5, replace=False):
            t[int(k)] = f"o{i}{int(k)}"
        rows.append((i, " ".join(t)))
    return rows + [(300 + k, rows[0][1].upper()) for k in range(30)]


@pytest.mark.parametrize("settings", [{}, {"group": 3, "spread": 5, "heavy": 40}, {"group": 2, "block": 700}])
def test_join(spark, settings):
    rows = made_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = ngram_join.join(df, **settings)[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_join_odd(odd, none, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ngram_join.join(odd.withColumn("row_key", F.lit("clash")))[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert ngram_join.join(none)[0].count() == 0
    one = ngram_join.one_of_each(odd.withColumn("row_key", F.lit("clash")))
    assert one.columns == [*odd.columns, "row_key"]
    assert sorted((r["doc_id"] for r in one.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7], key=str)
    blank = spark.createDataFrame([(1, None), (1, None), (2, ""), (2, " \n"), (None, ""), (4, "a b"), (4, "a b")], "doc_id bigint, text string")
    assert sorted(map(str, ngram_join.one_of_each(blank).collect())) == sorted(map(str, [*blank.collect()[:5], blank.collect()[5]]))


def link(a, b):
    return 100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n)


def test_below_hub_equals_all_pairs():
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    change = lambda s, most: np.unique(np.concatenate([rng.choice(s, len(s) - int(rng.integers(0, min(most, len(s)))), replace=False), fresh(int(rng.integers(0, most)))]))
    met = 0
    for _ in range(60):
        base = np.unique(fresh(int(rng.integers(5, 80))))
        hub = change(base, 12)
        sets = [change(base, int(rng.integers(2, 16))) for _ in range(25)]
        sets += [change(sets[int(rng.integers(25))], 6) for _ in range(15)] + [hub]
        comp, own = rng.integers(0, 30, len(sets)), rng.integers(0, 2, len(sets))
        for one, two in ((0, 0), (0, 1)):
            here = [k for k in range(len(sets)) if own[k] in (one, two)]
            some = [sets[k] for k in here]
            got = ngram_join.below_hub(hub, 3, some, comp[here], own[here], one, two)
            want = {(i, j) for i in range(len(here)) for j in range(i + 1, len(here)) if link(some[i], some[j]) and not (link(some[i], hub) and link(some[j], hub)) and comp[here[i]] != comp[here[j]] and (one == two or own[here[i]] != own[here[j]])}
            want |= {(i, -1) for i in range(len(here)) if comp[here[i]] != 3 and link(some[i], hub)}
            assert set(got) == want
            met += len(want)
    assert met > 300


def test_tree_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, 80, dtype=np.uint64))
        sets = []
        for _ in range(20):
            s = rng.choice(base, int(rng.integers(50, len(base))), replace=False)
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)])))
        q = sets.pop()
        found = ngram_join.Tree(sets, list(range(len(sets)))).linked(q, step=7)
        want = [i for i, s in enumerate(sets) if 100 * (x := len(np.intersect1d(s, q))) >= 80 * (len(s) + len(q) - x)]
        assert sorted(found) == want


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(9)
    for n in (3, 40, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, 2 * n, dtype=np.uint64)]))
        true = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert ngram_join.sketch_distance(ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)) <= true


def test_components(spark):
    links = [(b"a", b"b"), (b"b", b"c"), (b"d", b"e"), (b"f", b"e"), (b"z", b"a")] + [(bytes([160 + i]), bytes([161 + i])) for i in range(40)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(links, "a binary, b binary")).collect()))
    got = {bytes(k): bytes(v) for k, v in got.items()}
    assert got[b"z"] == got[b"c"] == b"a" and got[bytes([200])] == bytes([160])


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = common.read(spark, sf, "documents")
    clean = P.drop_toxic(spark, docs, sf)
    assert clean.columns == P.COLUMNS and 0 < clean.count() < docs.count()
    single = P.drop_near_copies(spark, docs, sf)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in brute_components(rows)})
    masked = P.mask_personal_data(spark, docs, sf)
    assert masked.filter("length(text) != n_chars").count() == 0 and masked.filter("text like '%[EMAIL]%'").count() > 0
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.filter("n_tokens != size(ids)").count() == 0


def test_pipeline_odd_rows(spark, sf, odd, none):
    import corpus_pipeline as P

    clash = odd.withColumn("score", F.lit(1)).withColumn("root", F.lit(2)).withColumn("copies", F.lit(3)).withColumn("text_key", F.lit("x"))
    for docs in (clash, none):
        n = docs.count()
        for k, (_, stage) in enumerate(P.STAGES):
            docs = common.checkpointed(stage(spark, docs, sf))
            assert docs.columns == (P.COLUMNS if k < 4 else ["doc_id", "lang", "source", "n_tokens", "ids"])
            # (3, "one two ...") is there three times under two ids, "solo" twice
            assert docs.count() <= (n, n - 3, n - 3, 2 * (n - 3), 2 * (n - 3))[k] if n else not docs.count()
        assert not n or docs.filter("n_tokens != size(ids)").count() == 0


def test_registered():
    from lodestone.llm import pipeline_query, registry

    names = {**registry.queries(), **pipeline_query.QUERIES}
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))

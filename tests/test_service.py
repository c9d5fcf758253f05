"""Operations of the block service against a server that records what it is asked."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.sources import rest, service

ASKED = []


class Service(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def _any(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        ASKED.append((self.command, self.path, body))
        path = self.path.split("?")[0]
        if path == "/files/upload":
            answer = {"id": "u1", "upload_url": f"http://{self.headers['Host']}/put/u1"}
        elif path == "/embeddings":
            texts = json.loads(body)["input"]
            answer = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]}
        elif path.endswith("/children") and self.command == "GET":
            below = path.split("/")[2]
            rows = [{"id": below + "a", "has_children": len(below) < 3}, {"id": below + "b", "has_children": False}]
            answer = {"results": rows, "has_more": False, "next_cursor": None}
        else:
            answer = {"path": path, "method": self.command}
        data = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PATCH = do_DELETE = do_PUT = _any


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("operation", sorted(service.OPERATIONS))
def test_operations(url, operation):
    method, path, fields = service.OPERATIONS[operation]
    ids = {k: f"x{k}" for k in service._ID.findall(path)}
    body = {f.rstrip("*"): {"v": f} for f in fields}
    ASKED.clear()
    assert service.Client(url).call(operation, **ids, **body) == {"path": "/" + path.format(**ids), "method": method} or operation == "create_file_upload"
    sent = json.loads(ASKED[0][2]) if ASKED[0][2] else None
    assert sent == (body["block"] if operation == "update_block" else body if fields else None)


def test_what_is_missing():
    with pytest.raises(ValueError, match="needs block_id, children; has no odd"):
        service.prepared("append_block_children", odd=1)


def test_trash(url):
    c = service.Client(url)
    ASKED.clear()
    c.trash("page", "p")
    c.trash("view", "v")
    c.restore("block", "b")
    c.delete_permanently("webhook", "w")
    assert [(m, p, b.decode()) for m, p, b in ASKED] == [("PATCH", "/pages/p", '{"in_trash": true}'), ("DELETE", "/views/v", ""), ("PATCH", "/blocks/b", '{"in_trash": false}'), ("DELETE", "/webhooks/w", "")]
    with pytest.raises(ValueError):
        c.restore("view", "v")


def test_upload(url, tmp_path):
    (tmp_path / "a.png").write_bytes(b"picture")
    ASKED.clear()
    service.Client(url).upload_file(str(tmp_path / "a.png"))
    assert [(m, p) for m, p, _ in ASKED] == [("POST", "/files/upload"), ("PUT", "/put/u1"), ("POST", "/files/upload/u1/complete")]
    assert json.loads(ASKED[0][2]) == {"name": "a.png", "content_type": "image/png"} and ASKED[1][2] == b"picture"


def test_rows(spark, url):
    rows = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(5)], "id string, title string")
    asked = service.plan(rows, "update_page", page_id=F.col("id"), properties=F.struct("title"))
    got = {r["path"]: json.loads(r["answer"]) for r in service.answers(asked, url).collect()}
    assert got == {f"pages/p{i}": {"path": f"/pages/p{i}", "method": "PATCH"} for i in range(5)}
    ASKED.clear()
    rest.send(asked, url)
    assert sorted(b for _, _, b in ASKED) == [json.dumps({"properties": {"title": f"t{i}"}}, separators=(",", ":")).encode() for i in range(5)]


def test_page_and_blocks_below(spark, url):
    got = [(r["path"], json.loads(r["item"]).get("id")) for r in service.page_blocks(spark, url, "p", wait="0").collect()]
    assert got[0] == ("pages/p", None)
    assert [g[1] for g in got[1:]] == ["pa", "paa", "paaa", "paab", "pab", "pb"]


def test_embeddings(spark, url):
    texts = spark.createDataFrame([(i, "x" * i) for i in range(7)] + [(9, None)], "doc int, text string")
    got = {r["doc"]: list(r["embedding"]) for r in service.embed(texts, url, "m", batch=3).collect()}
    assert got == {**{i: [float(i), 1.0] for i in range(7)}, 9: [0.0, 1.0]}
    answer = json.dumps({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "results": [{"index": 0, "relevance_score": 0.1}, {"index": 1, "relevance_score": 0.9}]})
    row = spark.range(1).select(service.embeddings(F.lit(answer)).alias("v"), service.relevances(F.lit(answer)).alias("r")).first()
    assert [list(v) for v in row["v"]] == [[1.0], [2.0]] and [r["index"] for r in row["r"]] == [1, 0]


def test_schemas(spark):
    assert service.store_body({"page_id": "p"}, "T", {"Name": "title", "Due": "date"})["properties"] == {"Name": {"title": {}}, "Due": {"date": {}}}
    with pytest.raises(ValueError):
        service.store_body({}, "T", {"a": "title", "b": "title"})
    assert service.json_schema({"a": {"type": "string"}}, ["a"])["required"] == ["a"]
    with pytest.raises(ValueError):
        service.json_schema({}, ["a"])
    title = spark.range(1).select(service.page_title(F.create_map(F.lit("title"), F.lit(" ")), F.lit("note.md")).alias("t")).first()["t"]
    assert title == "note"


def test_provider():
    got = service.provider({"url": "https://c/", "embedding_model": "e"}, {"rerank_model": "r", "embedding_model": "d"}, {"LODESTONE_URL": "http://env"})
    assert got == {"url": "http://env", "embedding_model": "e", "rerank_model": "r"}
    for bad in ({"url": "ftp://x", "embedding_model": "e", "rerank_model": "r"}, {"url": "http://x", "embedding_model": " ", "rerank_model": "r"}):
        with pytest.raises(ValueError):
            service.provider(bad, environment={})

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from lodestone.sources import rest

SENT, BUSY = [], {"left": 2}


class Service(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def _answer(self, code, body, **head):
        data = json.dumps(body).encode()
        self.send_response(code)
        for k, v in {"Content-Length": str(len(data)), **head}.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if BUSY["left"]:
            BUSY["left"] -= 1
            return self._answer(429, {}, Retry_After="0")
        url = urlparse(self.path)
        q = parse_qs(url.query)
        start, size = int(q.get("start_cursor", ["0"])[0]), int(q["page_size"][0])
        rows = [{"n": i, "of": url.path} for i in range(7)][start : start + size]
        more = start + size < 7
        self._answer(200 if url.path != "/gone" else 404, {"results": rows, "has_more": more, "next_cursor": str(start + size) if more else None})

    def do_PATCH(self):
        SENT.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode(), self.headers.get("Authorization")))
        self._answer(200, {})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages(spark, url):
    got = rest.pages(spark, url, ["users", "blocks"], page_size="3", wait="0").collect()
    assert sorted((r["path"], json.loads(r["item"])["n"], r["page"]) for r in got) == sorted((p, i, i // 3) for p in ("users", "blocks") for i in range(7))


def test_failure(spark, url):
    with pytest.raises(Exception, match="404"):
        rest.pages(spark, url, ["gone"], wait="0").collect()


def test_send(spark, url):
    rest.send(spark.createDataFrame([("PATCH", f"pages/{i}", json.dumps({"i": i})) for i in range(4)], "method string, path string, body string"), url, token="t")
    assert sorted(SENT) == [(f"/pages/{i}", json.dumps({"i": i}), "Bearer t") for i in range(4)]

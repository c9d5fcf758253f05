"""POST lists, page limits and blocks below blocks."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from lodestone.sources import rest

TREE = {"page": ["a", "b"], "a": ["c"], "c": ["d", "e", "f"]}


class Service(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def _page(self, rows, cursor, size, endless=False):
        start = int(cursor or 0)
        more = endless or start + size < len(rows)
        data = json.dumps({"results": rows[start : start + size], "has_more": more, "next_cursor": str(start + size) if more else None}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        url = urlparse(self.path)
        q = parse_qs(url.query)
        rows = [{"id": x, "has_children": x in TREE} for x in TREE[url.path.split("/")[2]]]
        self._page(rows, q.get("start_cursor", ["0"])[0], int(q["page_size"][0]))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        rows = [{"n": i, "query": body.get("query"), "filter": body.get("filter")} for i in range(5)]
        self._page(rows, body.get("start_cursor"), body["page_size"], body.get("query") == "endless")


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_post_list(spark, url):
    body = json.dumps({"query": "x", "filter": {"value": "page"}})
    got = rest.pages(spark, url, ["search", "databases/1/query"], page_size="2", method="POST", body=body).collect()
    assert sorted((r["path"], r["page"], json.loads(r["item"])["n"]) for r in got) == sorted((p, i // 2, i) for p in ("search", "databases/1/query") for i in range(5))
    assert all(json.loads(r["item"])["filter"] == {"value": "page"} for r in got)


def test_page_limit(spark, url):
    with pytest.raises(Exception, match="the limit is 4"):
        rest.pages(spark, url, ["search"], page_size="2", method="POST", body='{"query": "endless"}', max_pages="4").collect()


def test_children(spark, url):
    got = rest.pages(spark, url, ["blocks/page/children"], page_size="2", children="true").collect()
    assert [(r["path"], json.loads(r["item"])["id"]) for r in got] == [("blocks/page/children", "a"), ("blocks/a/children", "c"), ("blocks/c/children", "d"), ("blocks/c/children", "e"), ("blocks/c/children", "f"), ("blocks/page/children", "b")]

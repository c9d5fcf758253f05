"""Paged JSON services as a data source and a sink.

``rest_pages`` reads a list endpoint: pages follow one another by cursor, so one endpoint is one
partition; several paths (comma-separated) are read side by side. A busy answer (429) is tried
again after the time that the service names, others fail the task, which Spark runs again.
With method POST, size and cursor go into the JSON body (query, filter, sort) that is sent.
With children, the lists of blocks below an item that has children follow it, depth first;
path then names the list that an item is of, and with it the parent. More pages than
max_pages, or a cursor given twice, raise an error: nothing is cut silently.
Writing sends one request per row (method, path, body).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

TRIES = 3
WAIT = 5.0
#: Pages of a search at most, as in the reference; other lists have no limit unless asked for.
SEARCH_PAGES = 1_000


def request(url: str, method: str = "GET", body: str | None = None, token: str = "", tries: int = TRIES, wait: float = WAIT) -> dict:
    """The JSON answer of a request; a busy service is asked again up to tries times."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    for attempt in range(tries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body.encode() if body else None, head, method=method), timeout=60) as r:
                return json.loads(r.read() or b"{}")
        except urllib.error.HTTPError as e:
            if e.code != 429 or attempt == tries:
                raise
            time.sleep(float(e.headers.get("Retry-After") or wait * (attempt + 1)))
    raise AssertionError


class RestPages(DataSource):
    """Format ``rest_pages``. Options: url, paths, token, page_size, wait, method, body, children, max_pages."""

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "path string, page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


@dataclass
class _Endpoint(InputPartition):
    path: str


@dataclass
class _Sent(WriterCommitMessage):
    requests: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.token = options["url"].rstrip("/"), options.get("token", "")
        self.paths = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self.size, self.wait = int(options.get("page_size", 100)), float(options.get("wait", WAIT))
        self.method, self.body = options.get("method", "GET").upper(), json.loads(options.get("body") or "{}")
        self.children, self.most = options.get("children", "").lower() == "true", options.get("max_pages")

    def partitions(self) -> list[_Endpoint]:
        return [_Endpoint(p) for p in self.paths]

    def read(self, partition: _Endpoint) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, str]] = []
        # the lists being read, from the endpoint's down to that of the innermost block
        lists = [self._list(partition.path, self.method)]
        while lists:
            found = next(lists[-1], None)
            if found is None:
                lists.pop()
                continue
            path, page, item = found
            rows.append((path, page, json.dumps(item, sort_keys=True)))
            if self.children and isinstance(item, dict) and item.get("has_children"):
                lists.append(self._list(f"blocks/{item['id']}/children", "GET"))
            if len(rows) >= self.size:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["path", "page", "item"])

    def _list(self, path: str, method: str) -> Iterator[tuple[str, int, object]]:
        """(path, page, item) of a list's pages."""
        most = int(self.most) if self.most else SEARCH_PAGES if path == "search" else None
        cursor, page, seen = "", 0, set()
        while True:
            if method == "GET":
                mark = "&" if "?" in path else "?"
                after = f"&start_cursor={cursor}" if cursor else ""
                answer = request(f"{self.url}/{path}{mark}page_size={self.size}{after}", token=self.token, wait=self.wait)
            else:
                body = self.body | {"page_size": self.size} | ({"start_cursor": cursor} if cursor else {})
                answer = request(f"{self.url}/{path}", method, json.dumps(body), self.token, wait=self.wait)
            for item in answer.get("results", []):
                yield path, page, item
            cursor, page = answer.get("next_cursor") or "", page + 1
            if not answer.get("has_more") or not cursor:
                return
            if cursor in seen or (most and page >= most):
                raise RuntimeError(f"{path}: more pages after {page}, " + ("by a cursor given before" if cursor in seen else f"the limit is {most}"))
            seen.add(cursor)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.url, self.token, self.wait = options["url"].rstrip("/"), options.get("token", ""), float(options.get("wait", WAIT))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Sent:
        n = 0
        for batch in iterator:
            for r in batch.to_pylist():
                request(f"{self.url}/{r['path']}", r["method"], r["body"], self.token, wait=self.wait)
                n += 1
        return _Sent(n)


def pages(spark: SparkSession, url: str, paths: list[str], **options) -> DataFrame:
    """path, page, item (JSON) of list endpoints."""
    spark.dataSource.register(RestPages)
    return spark.read.format("rest_pages").option("url", url).option("paths", ",".join(paths)).options(**options).load()


def send(requests: DataFrame, url: str, **options) -> None:
    """One request per row (method, path, body). Requests have to bear being sent twice: a lost task is run again."""
    requests.sparkSession.dataSource.register(RestPages)
    requests.select("method", "path", "body").write.format("rest_pages").mode("append").option("url", url).options(**options).save()
